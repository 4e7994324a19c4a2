"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions, turns a join into a broadcast join only
# when the measured size allows it, and splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}
#: Largest tables that joins broadcast, by the optimizer's guess and by what a shuffle has measured.
GUESSED_BROADCAST, MEASURED_BROADCAST = "512k", "10m"
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def local_session(
    cores: int | str = "*", partitions: int = 8, app: str = "pokerlake", settings: dict[str, str] | None = None
) -> SparkSession:
    """Single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    # As many partitions as cores: nothing to merge on one machine.
    builder = builder.config("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def broadcast_measured(spark: SparkSession) -> None:
    """Let AQE choose broadcast joins by the sizes it has measured.

    Before anything has run, a size is guessed from compressed files and takes an exploded array for
    one row, so that tables of millions of rows pass for 10 MB and end up in the driver. Only what
    is guessed at ``GUESSED_BROADCAST`` or less is broadcast unseen.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", GUESSED_BROADCAST)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", MEASURED_BROADCAST)


@contextmanager
def listing_by_cores(spark: SparkSession):
    """Meanwhile folders and files are listed by a few tasks per core; by default every path is a task of its own, up to 10,000."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting falls back to a temporary folder; on a
    cluster that would be a folder of one machine, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pokerlake-"))
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
