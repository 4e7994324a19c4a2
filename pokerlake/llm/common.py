"""Shared-folder tables and connected components for the corpus operators."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path
from uuid import uuid4

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pokerlake.session import shared_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex[:12]}"


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place in the shared folder, as tasks can open it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends, lost executors cost nothing."""
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table replaces the shuffle files that led to it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices_of(df: DataFrame, rows_per_slice: int = 1_000_000) -> int:
    """Number of range slices that keeps a slice near ``rows_per_slice`` rows."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, -(-df.count() // rows_per_slice))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable from it.

    Each round hooks the labels at both ends of every edge to the smaller one and then
    follows pointers once, so the rounds follow the logarithm of a component's size. An
    edge is sent under its label, summed up before the shuffle, and edges inside a
    component are dropped, so a hub costs no more than any other id. Every round is a
    table in the shared folder.
    """
    pairs = stored(edges.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    ids = pairs.select(F.col("low").alias("id")).union(pairs.select(F.col("high").alias("id"))).distinct()
    labels = stored(ids.select("id", F.col("id").alias("component")), "labels")
    while not pairs.isEmpty():
        # Every root hooks to the smallest root next to it; the smallest of all stays one.
        parent = pairs.groupBy(F.col("high").alias("root")).agg(F.min("low").alias("parent"))
        parent = stored(parent, "parents")
        jumps = parent
        while True:  # follow parents to their root: parents are smaller, so there is no cycle
            up = jumps.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
            longer = stored(jumps.join(up, "parent", "left").select("root", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "jumps")
            jumps = longer.select("root", "parent")
            if longer.filter("moved").isEmpty():
                break
        labels = stored(_relabel(labels, "component", jumps), "labels")
        moved = _relabel(_relabel(pairs, "low", jumps), "high", jumps).filter("low <> high")
        pairs = stored(moved.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct(), "edges")
    return labels


def _relabel(df: DataFrame, column: str, jumps: DataFrame) -> DataFrame:
    to = jumps.select(F.col("root").alias(column), F.col("parent").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, through the shared folder."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package, data = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(data, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        folder = fresh_folder(spark, "package")
        system, inner = storage(folder)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{package.name}.zip") as out:
            out.write(data.getvalue())
        context.addPyFile(f"{folder}/{package.name}.zip")
        _shipped.add(context.applicationId)


def in_blocks(rows: DataFrame, key: str, number: str, spread: str, size: int) -> DataFrame:
    """Rows of a key dealt into pairs of blocks, for comparing all of them in bounded groups.

    ``number`` holds the rows of the key. A key with up to ``size`` rows is one block; a
    larger one is cut into blocks by the hash of ``spread``, and every pair of blocks
    (``low``, ``high``) becomes a group of its own. ``block`` is the row's own block.
    """
    parts = F.ceil(F.col(number) / F.lit(size)).cast("int")
    cut = rows.withColumn("_parts", parts).withColumn("block", F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))
    dealt = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}).drop("_parts", "_other")
