"""First captures of spots from a stream of captures, in event time.

A spot lies within ten minutes by its key, so its earliest capture is known once the watermark,
the latest capture time seen less ``delay``, has passed the end of these minutes. Until then
captures may come in any order and any number of times: a file counts once, and the spot is
held in state as one struct. What comes later than the watermark cannot be told from a repeat;
it is dropped and counted. Captures without a time have no place in event time and are left
to the batch job (``captures.first_of_spots``), whose result the stream gives for all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pokerlake.operators import captures

DELAY = "1 hour"
SPOT = f"{captures.SPOT_SECONDS} seconds"


def capture_stream(spark: SparkSession, folder: str, max_files: int = 1_000) -> DataFrame:
    """Rows of a bronze table's folder as a stream: raw_content, file_name."""
    schema = StructType.fromDDL("raw_content string, file_name string")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def first_of_spots(bronze: DataFrame, delay: str = DELAY) -> DataFrame:
    """As ``captures.first_of_spots``, for a stream: a row per spot, as soon as the spot is complete."""
    keyed = captures.with_spot_key(captures.parse_screenshots(bronze)).filter("screenshot_at IS NOT NULL")
    once = keyed.withWatermark("screenshot_at", delay).dropDuplicatesWithinWatermark(["file_name"])
    grouped = once.groupBy(F.window("screenshot_at", SPOT), "spot_key").agg(
        F.min_by(F.struct("file_name", "screenshot_at", "data"), F.struct("screenshot_at", "file_name")).alias("_first"),
        F.count("data.gpt_advice.raw.action").cast("int").alias("recommendation_count"),
    )
    return grouped.select(
        "spot_key", F.col("_first.file_name").alias("file_name"), F.col("_first.screenshot_at").alias("screenshot_at"), F.col("_first.data").alias("data"), "recommendation_count"
    )


def start_first_of_spots(bronze: DataFrame, folder: str, checkpoint: str, delay: str = DELAY) -> StreamingQuery:
    """Append complete spots to a Parquet folder; stops when the source is drained, and goes on there the next time."""
    return (
        first_of_spots(bronze, delay)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(folder)
    )


def late_captures(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over the micro-batches of this run that are still known."""
    return sum(operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators)
