"""Micro-batches in event time give what the batch job gives."""

from datetime import datetime

from pokerlake.operators import captures
from pokerlake.streaming import spots

DOCUMENT = '{"hero": {"cards": "%s", "pos": "BTN"}, "street": "flop", "pot": 4.5, "gpt_advice": {"raw": {"action": "%s"}}}'


def shot(minute, second=0, cards="AsKd", tag="x"):
    return DOCUMENT % (cards, tag), f"screenshot_20260304_20{minute:02d}{second:02d}_{tag}"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "raw_content string, file_name string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, delay="10 minutes"):
    query = spots.start_first_of_spots(spots.capture_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "checkpoint"), delay)
    query.awaitTermination()
    return query


def rows(df):
    return sorted((r.spot_key, r.file_name, r.screenshot_at, r.recommendation_count) for r in df.collect())


def test_three_batches_equal_the_batch_job(spark, tmp_path):
    folder = str(tmp_path / "in")
    first = [shot(1, 30, tag="b"), shot(3, tag="c"), shot(2, cards="QhQc", tag="d"), ("{broken", "screenshot_20260304_200200_e"), ('{"gpt_advice": {}}', "no_time")]
    second = [shot(1, 10, tag="a"), shot(3, tag="c"), shot(12, tag="f")]  # an earlier one, a repeat, the next ten minutes
    third = [shot(14, tag="g"), shot(11, 59, tag="h"), shot(2, cards="QhQc", tag="d")]
    arrive(spark, folder, first)
    run(spark, tmp_path)
    assert rows(spark.read.schema("spot_key string, file_name string, screenshot_at timestamp, recommendation_count int").parquet(str(tmp_path / "out"))) == []
    arrive(spark, folder, second)
    run(spark, tmp_path)
    arrive(spark, folder, third)
    run(spark, tmp_path)
    arrive(spark, folder, [shot(59, tag="end")])
    query = run(spark, tmp_path)
    assert spots.late_captures(query) == 0
    bronze = spark.createDataFrame(sorted({*first, *second, *third}), "raw_content string, file_name string")
    batch = captures.first_of_spots(captures.with_spot_key(captures.parse_screenshots(bronze))).filter("screenshot_at IS NOT NULL")
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    assert got == rows(batch)
    assert [(r[1][-1], r[3]) for r in got] == [("a", 3), ("d", 1), ("h", 3)]

    # Too late now: the first ten minutes are over, the count says so and the result stays.
    arrive(spark, folder, [shot(1, tag="late")])
    assert spots.late_captures(run(spark, tmp_path)) == 1
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == got
    assert datetime(2026, 3, 4, 20, 1, 10) in [r[2] for r in got]
