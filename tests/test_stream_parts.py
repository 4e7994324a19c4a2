"""The stream query writes its parts with many tasks and still gives the batch result."""

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

import workload.all_queries  # noqa: F401
from workload.fixture_tables import Tables
from workload.registry import QUERIES


def test_parts_are_not_written_by_one_task(spark, tmp_path):
    day = F.lit(datetime(2026, 1, 1)) + F.make_dt_interval(F.col("id") % 30)
    spark.range(300).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 20).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), day.alias("o_orderdate")
    ).write.parquet(f"{tmp_path}/orders.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    older = set(shared.glob("run-*/in"))
    tables = Tables(spark, str(tmp_path))
    found, batch = (sorted(tuple(r) for r in QUERIES[name](tables).collect()) for name in ("lnk3_first_of_spot_stream", "lnk3_first_of_spot"))
    assert found == batch and len(found) > 100
    (folder,) = set(shared.glob("run-*/in")) - older
    assert len(list(folder.glob("part-*"))) > 3
