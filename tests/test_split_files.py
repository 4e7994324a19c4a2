"""Hand files written from tables of the test's own: their number follows the size of the data."""

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

import workload.all_queries  # noqa: F401
from workload.fixture_tables import Tables
from workload.registry import QUERIES

SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_files_grow_in_number_with_the_hands(spark, tmp_path):
    day = F.lit(datetime(2026, 1, 1))
    orders = spark.range(400).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 20).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), day.alias("o_orderdate")
    )
    lines = spark.range(400).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"),
        F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit(3.0).alias("l_quantity"),
    )
    customers = spark.range(20).select(F.col("id").alias("c_custkey"))
    for name, rows in (("orders", orders), ("lineitem", lines), ("customer", customers)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    older = set(shared.glob("run-*/histories"))
    before = spark.conf.get(SIZE, None)
    spark.conf.set(SIZE, "4k")
    try:
        found = QUERIES["src1_split_hand_files"](Tables(spark, str(tmp_path))).agg(F.count("hand_id"), F.count_distinct("hand_id"), F.min("seats")).first()
    finally:
        spark.conf.unset(SIZE) if before is None else spark.conf.set(SIZE, before)
    (folder,) = set(shared.glob("run-*/histories")) - older
    assert tuple(found) == (400, 400, 6)
    assert len(list(folder.glob("part-*.txt"))) > 3
