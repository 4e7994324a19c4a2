"""Small files by the thousand: one per key whatever the key holds, listed by few tasks."""

import re

from pyspark.sql import functions as F

import workload.all_queries  # noqa: F401
from pokerlake.session import LISTING
from pokerlake.sources.files import read_text_files
from pokerlake.streaming import ingest
from workload.tables_io import write_files

ROWS = [("a", "x"), ("b", "a/b %25"), ("c", None), (None, "x"), ("ü", "ü"), ("d", None)]


def test_a_file_per_key(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "raw_content string, key string")
    for named in (False, True):
        folder = f"{tmp_path}/{named}"
        write_files(rows, "key", folder, named)
        found = read_text_files(spark, folder).collect()
        assert sorted(sorted(r.raw_content.split("\n")) for r in found) == [["", "", "a"], ["", "b"], ["", "c", "d"], ["", "ü"]]
        assert all(("key=" in r.file_path) == named for r in found)
    assert write_files(rows.limit(0), "key", f"{tmp_path}/none") and read_text_files(spark, f"{tmp_path}/none").count() == 0


def test_listing_takes_few_tasks(spark, tmp_path, monkeypatch):
    write_files(spark.range(100).select(F.col("id").cast("string").alias("raw_content"), "id"), "id", f"{tmp_path}/in")
    before, seen = spark.conf.get(LISTING), []
    start = ingest.start_ingest

    def spied(spark, *args, **options):
        seen.append(spark.conf.get(LISTING))
        return start(spark, *args, **options)

    monkeypatch.setattr(ingest, "start_ingest", spied)
    table = ingest.ingest_text_stream(spark, f"{tmp_path}/in", "many_files", f"{tmp_path}/checkpoint", folder=f"{tmp_path}/tables")
    assert {int(r.raw_content) for r in table.collect()} == set(range(100)) and table.count() == 100
    assert seen == [str(4 * spark.sparkContext.defaultParallelism)] and spark.conf.get(LISTING) == before
    assert all(re.fullmatch(r"part-\d+\.txt", r.file_name) for r in table.select("file_name").collect())
