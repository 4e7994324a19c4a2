"""Sources, sinks and streams: files and tables are written to the shared folder first."""

from __future__ import annotations

import re
import sys
from urllib.parse import quote
from uuid import uuid4
from zlib import crc32

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.operators import hand_text, tournament_text
from pokerlake.plans.features import player_features
from pokerlake.plans.players import player_statistics
from pokerlake.sinks import tables as sinks
from pokerlake.sources.files import base_name, preview_text_files, read_hand_blocks, read_text_files, scan
from pokerlake.streaming.ingest import ingest_captures, ingest_hand_histories, ingest_tournament_summaries
from workload import derived as d
from workload import render
from workload.derived import fresh_dir
from workload.registry import cte, query

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers get the writer itself

FOLDER = {"hand_history": "batch", "tournament_history": "tournament_id", "analysis_result": "doc_id"}


def fresh_table(name: str) -> str:
    return f"{name}_{uuid4().hex[:12]}"


def write_files(df: DataFrame, by: str, folder: str, named: bool = False) -> str:
    """One text file per value of ``by``, in a folder per value if ``named``; a task that runs again writes the same files.

    A file per row is more than Spark's writers are made for (they start processes to set the rights of each file, and
    the driver moves them into place one by one), so the tasks write through Arrow's file systems.
    """
    spark = df.sparkSession
    # Files cost the same whatever their size, so the tasks are not merged by bytes.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = F.array_join(F.collect_list(F.coalesce("raw_content", F.lit(""))), "\n")
    files = df.select("raw_content", by).repartition(tasks, by).groupBy(by).agg(lines.alias("raw_content"))
    rows = files.select(F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("key"), "raw_content")
    storage(folder)[0].create_dir(storage(folder)[1], recursive=True)
    rows.mapInArrow(file_writer(folder, by if named else None), "files long").agg(F.sum("files")).collect()
    return folder


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"\w[\w+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def file_writer(folder: str, by: str | None):
    """For ``mapInArrow``: a file per row of key and raw_content, below ``by``=key or one of 256 folders."""

    def write(batches):
        system, top = storage(folder)
        made = set()
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["raw_content"].to_pylist()):
                name = quote(key, safe="")
                inner = f"{top}/{by}={name}" if by else f"{top}/{crc32(name.encode()) % 256:03d}"
                if inner not in made:
                    system.create_dir(inner, recursive=True)
                    made.add(inner)
                with system.open_output_stream(f"{inner}/part-{name}.txt") as out:
                    out.write(text.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    return write


def json_files(t) -> DataFrame:
    return t.documents.select(F.to_json(F.struct("doc_id", "lang", "text")).alias("raw_content"), "doc_id")


def ingested(t, job, files: DataFrame, by: str, named: bool = False) -> DataFrame:
    folder = fresh_dir(t)
    return job(t.spark, write_files(files, by, f"{folder}/in", named), f"{folder}/checkpoint", fresh_table("bronze"), folder=f"{folder}/tables")


HAND_IDS = f"SELECT hand_id, floor(k / {render.HANDS_PER_FILE})::BIGINT AS batch FROM fx_hands"


def hand_ids(bronze: DataFrame) -> DataFrame:
    batch = F.regexp_extract("file_path", r"batch=(\d+)", 1).cast("bigint")
    named = bronze.select("raw_content", batch.alias("file_name"))
    return hand_text.hand_headers(hand_text.hand_blocks(named)).select("hand_id", F.col("file_name").alias("batch"))


@query("src1_ingest_hand_histories", HAND_IDS)
def _(t):
    return hand_ids(ingested(t, ingest_hand_histories, render.hand_files(t), "batch", named=True))


@query("src1_split_hand_files", """
    SELECT hand_id, CAST(big_blind AS BIGINT) AS big_blind, CAST(total_pot AS BIGINT) AS total_pot, CAST(6 AS BIGINT) AS seats FROM fx_hands""")
def _(t):
    folder = f"{fresh_dir(t)}/histories"
    # Large files of about one size, as many as the hands fill; they are cut by byte ranges when they are read.
    render.hand_texts(t).select("block").hint("rebalance", F.col("block")).write.option("lineSep", "\n\n\n").text(folder)
    parsed = hand_text.parse_blocks(read_hand_blocks(t.spark, folder, "*.txt"))
    return parsed.select("hand_id", "big_blind", "total_pot", F.size("seats").alias("seats"))


@query("src2_ingest_tournament_summaries", "SELECT * FROM fx_summaries".replace("*", "tournament_id, buyin_prize, hero_position, hero_prize, started_at"))
def _(t):
    bronze = ingested(t, ingest_tournament_summaries, render.summary_files(t), "tournament_id")
    return tournament_text.parse_tournaments(bronze.select("raw_content", "file_name")).select(
        "tournament_id", "buyin_prize", "hero_position", "hero_prize", "started_at"
    )


@query("src3_ingest_captures", "SELECT doc_id, lang, text FROM documents")
def _(t):
    bronze = ingested(t, ingest_captures, json_files(t), "doc_id")
    return bronze.select(F.from_json("raw_content", "doc_id BIGINT, lang STRING, text STRING").alias("d")).select("d.*")


@query("src4_existing_files_and_str2_exactly_once", """
    SELECT 'first' AS run, COUNT(*) AS files FROM (SELECT DISTINCT floor(k / 64) AS batch FROM fx_hands) x WHERE batch % 2 = 0
    UNION ALL SELECT 'second', COUNT(DISTINCT floor(k / 64)) FROM fx_hands
    UNION ALL SELECT 'third', COUNT(DISTINCT floor(k / 64)) FROM fx_hands""".replace("64", str(render.HANDS_PER_FILE)))
def _(t):
    """Three runs over one checkpoint: half of the files, all of them, nothing new."""
    folder, table, files = fresh_dir(t), fresh_table("bronze"), d.stored(t, render.hand_files(t))
    counts = []
    for run, batch in (("first", files.filter("batch % 2 = 0")), ("second", files.filter("batch % 2 = 1")), ("third", None)):
        if batch is not None:
            write_files(batch, "batch", f"{folder}/in")
        seen = ingest_hand_histories(t.spark, f"{folder}/in", f"{folder}/checkpoint", table, folder=f"{folder}/tables")
        counts.append((run, seen.count()))
    return t.spark.createDataFrame(counts, "run string, files bigint")


@query("src5_base_name", "SELECT page_id, regexp_extract(url, '[^/]+$') AS file_name FROM pages")
def _(t):
    return t.pages.select("page_id", base_name(F.col("url")).alias("file_name"))


@query("src6_preview_of_files", "SELECT CAST(COUNT(DISTINCT doc_id) AS BIGINT) AS files, CAST(SUM(length(text) + 1) AS BIGINT) AS characters FROM documents")
def _(t):
    folder = write_files(t.documents.select(F.col("text").alias("raw_content"), "doc_id"), "doc_id", f"{fresh_dir(t)}/in")
    files = read_text_files(t.spark, folder)
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("raw_content")).alias("characters"))


def table_of(t, df: DataFrame) -> str:
    """Name of a new table in the shared folder that holds the rows."""
    table = fresh_table("rows")
    sinks.overwrite_table(df, table, fresh_dir(t))
    return table


@query("src6_preview_of_n_files", """
    SELECT 'lang=' || lang || '/' AS folder, 5::BIGINT AS files FROM documents WHERE lang = (SELECT MIN(lang) FROM documents) GROUP BY 1""")
def _(t):
    folder = f"{fresh_dir(t)}/in"
    t.documents.select(F.col("text").alias("raw_content"), "lang", "doc_id").repartition(8, "doc_id").select("raw_content", "lang").write.partitionBy("lang").text(folder)
    files = preview_text_files(t.spark, folder, 5)
    return files.groupBy(F.regexp_extract("file_path", "lang=[^/]+/", 0).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


@query("src7_scan_table", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    table = table_of(t, t.orders)
    return scan(t.spark, table).filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("src8_scan_features", "SELECT player_name, total_hands, vpip_pct FROM fx_statistics")
def _(t):
    table = table_of(t, player_features(player_statistics(d.player_hand_stats(t))))
    return scan(t.spark, table, ["player_name", "total_hands", "vpip_pct"])


@query("str1_three_feeds", f"""
    SELECT 'analysis_result' AS feed, COUNT(*) AS files FROM documents UNION ALL SELECT 'hand_history', COUNT(DISTINCT floor(k / {render.HANDS_PER_FILE})) FROM fx_hands
    UNION ALL SELECT 'tournament_history', COUNT(*) FROM fx_tournaments""")
def _(t):
    feeds = {
        "hand_history": (ingest_hand_histories, render.hand_files(t)),
        "tournament_history": (ingest_tournament_summaries, render.summary_files(t)),
        "analysis_result": (ingest_captures, json_files(t)),
    }
    counts = [
        ingested(t, job, files, FOLDER[feed]).agg(F.lit(feed).alias("feed"), F.count(F.lit(1)).alias("files"))
        for feed, (job, files) in feeds.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("str3_str4_drained_and_stamped", f"SELECT COUNT(DISTINCT floor(k / {render.HANDS_PER_FILE})) AS files, true AS stamped, true AS drained FROM fx_hands")
def _(t):
    bronze = ingested(t, ingest_hand_histories, render.hand_files(t), "batch")
    return bronze.agg(
        F.count(F.lit(1)).alias("files"),
        F.bool_and(F.col("ingested_at").between(F.lit("2020-01-01"), F.current_timestamp())).alias("stamped"),
        F.lit(not t.spark.streams.active).alias("drained"),
    )


@query("snk2_full_refresh", "SELECT tournament_id, hero_position::BIGINT AS hero_position FROM fx_tournaments")
def _(t):
    table = table_of(t, t.tournaments.select("tournament_id", "buyin_total"))
    return sinks.overwrite_table(t.tournaments.select("tournament_id", "hero_position"), table, fresh_dir(t))


@query("snk3_insert_only_merge", "SELECT player_name, hand_id, anonymous_id, seat::BIGINT AS seat, file_name FROM fx_identity")
def _(t):
    table, rows = fresh_table("player_identity"), d.identity(t)
    keys = ["player_name", "hand_id"]
    sinks.insert_new_rows(t.spark, table, rows.filter("seat < 4"), keys, fresh_dir(t))
    return sinks.insert_new_rows(t.spark, table, rows, keys).filter("created_at IS NOT NULL").drop("created_at")


@query("snk4_upsert", "SELECT o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN MAX(o_totalprice) ELSE MIN(o_totalprice) END AS price FROM orders GROUP BY 1")
def _(t):
    table = fresh_table("features")
    by_customer = t.orders.groupBy(F.col("o_custkey").alias("id"))
    sinks.upsert(t.spark, table, by_customer.agg(F.min("o_totalprice").alias("price")), ["id"], fresh_dir(t))
    return sinks.upsert(t.spark, table, by_customer.agg(F.max("o_totalprice").alias("price")).filter("id % 3 = 0"), ["id"], fresh_dir(t))


@query("snk5_drop_and_rebuild", "SELECT hand_id, big_blind FROM fx_hands")
def _(t):
    table = table_of(t, t.hands.select("hand_id"))
    return sinks.overwrite_table(t.hands.select("hand_id", "big_blind"), table, fresh_dir(t))


@query("snk6_match_report", """
    SELECT COUNT(*) AS total, COUNT(hand_id) AS matched, CAST(ROUND(CAST(COUNT(hand_id) * 1e2 / COUNT(*) AS DECIMAL(38,10)), 1) AS DOUBLE) AS matched_pct,
           COUNT(*) FILTER (WHERE match_confidence = 'high') AS high, COUNT(*) FILTER (WHERE match_confidence = 'medium') AS medium,
           COUNT(*) FILTER (WHERE hand_id IS NULL) AS without_hand FROM fx_map""")
def _(t):
    return sinks.match_report(d.mapping(t))


@query("snk7_latest", "SELECT event_id, ts AS ingested_at FROM events ORDER BY ts DESC LIMIT 10")
def _(t):
    return sinks.latest(t.events.select("event_id", F.col("ts").alias("ingested_at")), 10)
