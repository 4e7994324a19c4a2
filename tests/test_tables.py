"""Streams and sinks run twice change nothing more."""

import random

import pytest
from pyspark.sql import functions as F

from pokerlake.plans import players
from pokerlake.sinks import tables
from pokerlake.sinks.tables import insert_new_rows, latest, match_report, overwrite_table, upsert, upsert_stream
from pokerlake.sources.files import preview_text_files, read_text_files
from pokerlake.streaming.ingest import ingest_text_stream


def test_stream_takes_every_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one\ntwo")
    args = (spark, str(source), "stream_once", str(tmp_path / "checkpoint"))
    options = {"folder": str(tmp_path / "tables"), "max_files": 1}
    assert ingest_text_stream(*args, **options).count() == 1
    (source / "b.txt").write_text("three")
    table = ingest_text_stream(*args, **options)
    assert sorted((r.file_name, r.raw_content) for r in table.collect()) == [("a.txt", "one\ntwo"), ("b.txt", "three")]
    assert ingest_text_stream(*args, **options).count() == 2
    assert read_text_files(spark, str(source), "b*").first().file_name == "b.txt"
    assert [r.file_name for r in preview_text_files(spark, str(source), 1).collect()] == ["a.txt"]
    assert preview_text_files(spark, str(source), 5, "c*").collect() == []


def test_insert_only_and_upsert(spark, tmp_path):
    folder = str(tmp_path)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c")], "id int, v string")
    insert_new_rows(spark, "only_new", old, ["id"], folder)
    for _ in range(2):
        kept = insert_new_rows(spark, "only_new", new, ["id"], folder)
    assert sorted((r.id, r.v) for r in kept.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert kept.filter("created_at IS NULL").isEmpty()
    upsert(spark, "by_key", old, ["id"], folder)
    for _ in range(2):
        state = upsert(spark, "by_key", new, ["id"], folder)
    assert sorted(map(tuple, state.collect())) == [(1, "a"), (2, "x"), (3, "c")]
    with pytest.raises(ValueError):
        upsert(spark, "by_key", new.unionAll(new), ["id"], folder)
    # A refresh replaces the schema as well.
    assert overwrite_table(old.select("id"), "by_key", folder).columns == ["id"]


def test_upsert_survives_a_crash_and_rewrites_touched_parts_only(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    rows = spark.range(200).select("id", F.lit("old").alias("v"))
    upsert(spark, "crashing", rows, ["id"], folder, parts=8)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}

    def broken(*_):
        raise RuntimeError("lost")

    one = spark.createDataFrame([(5, "new")], "id bigint, v string")
    with monkeypatch.context() as m:
        calls = iter([tables._finish, broken])
        m.setattr(tables, "_finish", lambda *a: next(calls)(*a))
        with pytest.raises(RuntimeError):
            upsert(spark, "crashing", one, ["id"], folder, parts=8)
    assert spark.read.table("crashing").count() == 200
    two = spark.createDataFrame([(300, "new")], "id bigint, v string")
    state = {r.id: r.v for r in upsert(spark, "crashing", two, ["id"], folder, parts=8).collect()}
    assert len(state) == 201 and state[5] == state[300] == "new" and state[6] == "old"
    untouched = [p for p in files if p.exists() and p.stat().st_mtime_ns == files[p]]
    assert len(untouched) >= 6


def test_readers_of_an_upserted_table_see_old_or_new_state(spark, tmp_path):
    rows = spark.range(300).select("id", F.lit("old").alias("v"))
    upsert(spark, "read_on", rows, ["id"], str(tmp_path), parts=4)
    reader = spark.read.table("read_on")
    upsert(spark, "read_on", rows.withColumn("v", F.lit("new")), ["id"], str(tmp_path))
    assert {r.v for r in reader.collect()} == {"old"}
    assert {r.v for r in spark.read.table("read_on").collect()} == {"new"}
    # An upsert that is lost before its snapshot is complete changes nothing.
    following = f"read_on__{tables._snapshot(spark, 'read_on')[0] + 1}"
    rows.limit(5).withColumn(tables.PART, F.lit(0)).write.partitionBy(tables.PART).option("path", str(tmp_path / "lost")).saveAsTable(following)
    state = upsert(spark, "read_on", spark.createDataFrame([(7, "third")], "id bigint, v string"), ["id"], str(tmp_path))
    assert state.groupBy("v").count().orderBy("v").collect() == [("new", 299), ("third", 1)]
    assert state.columns == ["id", "v"] and not spark.catalog.tableExists("read_on__1")
    live = {f.split("/_part=")[0] for f in state.inputFiles()}
    assert len(live) == 2 and len(list((tmp_path / "read_on__parts").glob("*/_part=*/*.parquet"))) == 5


def test_upserted_tables_get_more_parts_as_they_grow(spark, tmp_path):
    for wide in range(1, 40):
        for n in range(200):
            before, after = tables.part_of(n, wide), tables.part_of(n, wide + 1)
            assert before < wide and (after == before or after == wide)
    parts, expected = [], {}
    for step in range(6):
        ids = list(range(step * 100, step * 100 + 120))
        expected |= dict.fromkeys(ids, step)
        batch = spark.createDataFrame([(i, step) for i in ids], "id bigint, v int")
        state = upsert(spark, "growing", batch, ["id"], str(tmp_path), parts=2, rows_per_part=60)
        parts.append(tables._snapshot(spark, "growing")[1])
        assert dict(map(tuple, state.collect())) == expected and state.count() == len(expected)
    assert parts == [2, 2, 4, 6, 7, 9]
    upsert(spark, "growing_at_once", spark.range(600), ["id"], str(tmp_path), parts=2, rows_per_part=60)
    assert tables._snapshot(spark, "growing_at_once")[1] == 10
    # Every row lies where its key says, also in parts that were never written again.
    last = spark.read.table(f"growing__{tables._snapshot(spark, 'growing')[0]}")
    assert last.filter(F.col(tables.PART) != tables._part(["id"], 9)).isEmpty()


def test_stream_upserts_twice(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.json(str(source))
    for batch in (None, [(2, "x"), (3, "c")]):
        if batch:
            spark.createDataFrame(batch, "id int, v string").write.mode("append").json(str(source))
        stream = spark.readStream.schema("id int, v string").json(str(source))
        upsert_stream(stream, "streamed", ["id"], str(tmp_path / "checkpoint"), str(tmp_path / "tables")).awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.table("streamed").collect()) == [(1, "a"), (2, "x"), (3, "c")]


def test_reports(spark):
    mapping = spark.createDataFrame([("h", "high"), ("h", "unmatched"), (None, "unmatched")], "hand_id string, match_confidence string")
    assert match_report(mapping).first().asDict() == {
        "total": 3, "matched": 2, "matched_pct": 66.7, "high": 1, "medium": 0, "without_hand": 1
    }
    df = spark.createDataFrame([(i,) for i in range(30)], "ingested_at int")
    assert [r[0] for r in latest(df, 2).collect()] == [29, 28]


def test_player_sums_of_batches_equal_a_full_run(spark, tmp_path):
    rng = random.Random(6)
    flags = ["vpip", "pfr", "three_bet", "went_to_showdown", "won_hand", "went_allin", "preflop_shove"]
    schema = (
        "player_name string, hand_id int, stage string, position string, position_group string, stack_bb double, total_bets int, total_raises int,"
        "total_calls int, preflop_raise_bb double, avg_action_size_bb double, net_profit double, " + ", ".join(f"{f} boolean" for f in flags)
    )
    rows = [
        (rng.choice("abc"), i, rng.choice(["rush", "final", None]), rng.choice(["SB", "BB", "CO", None]), rng.choice(["early", "late", "blinds"]), rng.choice([None, 5.0, 15.0, 40.0]),
         rng.randrange(3), rng.randrange(3), rng.randrange(2), rng.choice([None, 2.1, 0.3, 7.7]), rng.choice([None, 0.1, 0.7]), float(rng.randrange(-900, 900)),
         *[rng.choice([True, False, None]) for _ in flags])
        for i in range(300)
    ]
    stats = spark.createDataFrame(rows, schema)
    whole = sorted(map(tuple, players.player_statistics(stats).collect()))
    parts = {"early": stats.filter("hand_id < 90"), "late": stats.filter("hand_id >= 90")}
    players.merge_hands(spark, "sums", parts["late"].filter("hand_id < 200"), "late", str(tmp_path))  # corrected below
    for batch in ("early", "late", "early", "early"):
        merged = players.merge_hands(spark, "sums", parts[batch], batch, str(tmp_path))
    assert sorted(map(tuple, merged.collect())) == whole and len(whole) == 3
    assert players.statistics_of(players.added_sums(players.player_sums(stats.limit(0)))).collect() == []
