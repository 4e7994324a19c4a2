import itertools
import zlib

import numpy as np

from pokerlake.llm import sharding
from tests.llm.frames import EDGES, documents


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(points, bits)
        assert sorted(index) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def rows(n=300):
    texts = ["word " * (1 + i * 37 % 50) + str(i) for i in range(n)]
    return [(i, t, "en" if i % 3 else None, f"s{i % 5}") for i, t in enumerate(texts)] + [(n + i, "copy " * 4, "en", f"s{i % 7}") for i in range(9)]


def test_bytes_are_near_equal_and_slots_gapless(spark):
    data = rows()
    got = sharding.shards(documents(spark, data), 8).collect()
    size = {r.doc_id: r.size for r in got}
    assert size == {i: len(t.encode()) + 8 for i, t, *_ in data}
    assert all(r.text_crc32 == zlib.crc32(data[r.doc_id][1].encode()) for r in got)
    largest, total = max(size.values()), sum(size.values())
    for shard in range(8):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= largest
        assert [r.cell for r in sorted(own, key=lambda r: r.slot)] == sorted(r.cell for r in own)
    assert len({r.shard for r in got if r.doc_id >= 300}) == 1  # equal texts stay together


def test_edge_rows(spark):
    got = sharding.shards(documents(spark, EDGES), 3).collect()
    assert len(got) == len(EDGES) and {r.size for r in got if r.doc_id in (1, 2)} == {8}
    assert sharding.shards(documents(spark, EDGES).limit(0), 3).collect() == []


def test_written_files_are_the_shards(spark, tmp_path):
    docs = documents(spark, rows(60))
    assigned = sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(docs.columns) < set(back.columns)
    assert {(r.doc_id, r._shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in assigned.collect()}


def test_written_files_keep_columns_with_clashing_names(spark, tmp_path):
    docs = documents(spark, rows(40)).selectExpr("*", "doc_id AS _crc", "'x' AS _shard", "'y' AS _slot", "1 AS _id", "2 AS _to")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "_shard_"}
    assert sorted(map(tuple, back.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
