import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pokerlake.llm import merkle
from tests.llm.frames import EDGES, documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    n = row["n_chars"]
    return h(field(row["doc_id"]), field(row["source"]), field(row["lang"]), field(n if n is None else n + more), field(row["text"]))


def climb(nodes, proofs):
    """Combine (digest, members) pairs to one, appending siblings to the members' proofs."""
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for k, (_, members) in enumerate(run):
                for m in members:
                    proofs[m] += [(other, k > 0) for j, (other, _) in enumerate(run) if j != k] or [(None, False)]
            above.append((h(*[d for d, _ in run]), [m for _, ms in run for m in ms]))
        nodes = above
    return nodes[0]


def fold(digest, proof):
    for other, left in proof:
        digest = h(digest) if other is None else h(other, digest) if left else h(digest, other)
    return digest


def expected(rows, tampered):
    by_lang = {}
    for i, r in enumerate(rows):
        by_lang.setdefault(r["lang"], []).append(i)
    proofs = [[] for _ in rows]
    subroot, tops = {}, []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        ids = sorted(by_lang[lang], key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, leaf(rows[i])))
        tops.append(climb([(leaf(rows[i]), [i]) for i in ids], proofs))
        subroot[lang] = tops[-1][0]
    root = climb(tops, proofs)[0]
    out = []
    for r, proof in zip(rows, proofs, strict=True):
        folded = fold(leaf(r, 1 if tampered(r) else 0), proof)
        out.append((r["doc_id"], leaf(r), subroot[r["lang"]], root, h(*[d for d, _ in proof if d]), folded, folded == root))
    return sorted(out, key=str)


def seven(row):
    return row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0


def check(spark, docs):
    got = [tuple(r) for r in merkle.manifest(docs, merkle.tampered_rows()).collect()]
    want = expected([r.asDict() for r in docs.collect()], seven)
    assert sorted(got, key=str) == want
    return got


def test_equals_brute_force_at_every_size(spark):
    for sizes in ([1], [2], [3, 1], [1, 1, 1], [5, 4, 2, 1, 1], [255], [256, 3], [257, 600]):
        rows = [(i * 10 + k, f"text {i} {k}", None if k == 1 else f"l{k}é", f"s{i % 3}") for k, n in enumerate(sizes) for i in range(n)]
        check(spark, documents(spark, rows))


@pytest.mark.parametrize("stride", [1, 3])
def test_strides_change_no_digest(spark, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    check(spark, documents(spark, [(i, f"text {i}", f"l{i % 11 % 3}") for i in range(40)]))


def test_many_trees(spark):
    rows = [(i, f"text {i}", f"l{i % 300}") for i in range(700)]
    got = check(spark, documents(spark, rows))
    assert {r[6] for r in got} == {True, False}


def test_edge_rows(spark):
    got = check(spark, documents(spark, EDGES + [EDGES[5]] * 20))
    assert len(got) == len(EDGES) + 20
    assert merkle.manifest(documents(spark, EDGES).limit(0)).collect() == []
    assert all(r.verified for r in merkle.manifest(documents(spark, EDGES)).collect())


def test_no_tampering_without_a_count(spark):
    docs = documents(spark, [(i, "t", "en") for i in range(40)]).withColumn("n_chars", F.lit(None).cast("long"))
    assert all(r[6] for r in check(spark, docs))


def test_settings_and_views_are_restored(spark):
    before = spark.conf.get(merkle.ROWS_LIMIT)
    merkle.manifest(documents(spark, EDGES)).collect()
    assert spark.conf.get(merkle.ROWS_LIMIT) == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("merkle_")]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 255, 256, 257])
def test_depth(spark, n):
    levels, m = 0, n
    while m > 1:
        levels, m = levels + 1, (m + 1) // 2
    assert spark.range(1).select(merkle._depth(F.lit(n))).first()[0] == levels
