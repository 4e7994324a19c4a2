import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pokerlake.llm import periodic_runs as pr
from tests.llm.frames import EDGES, documents, words


def brute_runs(w, exponent=4, length=6):
    """Every period, every stretch, word by word."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(length, exponent * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, z, q) for (s, z), q in found.items())


def plant(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, w):
    runs = brute_runs(w)
    gone = {i for s, z, q in runs for i in range(s + q, s + z)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{z},{q}\n" for s, z, q in runs)),
        digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def texts(seed, n=150):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        w = [draw.choice("ab" if k % 3 else "abcdefghij") for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            at, unit = draw.randint(0, len(w)), [draw.choice("abc") for _ in range(draw.randint(1, 9))]
            w[at:at] = (unit * 9)[: draw.randint(3, 9) * len(unit) + draw.randint(0, len(unit) - 1)]
        out.append(w)
    return out


def coded(lists):
    names = {}
    codes = np.array([names.setdefault(x, len(names)) for w in lists for x in w], np.int64)
    return codes, np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)


def found_runs(lists, exponent, length):
    out = [[] for _ in lists]
    for d, *run in zip(*pr.runs_of(*coded(lists), exponent, length), strict=True):
        out[d].append(tuple(int(x) for x in run))
    return out


@pytest.mark.parametrize(("exponent", "length"), [(4, 6), (2, 1), (3, 10)])
def test_runs_equal_brute_force(exponent, length):
    lists = texts(exponent) + [list("a" * 400), [], ["x"], list("ab" * 300 + "c" + "ab" * 300), [str(i) for i in range(50)] * 5]
    assert found_runs(lists, exponent, length) == [brute_runs(w, exponent, length) for w in lists]


def test_small_chunks_of_points(monkeypatch):
    monkeypatch.setattr(pr, "POINTS", 7)
    lists = texts(9, 40)
    assert found_runs(lists, 4, 6) == [brute_runs(w) for w in lists]


@pytest.mark.parametrize("n", range(290, 304))
def test_extensions(n):
    draw = random.Random(n)
    codes = np.array([0] + [1 + draw.randrange(2) for _ in range(n)] + [1, 2, 1, 1, 2] * 60 + [9])
    lce = pr.Extensions(codes)
    i, j = (np.array([draw.randrange(1, len(codes)) for _ in range(3000)]) for _ in range(2))
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i, j, lce(i, j), strict=True):
        n = 0
        while max(a, b) + n < len(codes) and codes[a + n] == codes[b + n]:
            n += 1
        assert got == n


def test_words_that_share_a_polynomial_hash():
    a = "a"
    for _ in range(11):  # equal hashes modulo 2 ** 64
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    got = pr.word_codes(pr.words_of(pr.pa.array([f"{a} {b} {a}", f"{b}\t{a}"])))
    assert got.tolist() == [0, 1, 0, 1, 0]


def test_documents(spark):
    edges = [(i, " ".join(t.split(" ")[:3000]) if t else t, *rest) for i, t, *rest in EDGES]
    rows = [(i, random.Random(i).choice([" ", "\n\t"]).join(w)) for i, w in enumerate(texts(1))] + edges + [(500, "é " * 50 + " z"), (10**17, "u v w x y " * 30)]
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    got = pr.periodic_runs(documents(spark, rows), seed, with_runs=True, with_text=True).collect()
    want = [expected(r[0], plant(words(r[1]), r[0])) for r in rows]
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)
    assert any(plant(words(r[1]), r[0]) != words(r[1]) for r in rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[500].collapsed == "é z" and [tuple(x) for x in by_id[500].runs] == [(0, 50, 1)]
    plain = {r.doc_id: r for r in pr.periodic_runs(documents(spark, rows)).collect()}
    assert tuple(plain[10**17])[2:6] == (0, 150, 5, 30000)


def test_empty_table_and_parameters(spark):
    assert pr.periodic_runs(documents(spark, EDGES).limit(0)).collect() == []
    with pytest.raises(ValueError):
        pr.periodic_runs(documents(spark, EDGES), exponent=1)
