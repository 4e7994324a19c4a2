import collections
import hashlib
import random

import pytest

from pokerlake.llm import substring_dedup as sd
from tests.llm.frames import EDGES, documents, words


def expected(rows, window):
    lists = [words(r[1]) for r in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for w in lists for k in range(len(w) - window + 1))
    out = []
    for row, w in zip(rows, lists, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((row[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(n=60):
    draw = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    passages = [[draw.choice(vocabulary) for _ in range(draw.randint(6, 20))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(0, 25))]
        for p in draw.sample(passages, draw.randint(0, 2)):
            at = draw.randint(0, len(w))
            w[at:at] = p
        rows.append((i, draw.choice([" ", "\n", "  "]).join(w)))
    rows += [(100, "a b c " * 9), (101, "z " * 40), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("hot", [1, 2, 256])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = random_rows()
    got = [tuple(r) for r in sd.dedupe_substrings(documents(spark, rows), window=6, short=3).collect()]
    assert sorted(got, key=str) == expected(rows, 6)


@pytest.mark.parametrize("hot", [1, 256])
def test_words_of_equal_hashes_differ(spark, monkeypatch, hot):
    # A word that doubles by its complement collides with that under every polynomial modulo 2**64.
    monkeypatch.setattr(sd, "HOT", hot)
    word, other = "a", "b"
    while len(word) < 2048:
        word, other = word + other, other + word
    rows = [(i, " ".join([f"w{k}" for k in range(20)] + [x] + [f"w{k}" for k in range(20, 34)])) for i, x in enumerate([word, other])]
    rows += [(9, rows[1][1] + " tail")] * (hot == 1)
    got = [tuple(r) for r in sd.dedupe_substrings(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == expected(rows, 35)


def test_bucket_of_many_strings(spark):
    # One phrase in 10,000 surroundings: copies, shared windows and strings that share the phrase only.
    draw = random.Random(8)
    phrase = "the common phrase of all of these many texts".split()
    sides = [[f"s{draw.randrange(50)}" for _ in range(12)] for _ in range(1500)]
    rows = []
    for i in range(10_000):
        left = draw.choice(sides) if i % 2 else [f"u{i}x{k}" for k in range(12)]
        right = draw.choice(sides) if i % 3 else [f"v{i}x{k}" for k in range(12)]
        rows.append((i, " ".join([*left, *phrase, *right])))
    got = [tuple(r) for r in sd.dedupe_substrings(documents(spark, rows), window=12, short=3).collect()]
    assert sorted(got, key=str) == expected(rows, 12)


def test_edge_rows_and_text(spark):
    rows = EDGES + [(20, "p " * 20 + " ".join(f"q{i}" for i in range(40))), (21, "r " + " ".join(f"q{i}" for i in range(40)))]
    found = sd.dedupe_substrings(documents(spark, rows), with_text=True).collect()
    assert sorted([tuple(r)[:4] for r in found], key=str) == expected(rows, 35)
    assert {r.doc_id: r.kept_text for r in found}[21] == "r"
    assert sd.dedupe_substrings(documents(spark, EDGES).limit(0)).collect() == []


def test_copies_within_a_bucket():
    a = b"1 2 3 4 5 6"
    assert sd.repeated_windows([a, a], 4) == [[(0, 3)], [(0, 3)]]
    assert sd.repeated_windows([a, b"0 2 3 4 5 9"], 4) == [[(1, 2)], [(1, 2)]]
    assert sd.repeated_windows([a], 4) == [[]]
