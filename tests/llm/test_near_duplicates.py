import itertools
import random

import numpy as np
import pytest

from pokerlake.llm import near_duplicates as nd
from tests.llm.frames import EDGES, components, documents, probability_jaccard, weighted


def families():
    draw = random.Random(8)
    rows = []
    for _ in range(12):
        words = [f"n{draw.randint(0, 4_000)}" for _ in range(draw.choice([8, 60, 150]))]
        if draw.random() < 0.3:
            words = words[:20] * 4
        rows.append(" ".join(words))
        for _ in range(draw.randint(0, 6)):
            copy = list(words)
            for at in draw.sample(range(len(copy)), draw.choice([0, 1, 2, 4])):
                copy[at] = f"m{draw.randint(0, 10**6)}"
            rows.append(" ".join(copy))
    draw.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [2, 512])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = families()
    sets = {i: weighted(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if probability_jaccard(sets[a], sets[b]) >= 0.8]
    expected = components(list(sets), pairs)
    got = {r.doc_id: r.class_id for r in nd.classes(documents(spark, rows)).collect()}
    assert len(pairs) > 10
    assert got == expected


def test_estimate_and_exact_value():
    draw = np.random.default_rng(9)
    errors = []
    for _ in range(30):
        pool = np.sort(draw.integers(0, 2**63, 300).astype(np.uint64))
        a, b = pool[:260], pool[draw.integers(0, 120) :]
        wa, wb = (draw.integers(1, 4, len(x)).astype(float) for x in (a, b))
        owner = np.repeat([0, 1], [len(a), len(b)])
        marks = nd.prob_min_hash(2, owner, np.concatenate([a, b]), np.concatenate([wa, wb]))
        exact = nd.probability_jaccard(a, wa, b, wb)
        slow = probability_jaccard(dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True)))
        assert exact == pytest.approx(slow)
        errors.append((marks[0] == marks[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_edge_rows(spark):
    got = nd.classes(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    classes = {(r.doc_id, r.class_id, r.kept) for r in got}
    assert (7, 6, False) in classes and (6, 6, True) in classes and (None, None, True) in classes
    assert all(r.kept for r in got if r.doc_id not in (7,))
    assert nd.classes(documents(spark, EDGES).limit(0)).collect() == []
