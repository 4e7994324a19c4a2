import numpy as np
import pytest

from pokerlake.llm import embedding_links as el
from tests.llm.frames import components


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string, copies string").repartition(3)


def clusters(n=40, dim=16):
    draw = np.random.default_rng(2)
    rows = []
    for c in range(n):
        centre = draw.normal(size=dim)
        for _ in range(draw.integers(1, 6)):
            rows.append((len(rows), centre + draw.normal(size=dim) * draw.choice([0.02, 0.25, 0.4])))
    return rows + [(len(rows), rows[0][1]), (len(rows) + 1, rows[0][1])]


@pytest.mark.parametrize(("block", "piece", "dim"), [(3, 2_000, 16), (512, 2_000, 16), (512, 3, 16), (512, 2_000, 3)])
def test_equals_brute_force(spark, monkeypatch, block, piece, dim):
    monkeypatch.setattr(el, "BLOCK", block)
    monkeypatch.setattr(el, "PIECE", piece)
    rows = clusters(dim=dim)
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    component = components(ids, list(zip(*np.nonzero(near), strict=True)))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in el.links(table(spark, rows)).collect()}
    assert near.sum() > 50
    assert got == {i: (int(near[k].sum()), component[i], component[i] == i) for k, i in enumerate(ids)}


def test_edge_rows(spark):
    rows = [(1, None), (2, [0, 0]), (3, [float("nan"), 1]), (4, [float("inf"), 1]), (5, []), (None, [1, 0]), (6, [1, 0]), (7, [2, 0]), (8, [1, 0, 0]), (6, [1, 0])]
    got = sorted((tuple(r) for r in el.links(table(spark, rows)).collect()), key=str)
    lone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 8)] + [(None, 0, None, True)]
    assert got == sorted(lone + [(6, 2, 6, True), (6, 2, 6, True), (7, 2, 6, False)], key=str)
    assert el.links(table(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("dim", [2, 3, 4, 5, 8, 64, 256, 1024])
def test_rotation_keeps_lengths_and_buckets_recall(dim):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(el.hadamard(x) / 8, axis=1), np.linalg.norm(x, axis=1))
    k, tables = el.parameters(50_000, dim)
    a = draw.normal(size=(2_000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    u = draw.normal(size=a.shape)
    u -= (u * a).sum(axis=1)[:, None] * a
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * u / np.linalg.norm(u, axis=1)[:, None]
    (own_a, probe_a), (own_b, probe_b) = (el.buckets(v, k, tables, 5) for v in (a, b))
    met = (own_a == own_b) | (probe_a == own_b[:, :, None]).any(axis=2) | (probe_b == own_a[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() > 0.995
