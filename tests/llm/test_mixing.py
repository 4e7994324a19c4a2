import numpy as np

from pokerlake.llm import mixing
from tests.llm.frames import EDGES, documents, words


def test_targets_share_the_excess():
    sizes = np.array([10.0, 100.0, 1000.0, 0.0])
    target = mixing.targets(sizes, np.array([5.0, 2.0, 1.0, 5.0]), 1.5 * sizes.sum(), 2)
    assert np.allclose(target, [20, 200, 1445, 0])


def test_tree_splits_whole_quotas():
    quotas = np.array([7, 0, 1000, 13])
    split = mixing.split_quotas(quotas, 5, 1)
    assert (split.sum(axis=0) == quotas).all() and (split >= 0).all()
    assert split.sum(axis=1).max() - split.sum(axis=1).min() <= 2
    assert (split == mixing.split_quotas(quotas, 5, 1)).all()


def rows():
    return [(i, "w " * (1 + i * 7 % 23), "en", [None, "b", "a", "c"][min(3, i % 7)]) for i in range(900)]


def test_sources_reach_their_targets(spark):
    data = rows()
    got = mixing.taken_words(documents(spark, data)).collect()
    by_id = {r.doc_id: r for r in got}
    order = sorted({d[3] for d in data}, key=lambda s: (s is None, s or ""))
    sizes = np.array([sum(len(words(d[1])) for d in data if d[3] == s) for s in order], float)
    target = mixing.targets(sizes, np.array([5.0, 2, 1, 5]), 1.5 * sizes.sum(), 2)
    for source, size, goal in zip(order, sizes, target, strict=True):
        own = [by_id[d[0]] for d in data if d[3] == source]
        assert {r.source_size for r in own} == {size} and np.allclose([r.target for r in own], goal)
        assert abs(sum(r.taken for r in own) - goal) <= 0.01 * size + 23
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken_words(documents(spark, data, 5)).collect()))


def test_mix_has_the_draws(spark):
    docs = documents(spark, rows())
    taken = {r.doc_id: r.taken // r.size for r in mixing.taken_words(docs).collect()}
    mix = mixing.mixed(docs, shards=4).collect()
    assert {i: n for i, n in taken.items() if n} == {i: sum(r.row.doc_id == i for r in mix) for i in {r.row.doc_id for r in mix}}
    assert {r.shard for r in mix} == {0, 1, 2, 3}


def test_edge_rows(spark):
    got = mixing.taken_words(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.taken_words(documents(spark, EDGES).limit(0)).collect() == []
    assert mixing.mixed(documents(spark, EDGES).limit(0)).collect() == []
    empty = documents(spark, [(1, None, "en", "a"), (2, "", "en", "b")])
    assert sorted(r.taken for r in mixing.taken_words(empty).collect()) == [0, 0]


def shared(sizes, weights, total, most):
    """Targets by plain arithmetic: raise a common level per weight until the total is reached."""
    low, high = 0.0, total
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * w, most * s) for s, w in zip(sizes, weights, strict=True)) < total:
            low = level
        else:
            high = level
    return [min(high * w, most * s) for s, w in zip(sizes, weights, strict=True)]


def test_null_and_repeated_ids_reach_the_target(spark):
    data = [(None if i < 950 else i, f"{'w ' * 19}{i}", "en", "a") for i in range(1000)]
    data += [(7, "same " * 20, "en", "b")] * 1000 + [(10_000 + i, "v " * 20, "en", "c") for i in range(400)]
    got = mixing.taken_words(documents(spark, data)).collect()
    sizes = [20_000, 20_000, 8_000]
    for (name, texts), size, goal in zip({"a": 1000, "b": 1000, "c": 400}.items(), sizes, shared(sizes, [5, 2, 1], 72_000, 2), strict=True):
        own = [r for r in got if abs(r.target - goal) < 1 and r.source_size == size]
        assert len(own) == texts, name
        assert abs(sum(r.taken for r in own) - goal) <= 0.02 * size, name


def test_taken_words_come_from_the_shards_of_the_tree(spark):
    docs = documents(spark, rows())
    got = mixing.taken_words(docs, shards=4).collect()
    assert all(r.taken == r.size * len(r.shards) for r in got)
    placed = {}
    for r in mixing.mixed(docs, shards=4).collect():
        placed.setdefault(r.row.doc_id, []).append(r.shard)
    assert {r.doc_id: r.shards for r in got if r.shards} == {i: sorted(x) for i, x in placed.items()}


def test_many_sources(spark):
    data = [(i, "w " * (1 + i % 3), "en", f"s{i:05d}") for i in range(3_000)]
    got = mixing.taken_words(documents(spark, data)).collect()
    want = shared([1 + i % 3 for i in range(3_000)], [[5, 2, 1][i % 3] for i in range(3_000)], 1.5 * sum(1 + i % 3 for i in range(3_000)), 2)
    assert np.allclose([r.target for r in sorted(got)], want)


def test_order_inside_shards(spark):
    mix = mixing.mixed(documents(spark, rows()), shards=3)
    got = [(r.shard, r.place) for r in mixing.in_order(mix).collect()]
    assert got == sorted(got) and len({s for s, _ in got}) == 3


def test_written_shards(spark, tmp_path):
    mix = mixing.mixed(documents(spark, rows()), shards=3)
    mixing.write_shards(mix, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mix.count()
