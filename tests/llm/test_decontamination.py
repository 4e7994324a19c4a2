import random

from pokerlake.llm import decontamination as dc
from tests.llm.frames import EDGES, documents


def items():
    draw = random.Random(6)
    vocabulary = [f"t{i}" for i in range(2_000)]
    long = [(i, " ".join(draw.choice(vocabulary) for _ in range(20 + i))) for i in range(12)]
    return long + [(50, "seven short words stand in this item"), (51, "too few"), (52, None), (53, "")]


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def planted():
    draw = random.Random(7)
    rows, truth = [], {}
    for i, (item, text) in enumerate(items()[:13]):
        words = text.split()
        if item < 12:
            for at in draw.sample(range(len(words)), len(words) // 8):  # an eighth is replaced
                words[at] = "changed"
        filler = [f"f{draw.randint(0, 5_000)}" for _ in range(60)]
        rows.append((i, " ".join(filler[:30]) + ". " + " ".join(words).upper() + ", " + " ".join(filler[30:])))
        truth[i] = (item, 30, 30 + len(words))
        rows.append((100 + i, " ".join(filler)))
        rows.append((200 + i, " ".join(filler[:20] + words[: len(words) // 4] + filler[20:])))  # too little of it
    return rows, truth


def test_finds_planted_items_and_no_others(spark):
    rows, truth = planted()
    for block_words in (1_000_000, 100):
        got = dc.best_matches(documents(spark, rows), table(spark, items())).collect()
        found = {r.doc_id: (r.item_id, r.start, r.end) for r in got}
        assert found.keys() == truth.keys()
        for doc, (item, start, end) in truth.items():
            assert found[doc][0] == item and start <= found[doc][1] <= start + 3 and end - 3 <= found[doc][2] <= end
        marked = dc.marked(documents(spark, rows), table(spark, items()), "mark", block_words)
        assert {r.doc_id for r in marked.filter("mark").collect()} == truth.keys()
        assert marked.columns == [*documents(spark, rows).columns, "mark"]


def test_equals_brute_force_alignment(spark):
    """Every unbroken copy of an item is reported with all of its words, at every place."""
    text = dict(items())[3]
    rows = [(1, f"a {text} b {text}"), (2, text), (2, text), (3, text[: len(text) // 2])]
    got = sorted((r.doc_id, r.start, r.end, r.matched) for r in dc.matches(documents(spark, rows), table(spark, items())).collect())
    n = len(text.split())
    whole = [g for g in got if g[3] == n]
    assert whole == [(1, 1, 1 + n, n), (1, 2 + n, 2 + 2 * n, n), (2, 0, n, n), (2, 0, n, n)]
    assert all(g in whole or g[0] == 3 for g in got)


def test_edge_rows(spark):
    assert dc.matches(documents(spark, EDGES), table(spark, items())).collect() == []
    assert dc.matches(documents(spark, EDGES).limit(0), table(spark, items())).collect() == []
    nothing = table(spark, items()).limit(0)
    assert dc.matches(documents(spark, EDGES), nothing).collect() == []
    assert dc.marked(documents(spark, EDGES), nothing, "mark").filter("mark").collect() == []


def test_best_stretch():
    import numpy as np

    assert dc.best_stretch(np.array([0, 1, 1, 0, 1, 1, 0, 0, 1], bool)) == (1, 6)
    assert dc.best_stretch(np.zeros(0, bool)) == (0, 0)


def test_long_passages_and_pieces_count_whatever_their_share(spark):
    draw = random.Random(8)
    text = lambda n, mark: [f"{mark}{draw.randint(0, 9_999)}x{i}" for i in range(n)]
    long, middle, cut = text(300, "a"), text(59, "b"), text(40, "c")
    benchmark = table(spark, [(1, " ".join(long)), (2, " ".join(middle)), (3, " ".join(cut))])
    pad = text(20, "f")
    pieces = lambda n: [w for i in range(0, 40, n) for w in [*cut[i : i + n], f"new{i}"]]
    rows = [
        (1, pad + long[80:220] + pad, 1, 140, 140 / 300),
        (2, pad + middle[30:55], 2, 25, 25 / 59),
        (3, pad + pieces(14) + pad, 3, 14, 1.0),
        (4, pad + pieces(8) + pad, 3, 8, 1.0),
        (5, long[:30] + text(150, "z") + long[180:], 1, 120, 0.5),
        (6, pad + long[:12] + pad, None, 0, 0.0),
    ]
    docs = documents(spark, [(r[0], " ".join(r[1])) for r in rows])
    got = {r.doc_id: (r.item_id, r.matched, round(r.coverage, 9)) for r in dc.best_matches(docs, benchmark).collect()}
    assert got == {r[0]: (r[2], r[3], round(r[4], 9)) for r in rows if r[2]}
    assert {r.doc_id for r in dc.marked(docs, benchmark, "mark").filter("mark").collect()} == got.keys()
    ends = [(r.start, r.end) for r in dc.matches(docs, benchmark).filter("doc_id = 5").orderBy("start").collect()]
    assert ends == [(0, 30), (180, 300)]


def test_short_items_with_one_word_replaced(spark):
    benchmark, rows, expected = [], [], {}
    for n in range(4, 16):
        item = [f"i{n}w{k}" for k in range(n)]
        benchmark.append((n, " ".join(item)))
        for at in range(n):
            rows.append((100 * n + at, " ".join(["before", *item[:at], "other", *item[at + 1 :], "after"])))
            expected[100 * n + at] = n
        rows.append((100 * n + 50, " ".join(item)))
        rows.append((100 * n + 51, " ".join(item[1:])))
        rows.append((100 * n + 52, " ".join(item[:-1])))
        expected |= {100 * n + k: n for k in (50, 51, 52)}
        rows.append((100 * n + 60, " ".join(["other", *item[1:3], "other", *item[4:5]])))  # three words
    got = {r.doc_id: r.item_id for r in dc.best_matches(documents(spark, rows), table(spark, benchmark)).collect()}
    assert got == {doc: item for doc, item in expected.items() if item >= dc.SHORTEST}
