import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pokerlake.llm import toxicity as tx
from tests.llm.frames import EDGES, documents

BAD = ["grubble", "snark", "vexit"]


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(1_500):
        words = [f"w{draw.randint(0, 3000)}" for _ in range(draw.randint(3, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(draw.randint(0, len(words)), draw.choice(BAD).upper() + draw.choice(["", ".", ","]))
        rows.append((i, " ".join(words), draw.choice(["en", "de"]), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_inputs(spark, labelled):
    rows, labels = labelled
    model = tx.train(documents(spark, rows), label_table(spark, labels))
    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0]
    got = {r.doc_id: r for r in tx.scored(documents(spark, rows), model, "p").withColumn("bad", tx.is_toxic(model, "p")).collect()}
    truth = np.array([labels[i][2] for i in held])
    for decided in (np.array([got[i].p >= 0.5 for i in held]), np.array([got[i].bad for i in held])):
        assert (decided == truth).mean() > 0.95
    # Labels of held-out rows and columns other than the text change nothing.
    other = [(i, t, "xx", "zz") for i, t, *_ in rows]
    flipped = [(i, q, 1 - t if i in set(held) else t) for i, q, t in labels]
    again = tx.train(documents(spark, rows, 5), label_table(spark, flipped))
    scores = {r.doc_id: r.p for r in tx.scored(documents(spark, other), again, "p").collect()}
    assert all(abs(scores[i] - got[i].p) < 1e-9 for i in scores)


def test_scores_of_a_text_do_not_depend_on_its_neighbours():
    model = tx.TextCnn.fresh(1)
    texts = ["", "a b", None, "c", "d e f g " * 100]
    alone = [model.scores(pa.array([t or ""], pa.string()))[0] for t in texts]
    assert np.allclose(model.scores(pa.array([t or "" for t in texts])), alone)


def test_gradient_lowers_the_loss():
    texts, y = ["good day", "snark off", "fine words here", "you snark"] * 20, np.array([0, 1, 0, 1] * 20, np.float32)
    scores = tx.fit(texts, y, epochs=8, batch=8).scores(pa.array(texts))
    assert ((scores >= 0.5) == y).all()


def test_thresholds():
    assert tx.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    model = tx.TextCnn.fresh(1)
    scores, y = np.array([0.9, 0.2] * 30 + [0.7, 0.6] * 30), np.array([1, 0] * 60)
    tx.calibrate(model, scores, y, ["en"] * 60 + ["de"] * 60)
    assert model.thresholds["de"] == pytest.approx(0.65) and model.thresholds["en"] == pytest.approx(0.55)


def test_edge_rows(spark):
    none = label_table(spark, [(1, 1, None)])
    model = tx.train(documents(spark, EDGES), none)
    got = tx.scored(documents(spark, EDGES), model, "p")
    assert got.columns == [*documents(spark, EDGES).columns, "p"]
    assert len(got.collect()) == len(EDGES) and all(abs(r.p - 0.5) < 1e-9 for r in got.collect())
    assert tx.scored(documents(spark, EDGES).limit(0), model, "p").collect() == []
    one = tx.train(documents(spark, EDGES), label_table(spark, [(i, 1, 1) for i in (4, 5, 6, 7, 8)]))
    assert all(r.p > 0.9 for r in tx.scored(documents(spark, EDGES), one, "p").collect())


def test_thresholds_follow_the_true_shares_of_the_classes(spark):
    """A third of the toxic rows look like a fifth of the clean ones, which are nine times as many."""
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(2_000):
        words = [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(5, 20))]
        toxic = i % 10 == 0
        if toxic and i % 30:
            words.append("snark")
        elif toxic or i % 5 == 1:
            words.append("murky")
        draw.shuffle(words)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    used = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5]
    for most in (100, 4_000):  # capped classes of one size, all rows
        model = tx.train(documents(spark, rows), label_table(spark, labels), most)
        scores = model.scores(pa.array([rows[i][1] for i in used]))
        truth = np.array([labels[i][2] for i in used])
        f1 = lambda limit: 2 * truth[scores >= limit].sum() / ((scores >= limit).sum() + truth.sum())
        assert model.thresholds.keys() == {"en"} and model.thresholds["en"] == model.threshold
        assert f1(model.threshold) > 0.95 * max(f1(s) for s in scores)


def test_weights_and_bins():
    scores, y = np.array([0.9, 0.5, 0.5, 0.1]), np.array([1, 1, 0, 0])
    assert tx.best_threshold(scores, y, np.array([2, 1, 1, 9])) == pytest.approx(0.3)
    assert tx.best_threshold(scores, y, np.array([2, 1, 9, 9])) == pytest.approx(0.7)
