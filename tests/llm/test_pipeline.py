"""The pipeline's stages against brute force, each on its own input."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pokerlake.llm import mixing, queries, toxicity
from pokerlake.llm.common import stored
from tests.llm.frames import EDGES, components, documents, probability_jaccard, weighted, words

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage on the smallest tables."""
    out, docs = {}, spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, FOLDER))
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def test_columns(spark, steps):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == list(steps) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert all(steps[name][2] == columns for name in list(steps)[:-1])


def test_toxic_documents_go(spark, steps):
    before, after, _ = steps["toxicity"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    import pyarrow as pa

    stay = {r.doc_id for r in before if model.scores(pa.array([r.text or ""]))[0] < model.thresholds.get(str(r.lang), model.threshold)}
    assert {r.doc_id for r in after} == stay


def test_one_of_each_group_stays(steps):
    before, after, _ = steps["near_duplicates"]
    sets = {r.doc_id: weighted(r.text) for r in before}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a].keys() & sets[b].keys() and probability_jaccard(sets[a], sets[b]) >= 0.8]
    assert {r.doc_id for r in after} == set(components(list(sets), pairs).values())


def test_documents_with_benchmark_items_go(spark, steps):
    before, after, _ = steps["decontamination"]
    plain = lambda t: "".join(c.lower() if not c.isascii() or c.isalnum() else " " for c in t or "").split()
    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in before if any(f" {' '.join(i)} " in f" {' '.join(plain(r.text))} " for i in items)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert whole <= gone
    grams = {tuple(i[k : k + 5]) for i in items for k in range(len(i) - 4)}
    assert all(any(tuple(plain(r.text)[k : k + 5]) in grams for k in range(len(plain(r.text)))) for r in before if r.doc_id in gone)


def test_mix_reaches_its_targets(steps):
    before, after, _ = steps["mixing"]
    order = sorted({r.source for r in before}, key=lambda s: (s is None, s or ""))
    size = lambda rows, s: sum(len(words(r.text)) for r in rows if r.source == s)
    sizes = np.array([size(before, s) for s in order], float)
    target = mixing.targets(sizes, np.array([(5, 2, 1)[i % 3] for i in range(len(order))], float), 1.5 * sizes.sum(), 2)
    for s, goal in zip(order, target, strict=True):
        assert abs(size(after, s) - goal) <= max(len(words(r.text)) for r in before if r.source == s) / 2 + 1
    assert max(sum(r.doc_id == i for r in after) for i in {r.doc_id for r in after}) <= 2


def test_token_files_hold_the_mix(steps):
    before, after, _ = steps["token_files"]
    library, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(before, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after), key=lambda r: r[1]) == expected


def test_stages_take_edge_rows_and_keep_all_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns; then no rows at all."""
    folder = str(tmp_path)
    spark.createDataFrame([(5, 1, 1), (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "six little words stand right here and some more of them")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    given = documents(spark, EDGES)
    for docs in (given, given.limit(0)):
        docs = docs.withColumn("_score", F.col("size"))
        columns, rows = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, folder))
            assert name == "token_files" or docs.columns == columns
            assert docs.count() <= 2 * rows
            if name == "near_duplicates" and rows:
                assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, 2, 3, 4, 5, 6, 8, None]


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in queries.QUERIES if name != "pipeline"}
