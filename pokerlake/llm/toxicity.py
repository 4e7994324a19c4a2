"""Toxicity of whole texts by a convolutional classifier, trained in numpy.

Words (lower case, ASCII punctuation as white space) are looked up in two hashed embedding
tables whose rows are added, filters of several widths run over the text, the maximum of
each filter over the text feeds a logistic layer. Only the text enters a score. Filters do
not reach from one text into the next; a text has padding around it, so an empty one has a
score as well.

The model is fitted on a bounded sample of labelled rows: at most ``MOST_PER_CLASS`` of each
class, those with the smallest hash of their id, with their whole texts; a fifth of the
sample is not fitted. The thresholds by language are set on all labelled rows that are
neither fitted nor held out, scored on the executors and counted in ``BINS`` bins by language
and label; each label of a language weighs as many rows as it has, fitted ones included, so
the classes keep their true shares however many the fit took. A language with too few rows
takes the common threshold. Scoring runs over all texts in the executors, a few megabytes at
a time.

Null texts count as empty. Labels that are null are not used; several labels of an id count
each. Without rows of both classes the score is the share of toxic labels (0.5 without
any), and no threshold is ever reached. Rows with equal or null ids give a row each. Columns of the input other than those
named are passed through or not read, as stated at each function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pokerlake.llm.common import free_name, stored
from pokerlake.llm.words import PLAIN_LOWER, PLAIN_SPACE, U64, text_slices, tidy, word_hashes, words_of

MOST_PER_CLASS = 4_000
LEAST_TOXIC = 20
BINS = 1 << 14
ROWS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 16
PAD = max(WIDTHS) - 1
#: Text whose filter responses, about 200 bytes a word, are held together.
SCORED_BYTES = 512 << 10


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the two tables for each word, first place of each text); row 0 is padding."""
    words = words_of(texts, PLAIN_SPACE, PLAIN_LOWER)
    hashes = word_hashes(words)
    n = np.diff(words.first) + PAD
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    ids = np.zeros((int(starts[-1]) + PAD, 2), np.int32)
    at = np.arange(len(hashes)) + PAD * (words.documents + 1)
    ids[at, 0] = (hashes % U64(ROWS - 1)).astype(np.int32) + 1
    ids[at, 1] = ((hashes >> U64(32)) % U64(ROWS - 1)).astype(np.int32) + 1
    return ids, starts[:-1]


@dataclass
class TextCnn:
    tables: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    top: np.ndarray
    top_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int) -> TextCnn:
        draw = np.random.default_rng(seed)
        tables = [draw.normal(0, 0.05, (ROWS, DIM)).astype(np.float32) for _ in range(2)]
        for table in tables:
            table[0] = 0
        filters = [draw.normal(0, 0.4 / width**0.5, (width * DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(tables, filters, np.zeros(n, np.float32), draw.normal(0, 0.3, n).astype(np.float32), 0.0)

    def responses(self, ids: np.ndarray) -> list[np.ndarray]:
        """Response of each filter at each place; a filter reads the place and those before it."""
        vectors = self.tables[0][ids[:, 0]] + self.tables[1][ids[:, 1]]
        n = len(ids) - PAD
        out = []
        for width, weights in zip(WIDTHS, self.filters, strict=True):
            sums = np.zeros((n, FILTERS), np.float32)
            for j in range(width):
                low = PAD - j
                sums += vectors[low : low + n] @ weights[j * DIM : (j + 1) * DIM]
            out.append(sums)
        return out

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        best = np.concatenate([np.maximum.reduceat(r, starts, axis=0) for r in self.responses(ids)], axis=1)
        return np.maximum(best + self.bias, 0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        ids, starts = encoded(texts)
        return _sigmoid(self.pooled(ids, starts).astype(np.float64) @ self.top.astype(np.float64) + self.top_bias)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name: str, values: np.ndarray, gradient: np.ndarray, rows=None) -> None:
        seen = self.seen.setdefault(name, np.full(values.shape if rows is None else (len(values), 1), 1e-4, np.float32))
        if rows is None:
            seen += gradient**2
            values -= self.rate * gradient / np.sqrt(seen)
        else:  # each row of a table once
            rows, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(rows), values.shape[1]), np.float32)
            np.add.at(total, where, gradient)
            seen[rows] += (total**2).mean(axis=1, keepdims=True)
            values[rows] -= self.rate * total / np.sqrt(seen[rows])
            values[0] = 0


def fit(texts: list[str], labels: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.1, seed: int = 11) -> TextCnn:
    """Logistic loss, classes weighted alike; the gradient runs through the places of the maxima."""
    model, draw, optimizer = TextCnn.fresh(seed), np.random.default_rng(seed), _Adagrad(rate)
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ids, starts = encoded(pa.array([texts[i] for i in rows], pa.string()))
            responses = model.responses(ids)
            best = [np.maximum.reduceat(r, starts, axis=0) for r in responses]
            hidden = np.maximum(np.concatenate(best, axis=1) + model.bias, 0)
            score = _sigmoid(hidden @ model.top + model.top_bias)
            wrong = ((score - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = np.outer(wrong, model.top) * (hidden > 0)
            owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(ids) - PAD)))
            table_rows, table_grads, filter_grads = [], [], []
            for k, (width, r) in enumerate(zip(WIDTHS, responses, strict=True)):
                place, column = np.nonzero(r == best[k][owner])
                cell = owner[place] * FILTERS + column
                cell, first = np.unique(cell, return_index=True)
                place, column = place[first], column[first]
                flow = back[cell // FILTERS, k * FILTERS + column][:, None]
                grad = np.zeros_like(model.filters[k])
                for j in range(width):
                    word = ids[place + PAD - j]
                    vectors = model.tables[0][word[:, 0]] + model.tables[1][word[:, 1]]
                    part = np.zeros((FILTERS, DIM), np.float32)
                    np.add.at(part, column, flow * vectors)
                    grad[j * DIM : (j + 1) * DIM] = part.T
                    table_rows.append(word)
                    table_grads.append(flow * model.filters[k][j * DIM : (j + 1) * DIM].T[column])
                filter_grads.append(grad)
            table_rows, table_grads = np.concatenate(table_rows), np.concatenate(table_grads)
            for t in range(2):
                optimizer.step(f"table{t}", model.tables[t], table_grads, table_rows[:, t])
            for k, grad in enumerate(filter_grads):
                optimizer.step(f"filter{k}", model.filters[k], grad)
            optimizer.step("bias", model.bias, back.sum(axis=0))
            optimizer.step("top", model.top, hidden.T @ wrong)
            bias = np.array([model.top_bias], np.float32)
            optimizer.step("top_bias", bias, np.array([wrong.sum()], np.float32))
            model.top_bias = float(bias[0])
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Middle between the scores where F1 is largest; of equal ones the one nearest 0.5."""
    order = np.argsort(-scores, kind="stable")
    weights = np.ones(len(scores)) if weights is None else weights[order]
    scores, labels = scores[order], labels[order]
    hits = np.cumsum(labels * weights)
    f1 = 2 * hits / (np.cumsum(weights) + (labels * weights).sum())
    after = np.append(scores[1:], 0.0)
    usable = np.flatnonzero((scores > after) & (f1 >= f1[scores > after].max() - 1e-12)) if (scores > after).any() else np.zeros(0, int)
    if not len(usable):
        return 0.5
    middle = (scores[usable] + after[usable]) / 2
    return float(middle[np.argmin(np.abs(middle - 0.5))])


def calibrate(model: TextCnn, scores: np.ndarray, labels: np.ndarray, langs: list[str | None], least: int = LEAST_TOXIC) -> None:
    """Thresholds by language; below ``least`` toxic rows of a language the common threshold holds."""
    model.threshold = best_threshold(scores, labels) if 0 < labels.sum() < len(labels) else 0.5
    names = [str(x) for x in langs]
    for name in sorted(set(names)):
        own = np.array([n == name for n in names])
        if least <= labels[own].sum() < own.sum():
            model.thresholds[name] = best_threshold(scores[own], labels[own])


def _threshold_of(bins: pd.DataFrame) -> pd.DataFrame:
    """A row (lang, threshold, toxic, clean) for the bins of a language: threshold and unfitted rows of each label."""
    free = bins.groupby("toxic").free.sum().reindex([0, 1], fill_value=0)
    threshold = 0.5
    if free.min() > 0:
        own = bins[bins.free > 0]
        labels = own.toxic.to_numpy()
        weight = (bins.groupby("toxic").rows.sum() / free)[[0, 1]].to_numpy()[labels]
        threshold = best_threshold((own.bin.to_numpy() + 0.5) / BINS, labels, own.free.to_numpy() * weight)
    return pd.DataFrame({"lang": [bins.lang.iloc[0]], "threshold": [threshold], "toxic": [int(free[1])], "clean": [int(free[0])]})


def calibrate_on(model: TextCnn, docs: DataFrame, usable: DataFrame, fitted: list[int], least: int = LEAST_TOXIC) -> None:
    """As ``calibrate``, on all rows of ``docs`` that ``usable`` labels, except those with an id that was fitted.

    A row per language comes back to the driver.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(i,) for i in sorted(set(fitted))], StructType([StructField("_fitted", docs.schema["doc_id"].dataType)]))  # at most 2 * most_per_class
    rows = scored(docs.filter(remainder() != 0).select("doc_id", "text", F.coalesce("lang", F.lit("None")).alias("lang")), model).drop("text")
    number = F.least(F.floor(F.col("_score") * BINS), F.lit(BINS - 1)).cast("int")
    joined = rows.join(usable, "doc_id").join(F.broadcast(known), F.col("doc_id") == F.col("_fitted"), "left")
    bins = joined.groupBy("lang", "toxic", number.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.isnull("_fitted")).alias("free"))
    bins = stored(bins, "bins")
    whole = bins.groupBy(F.lit(None).cast("string").alias("lang"), "toxic", "bin").agg(F.sum("rows").alias("rows"), F.sum("free").alias("free"))
    found = bins.unionByName(whole).groupBy("lang").applyInPandas(_threshold_of, "lang string, threshold double, toxic long, clean long")
    for r in found.filter(F.isnull("lang") | ((F.col("toxic") >= least) & (F.col("clean") > 0))).orderBy("lang").collect():
        if r.lang is None:
            model.threshold = r.threshold
        else:
            model.thresholds[r.lang] = r.threshold


def remainder(doc_id: str = "doc_id", parts: int = 5) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % parts


def train(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS, seed: int = 11) -> TextCnn:
    """Fit on a sample of the labelled rows whose id has a CRC not divisible by five, thresholds on the others."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(remainder() != 0).filter("toxic IN (0, 1)")
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = [usable.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(most_per_class) for c in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * most_per_class rows of two numbers
    rows = docs.select("doc_id", "text", "lang").join(sample, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    y = np.array([r.toxic for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        model = TextCnn.fresh(seed)
        model.top[:] = 0
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        model.top_bias = float(np.log(share / (1 - share)))
        model.threshold = 2.0
        return model
    check = np.random.default_rng(seed).permutation(len(rows)) < len(rows) // 5
    texts = [r.text for r in rows]
    learn = np.flatnonzero(~check)
    if y[learn].min() == y[learn].max():
        learn = np.arange(len(rows))
    model = fit([texts[i] for i in learn], y[learn], seed=seed)
    fitted = [rows[i].doc_id for i in learn] if len(learn) < len(rows) else []  # where all were fitted, all are counted
    calibrate_on(model, docs, usable, fitted)
    return model


def scored(docs: DataFrame, model: TextCnn, column: str = "_score") -> DataFrame:
    """All columns of ``docs`` and the score as ``column``, a name that ``docs`` must not have."""
    if column != free_name(docs, column):
        raise ValueError(f"the input has a column {column}")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    at = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(part) for _, part in text_slices(batch.column(at), SCORED_BYTES)]
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def is_toxic(model: TextCnn, score: str = "_score", lang: str = "lang") -> Column:
    """The decision by the threshold of the row's language."""
    limit = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        limit = F.when(F.coalesce(F.col(lang), F.lit("None")) == name, F.lit(value)).otherwise(limit)
    return F.col(score) >= limit
