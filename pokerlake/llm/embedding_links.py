"""Near-equal embeddings by cross-polytope hashing after fast Hadamard rotations.

A vector is turned by three rounds of random signs and a Hadamard transform; the hash is the
axis it then lies nearest to, with its sign; vectors of few dimensions are padded first. ``K`` such hashes make the bucket of a table,
and each vector also probes the buckets it misses by least. Vectors that meet in a bucket
are compared by matrix products inside bounded blocks, and every pair is counted only in the
first bucket that it shares, so counts need no list of pairs. A block returns the number of
links of each vector and a spanning forest of them.

``K`` follows the number of vectors, so buckets stay small, and the number of tables follows
``K``, so the chance that a pair at the threshold shares no bucket stays below
``MISSED``. Large buckets are cut into blocks of ``BLOCK`` vectors.

Vectors that are null, all zero, or hold null or non-finite components, and those with a
null id, link with nothing. Vectors of different lengths do not link. Equal vectors are one
class, hashed once. Rows with equal ids are vectors of their own. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.llm.common import components, in_blocks, stored

SIMILARITY = 0.95
BLOCK = 512
PIECE = 2_000
PROBES = 3
#: Vectors are padded to as many dimensions at least: in few the turns would be of a few angles only.
WIDTH = 64
#: Chance that two vectors at the threshold agree in one hash, probes included, measured for ``WIDTH`` dimensions; the target.
SHARED = 0.75
MISSED = 0.0005


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x


def width(dim: int) -> int:
    """Dimensions in which vectors of ``dim`` are turned."""
    return max(WIDTH, 1 << max(0, (dim - 1).bit_length()))


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """Signs of ``count`` rotations of three rounds each."""
    size = width(dim)
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (count, 3, size))


def axes(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest axis, second nearest, by how much the second is farther) of each row."""
    padded = np.zeros((len(x), signs.shape[1]))
    padded[:, : x.shape[1]] = x
    for flip in signs:
        padded = hadamard(padded * flip) / math.sqrt(signs.shape[1])
    size = np.abs(padded)
    rows = np.arange(len(x))
    best = size.argmax(axis=1)
    largest = size[rows, best].copy()
    size[rows, best] = -1
    second = size.argmax(axis=1)
    gap = largest - size[rows, second]
    code = lambda at: 2 * at + (padded[rows, at] < 0)
    return code(best), code(second), gap


def buckets(x: np.ndarray, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(own bucket of each table, probed buckets of each table); numbers differ between tables."""
    signs = rotations(x.shape[1], k * tables, seed)
    own, probed = [], []
    n_axes = 2 * signs.shape[2]
    probes = min(PROBES, k)
    for t in range(tables):
        best, second, gap = (np.stack(v, axis=1) for v in zip(*(axes(x, signs[t * k + i]) for i in range(k)), strict=True))
        place = np.array([n_axes**i for i in range(k)], np.int64)
        main = (best * place).sum(axis=1)
        nearest = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        moved = main[:, None] + np.take_along_axis((second - best) * place, nearest, axis=1)
        own.append(main * tables + t)
        probed.append(moved * tables + t)
    return np.stack(own, axis=1), np.stack(probed, axis=1)


def parameters(vectors: int, dim: int) -> tuple[int, int]:
    """(hashes of a bucket, number of tables) for so many vectors."""
    n_axes = 2 * width(dim)
    k = max(1, min(math.ceil(math.log(max(vectors, 2)) / math.log(n_axes)), 60 // n_axes.bit_length()))
    return k, math.ceil(math.log(MISSED) / math.log(1 - SHARED**k))


def _hash(k: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                n = part.num_rows
                x = part.column("vector").flatten().to_numpy().astype(np.float64).reshape(n, -1)
                own, probed = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), k, tables, seed)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * v[0].size), pa.array(v.reshape(-1))) for v in (own, probed.reshape(n, -1))]
                yield pa.record_batch([*part.columns, *lists], names=["rep", "copies", "vector", "own", "probed"])

    return run


COMPARED = "id long, other long, links long"


def _compare(threshold: float):
    """Links inside the groups of rows sorted by key, low and high, many groups at a time."""

    def compared(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        n = rows.num_rows
        x, own, probed = (rows.column(c).flatten().to_numpy().reshape(n, -1) for c in ("vector", "own", "probed"))
        ids, copies, block, main, key, low, high = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "copies", "block", "main", "key", "low", "high"))
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
        pairs = [np.zeros((2, 0), np.int64)]
        for a, b in zip(starts, np.append(starts[1:], n), strict=True):
            y, own_bucket = x[a:b].astype(np.float64), main[a:b]
            near = np.triu((y @ y.T) / np.outer(norm[a:b], norm[a:b]) >= threshold, 1) & (own_bucket[:, None] | own_bucket[None, :])
            if low[a] != high[a]:
                near &= block[a:b, None] != block[None, a:b]
            if near.any():
                pairs.append(np.stack(np.nonzero(near)) + a)
        i, j = _owned(*np.concatenate(pairs, axis=1), key, own, probed)
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        ends = np.append(starts, n)
        group = np.searchsorted(starts, i, "right") - 1
        trees = [np.zeros((2, 0), np.int64)]
        for g in np.unique(group):
            first, here = ends[g], slice(*np.searchsorted(group, [g, g + 1]))
            trees.append(np.stack(_forest(ends[g + 1] - first, i[here] - first, j[here] - first)) + first)
        a, b = np.concatenate(trees, axis=1)
        some = np.flatnonzero(links)
        other = np.concatenate([np.full(len(some), -1), ids[b]])
        columns = [np.concatenate([ids[some], ids[a]]), pa.array(other, pa.int64(), mask=np.arange(len(other)) < len(some)), np.concatenate([links[some], np.zeros(len(a))]).astype(np.int64)]
        return pa.record_batch([pa.array(c) for c in columns], names=["id", "other", "links"])

    def pieces(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``compared`` for whole groups of about ``PIECE`` rows together."""
        ends, at = np.append(starts[1:], rows.num_rows), 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
            low, high = int(starts[at]), int(ends[stop - 1])
            yield compared(rows.slice(low, high - low), starts[at:stop] - low)
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            names = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")], axis=1)
            starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1])
            if len(starts) > 1:
                yield from pieces(rows.slice(0, int(starts[-1])), starts[:-1])
            held = rows.slice(int(starts[-1]))
        if held is not None:
            yield from pieces(held, np.zeros(1, np.int64))

    return run


def _owned(i: np.ndarray, j: np.ndarray, key: np.ndarray, own: np.ndarray, probed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that met in the first bucket that they share; ``key`` is the bucket of each row."""
    keep = []
    probed = probed.reshape(*own.shape, -1)
    for at in range(0, len(i), 20_000):
        a, b = i[at : at + 20_000], j[at : at + 20_000]
        left, right = own[a], own[b]
        to_right, to_left = (probed[a] == right[:, :, None]).any(axis=2), (probed[b] == left[:, :, None]).any(axis=2)
        shared = np.where(to_right & to_left, np.minimum(left, right), np.where(to_right, right, left))
        met = (left == right) | to_right | to_left
        first = met.argmax(axis=1)
        keep.append(shared[np.arange(len(a)), first] == key[a])
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs, breadth first."""
    linked = np.zeros((n, n), bool)
    linked[i, j] = linked[j, i] = True
    waiting, out = linked.any(axis=1), [np.zeros((2, 0), np.int64)]
    while waiting.any():
        front = np.flatnonzero(waiting)[:1]
        waiting[front] = False
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & waiting)
            out.append(np.stack([new, front[linked[np.ix_(front, new)].argmax(axis=0)]]))
            waiting[new] = False
            front = new
    a, b = np.concatenate(out, axis=1)
    return a, b


def links(embeddings: DataFrame, threshold: float = SIMILARITY, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", number) & F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    classes = stored(rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "vector"), "vectors")
    found = None
    for size, count in [(r[0], r[1]) for r in classes.groupBy(F.size("vector")).count().collect()]:  # a row per vector length
        own = _of_one_length(classes.filter(F.size("vector") == size), *parameters(count, size), threshold, seed)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], COMPARED)
    found = stored(found, "links")
    labels = components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    results = classes.join(counts, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    results = stored(results.select("vector", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component")), "classes")
    joined = rows.join(results, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _of_one_length(classes: DataFrame, k: int, tables: int, threshold: float, seed: int) -> DataFrame:
    schema = "rep long, copies long, vector array<float>, own array<long>, probed array<long>"
    if dict(classes.dtypes)["vector"] == "array<double>":
        schema = schema.replace("float", "double")
    hashed = stored(classes.mapInArrow(_hash(k, tables, seed), schema), "hashed")
    keys = hashed.select("rep", F.explode("own").alias("key"), F.lit(True).alias("main")).unionByName(hashed.select("rep", F.explode("probed").alias("key"), F.lit(False).alias("main")))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("main").alias("any_main")).filter("n > 1 AND any_main").drop("any_main")
    met = keys.join(stored(shared, "buckets"), "key").join(hashed, "rep")
    blocks = in_blocks(met, "key", "n", "rep", BLOCK)
    group = ["key", "low", "high"]
    dealt = blocks.select(*group, "rep", "copies", "vector", "own", "probed", "main", "block").repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_compare(threshold), COMPARED)
