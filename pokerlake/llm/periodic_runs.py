"""Periodic runs of words: maximal stretches that repeat a period at least ``EXPONENT`` times.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
and a length of at least ``LENGTH`` words and ``EXPONENT * q`` that no neighbouring word
extends keeping period q. Words of a run after its first q are copies and can be collapsed.

Search, in slices of a few megabytes of text, whatever the number of documents in them:

1. Words become exact codes; a separator of its own stands before, between and after documents.
2. For every period q, points a stride of ``(EXPONENT - 1) * q`` apart are looked at, n log n of
   them in a document of n words: a run of period q holds at least one. A point is a candidate if
   enough of its neighbours at steps of q equal their word q further on.
3. A candidate's stretch is measured by two longest common extensions (LCE), forward and backward.
   Only documents with candidates take part. Suffixes at places of a difference cover modulo 13
   are sorted, by 13 words first and then by doubling; an LCE compares at most 12 words until both
   places are in the cover and reads the rest off the neighbours' common prefixes with a sparse
   table for range minima.
4. A stretch found with several periods has the smallest of them.

Nothing is shuffled: a document is handled where it is read, and memory follows a slice or the
longest text. Every row gives a row, repeated ones too; null, empty and blank texts have no words
and no runs. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pokerlake.llm.words import SPACE, Words, text_slices, words_of

EXPONENT = 4
LENGTH = 6
#: A difference cover: every difference modulo 13 is one of two of its members.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Points that are looked at together.
POINTS = 500_000


def word_codes(words: Words) -> np.ndarray:
    """Codes from 0 of the words; equal words, byte by byte, have equal codes."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    offsets = np.zeros(len(words.start) + 1, np.int32)
    np.cumsum(words.end - words.start, out=offsets[1:])
    packed = words.data[~SPACE[words.data]]
    column = pa.Array.from_buffers(pa.binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1)


class Extensions:
    """LCE of two places of ``codes``, which no common stretch may reach the end of."""

    def __init__(self, codes: np.ndarray):
        n, size = len(codes), len(COVER)
        self.codes = np.concatenate([codes, np.full(2 * MODULUS, -1, np.int64)])
        cover = np.full(MODULUS, -1)
        cover[list(COVER)] = np.arange(size)
        both = [[[cover[(x + d) % MODULUS] >= 0 and cover[(y + d) % MODULUS] >= 0 for d in range(MODULUS)].index(True) for y in range(MODULUS)] for x in range(MODULUS)]
        self.cover, self.steps = cover, np.array(both)
        # Place number k * size + c of the sample is k * MODULUS + COVER[c].
        blocks = -(-n // MODULUS)
        places = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).reshape(-1)
        places = np.minimum(places, len(self.codes) - MODULUS)
        self._sort(places, size)

    def _sort(self, places: np.ndarray, size: int) -> None:
        columns = [self.codes[places + k] + 1 for k in range(MODULUS)]
        columns += [np.zeros(len(places), np.int64)] * (len(columns) % 2)
        order = np.lexsort([(a << 32) | b for a, b in zip(columns[-2::-2], columns[::-2], strict=True)])
        new = np.zeros(len(places), bool)
        for column in columns:
            new[1:] |= column[order[1:]] != column[order[:-1]]
        rank = np.empty(len(places), np.int64)
        rank[order] = np.cumsum(new)
        levels, step = [rank], size  # level k ranks stretches of MODULUS << k words
        while step < len(places) and rank.max(initial=0) < len(places) - 1:
            after = np.zeros(len(places), np.int64)
            after[:-step] = rank[step:] + 1
            rank = _ranks(rank * (len(places) + 1) + after)
            levels.append(rank)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(len(places), np.int64)
        self.rank[order] = np.arange(len(places))  # places beyond the end may be equal
        self.table = self._minima(self._prefixes(places, order[:-1], order[1:], levels, size))

    def _prefixes(self, places: np.ndarray, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], size: int) -> np.ndarray:
        """Common prefixes of suffixes next to each other in the order, by their ranks at every level."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        last = len(places) - 1
        for k in range(len(levels) - 1, -1, -1):
            same = (np.maximum(a, b) <= last) & (levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)])
            length += same * (MODULUS << k)
            a += same * (size << k)
            b += same * (size << k)
        x, y = (places[np.minimum(i, last)] for i in (a, b))
        going = np.maximum(a, b) <= last
        for t in range(MODULUS):
            going &= self.codes[x + t] == self.codes[y + t]
            length += going
        return length

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(values):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places ``i`` and ``j`` on; no place of ``i`` is that of ``j``."""
        steps = self.steps[i % MODULUS, j % MODULUS]
        going, same = np.ones(len(i), bool), np.zeros(len(i), np.int64)
        for t in range(MODULUS - 1):
            going &= (t >= steps) | (self.codes[i + t] == self.codes[j + t])
            same += going & (t < steps)
        at = np.flatnonzero(going)
        if len(at):
            size = len(COVER)
            ranks = [self.rank[x // MODULUS * size + self.cover[x % MODULUS]] for x in (i[at] + steps[at], j[at] + steps[at])]
            low, high = np.minimum(*ranks), np.maximum(*ranks)
            level = np.frexp((high - low).astype(float))[1] - 1
            rest = np.empty(len(at), np.int64)
            for k in np.unique(level):
                own = level == k
                rest[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
            same[at] += rest
        return same


def candidates(codes: np.ndarray, first: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, period, place) of grid points that may lie in a run; document ``d`` has words ``first[d]`` to ``first[d + 1]``."""
    lengths = np.diff(first)
    periods = lengths // exponent
    owner = np.repeat(np.arange(len(lengths)), periods)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = -(-(lengths[owner] - q) // ((exponent - 1) * q))
    ends = np.cumsum(points)
    found, at = [], 0
    while at < len(q):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POINTS, side="right")))
        own = np.repeat(np.arange(at, stop), points[at:stop])
        nr = np.arange(len(own)) - np.repeat(np.cumsum(points[at:stop]) - points[at:stop], points[at:stop])
        place = first[owner[own]] + nr * (exponent - 1) * q[own]
        hit = codes[place] == codes[place + q[own]]
        own, place = own[hit], place[hit]
        doc, step = owner[own], q[own]
        around = np.ones(len(own), np.int64)
        for side in (-1, 1):
            going = np.ones(len(own), bool)
            for t in range(1, exponent - 1):
                x = place + side * t * step
                going &= (x >= first[doc]) & (x + step < first[doc + 1])
                x = np.where(going, x, place)
                going &= codes[x] == codes[x + step]
                around += going
        stay = around >= exponent - 1
        found.append((doc[stay], step[stay], place[stay]))
        at = stop
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 3))


def runs_of(codes: np.ndarray, first: np.ndarray, exponent: int = EXPONENT, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, by document, start and period."""
    doc, q, place = candidates(codes, first, exponent)
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    # The documents with candidates, each between separators.
    own, doc = np.unique(doc, return_inverse=True)
    sizes = np.diff(first)[own]
    starts = np.arange(1, len(own) + 1) + np.cumsum(sizes) - sizes
    place = place - first[own[doc]] + starts[doc]
    text = np.arange(sizes.sum() + len(own) + 1)
    inside = np.ones(len(text), bool)
    inside[starts - 1] = inside[-1] = False
    words = np.repeat(first[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    text[inside] = codes[words] + len(own) + 1
    text[~inside] = np.arange(len(own) + 1)
    after = Extensions(text)(place, place + q)
    last = len(text) - 1
    before = Extensions(text[::-1])(last - (place - 1), last - (place + q - 1))
    start, size = place - before - starts[doc], before + after + q
    long_enough = size >= np.maximum(length, exponent * q)
    doc, start, size, q = (x[long_enough] for x in (doc, start, size, q))
    order = np.lexsort([q, size, start, doc])
    doc, start, size, q = (x[order] for x in (doc, start, size, q))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    doc, start, size, q = (x[new] for x in (doc, start, size, q))
    order = np.lexsort([q, start, doc])
    return own[doc[order]], start[order], size[order], q[order]


def planted(seeds: np.ndarray, known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of the word that stands at each place once runs are planted in documents whose seed ends in 0."""
    source = np.arange(first[-1])
    for d in np.flatnonzero(known & (seeds % 10 == 0) & (np.diff(first) > 0)):
        low, n, g = first[d], first[d + 1] - first[d], int(seeds[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[low + a : low + n] = low + a + np.arange(n - a) % p
    return source


def _joined(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the chosen words, a space after each, with their starts and ends."""
    low, size = words.start[chosen], words.end[chosen] - words.start[chosen]
    start = np.cumsum(size + 1) - (size + 1)
    index = np.repeat(low - start, size + 1) + np.arange(int((size + 1).sum()))
    out = words.data[np.minimum(index, len(words.data) - 1)] if len(index) else np.zeros(0, np.uint8)
    out[start + size] = 32
    return out, start, start + size


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(exponent: int, length: int, with_runs: bool, with_text: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in text_slices(batch.column("text")):
                words = words_of(texts)
                first, n = words.first, len(texts)
                seeds = batch.column("seed").slice(low, n)
                source = planted(seeds.fill_null(1).to_numpy(), seeds.is_valid().to_numpy(zero_copy_only=False), first)
                doc, start, size, period = runs_of(word_codes(words)[source], first, exponent, length)
                edges = np.searchsorted(doc, np.arange(n + 1))
                # The run of the greatest exponent, then the smallest start and period.
                order = np.lexsort([period, start, -(size / period), doc])
                some = np.flatnonzero(np.diff(edges))
                best, none = np.zeros(n, np.int64), np.diff(edges) == 0
                best[some] = order[edges[some]]
                top = [pa.array(x[best] if len(x) else np.zeros(n, np.int64), mask=none) for x in (start, size, period, 1000 * size // np.maximum(period, 1))]
                copied = np.zeros(len(source) + 1, np.int64)
                np.add.at(copied, first[doc] + start + period, 1)
                np.add.at(copied, first[doc] + start + size, -1)
                stay = np.cumsum(copied[:-1]) == 0
                kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(stay)])[first]
                out, begins, ends = _joined(words, source[stay])
                spans = [out[begins[a] : ends[b - 1]].tobytes() if a < b else b"" for a, b in zip(kept, kept[1:], strict=False)]
                rows = list(zip(start.tolist(), size.tolist(), period.tolist(), strict=True))
                listed = ["".join(f"{s},{z},{p}\n" for s, z, p in rows[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                columns = [batch.column("doc_id").slice(low, n), pa.array(np.diff(edges)), *top]
                columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]), pa.array([hashlib.sha256(x).hexdigest() for x in spans])]
                names = list(NAMES)
                if with_runs:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in (start, size, period)], fields=list(RUNS.value_type))))
                    names.append("runs")
                if with_text:
                    columns.append(pa.array([x.decode() for x in spans]))
                    names.append("collapsed")
                yield pa.record_batch(columns, names=names)

    return find


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, seed: Column | None = None, exponent: int = EXPONENT, length: int = LENGTH, with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """A row per document: SCHEMA, on request its ``runs`` (by start and period) and its ``collapsed`` text.

    ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the run with the greatest
    exponent. With ``seed`` (a number per row, null for none) runs are planted before the search.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    schema = SCHEMA + ", runs array<struct<start:long,length:long,period:long>>" * with_runs + ", collapsed string" * with_text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(None) if seed is None else seed).cast("long").alias("seed"), "text")
    return rows.mapInArrow(_finder(exponent, length, with_runs, with_text), schema)
