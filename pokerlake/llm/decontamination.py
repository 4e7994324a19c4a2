"""Benchmark decontamination with spaced seeds.

Words are compared in lower case and without ASCII punctuation. A seed is a fixed mask over
consecutive words; its hash covers the marked words only, so a substitution at an ignored
place does not hide a copy. Hashes of all test items are joined with those of every window
of every document; around a hit, document and item are laid side by side and every best
stretch (a match gains one, a substitution costs one) is verified word by word. A run of
``LEAST_WORDS`` words is a seed as well, so each unbroken run of that length is found. The
stretches of ``LEAST_WORDS`` matching words or more count if one of them has ``LONG_WORDS``,
whatever its share of the item, or if all of them, wherever they lie in the document, make up
half of the item; words that were inserted or left out only cut a copy into stretches.
The share of the item that the stretches of a document cover is reported as its coverage.

The test side is taken in blocks of a bounded number of words, so what is broadcast has a
proven size; each block meets all documents in a pass without a shuffle. Every mask that fits
an item is used. Items of ``SHORTEST`` to ``SHORT`` words have masks of their own, which leave
out one word (below ``LEAST_WORDS`` words) or two neighbours at every place, so that a copy
with any one word replaced, or cut off at an end, is found; nothing less than all words but
one counts for items of up to ``LEAST_WORDS`` words. Those below ``SHORTEST`` words say
nothing and match nothing.

Null and empty texts, on either side, match nothing. Several equal or null ids give their
rows each. Without items or documents there are no matches. Columns other than those named
are not read, or passed through by ``marked``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from pokerlake.llm.common import free_name, stored
from pokerlake.llm.words import _BASES, PLAIN_LOWER, PLAIN_SPACE, U64, mixed, text_slices, word_hashes, words_of

#: Eight or nine marked words in 12 to 14.
MASKS = ("111011011001", "1101100101111", "11110010110001")
SHORTEST = 5
SHORT = 12
LEAST_WORDS = 8
LONG_WORDS = 13
RUN = "1" * LEAST_WORDS
BLOCK_WORDS = 1_000_000
MATCH = "doc_id long, item_id long, start long, end long, matched long, item_words long, coverage double"


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the marked words of each window, across text borders too."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, len(mask), U64)
    for i, mark in enumerate(mask):
        if mark == "1":
            out = out * _BASES[1].base + hashes[i : i + n]
    return mixed(out)


def short_masks(item_words: int) -> list[str]:
    """Masks of which one fits an item with any single word replaced."""
    gap = 1 if item_words < LEAST_WORDS else 2
    masks = ("1" * at + "0" * gap + "1" * (item_words - at - gap) for at in range(0, item_words, gap))
    return sorted({mask[:item_words].strip("0") for mask in masks})


class TestItems:
    """Seeds of a block of test items, sorted by hash for each mask."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [r[0] for r in rows]
        words = words_of(pa.array([r[1] or "" for r in rows], pa.string()), PLAIN_SPACE, PLAIN_LOWER)
        self.words, self.first = word_hashes(words), words.first
        sizes = np.diff(words.first)
        plan = {mask: sizes >= len(mask) for mask in (*MASKS, RUN)}
        for n in sorted(set(sizes[(sizes >= SHORTEST) & (sizes <= SHORT)].tolist())):
            for mask in short_masks(n):
                plan[mask] = plan.get(mask, False) | (sizes == n)
        self.seeds = {}
        for mask, used in plan.items():
            at = np.concatenate([np.arange(a, b - len(mask) + 1) for a, b, u in zip(words.first, words.first[1:], used, strict=False) if u] or [np.zeros(0, np.int64)])
            if len(at):
                hashes = seed_hashes(self.words, mask)[at]
                order = np.argsort(hashes, kind="stable")
                near = np.zeros(1 << 20, bool)
                near[hashes >> U64(44)] = True
                self.seeds[mask] = (hashes[order], at[order], near)

    def hits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item, offset of the item's first word in the document)."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, (known, places, near) in self.seeds.items():
            hashes = seed_hashes(words, mask)
            at = np.flatnonzero(near[hashes >> U64(44)])
            low, high = (np.searchsorted(known, hashes[at], side) for side in ("left", "right"))
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            if not len(at):
                continue
            place = places[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = np.repeat(at, n)
            document = np.searchsorted(first, at, "right") - 1
            inside = at + len(mask) <= first[document + 1]
            document, at, place = document[inside], at[inside], place[inside]
            item = np.searchsorted(self.first, place, "right") - 1
            offset = (at - first[document]) - (place - self.first[item])
            found.append(np.unique(np.stack([document, item, offset], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int, float]]:
        """(text, item, first word, word after the last, matching words, words of the item, coverage of the item by the text)."""
        words = words_of(texts, PLAIN_SPACE, PLAIN_LOWER)
        hashes = word_hashes(words)
        out = []
        for (document, item), hits in groupby(self.hits(hashes, words.first).tolist(), itemgetter(0, 1)):
            text, test = hashes[words.first[document] : words.first[document + 1]], self.words[self.first[item] : self.first[item + 1]]
            found, covered = [], np.zeros(len(test), bool)
            for _, _, offset in hits:
                low, high = max(0, offset), min(len(text), offset + len(test))
                same = text[low:high] == test[low - offset : high - offset]
                for start, end, matched in stretches(same, least_words(len(test))):
                    found.append((low + start, low + end, matched))
                    covered[low - offset + start : low - offset + end] |= same[start:end]
            if found and (max(f[2] for f in found) >= LONG_WORDS or 2 * covered.sum() >= len(test)):
                out += [(document, item, *f, len(test), float(covered.mean())) for f in found]
        return out


def least_words(item_words: int) -> int:
    """Matching words that a stretch needs."""
    return min(LEAST_WORDS, item_words - 1)


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, matches) of the best stretch, of the best ones on both sides of it and so on, down to ``least`` matches."""
    out, open_parts = [], [(0, len(same))]
    while open_parts:
        low, high = open_parts.pop()
        if np.count_nonzero(same[low:high]) < least:
            continue
        start, end = best_stretch(same[low:high])
        matched = int(np.count_nonzero(same[low + start : low + end]))
        if matched >= least:
            out.append((low + start, low + end, matched))
        if end > start:
            open_parts += [(low, low + start), (low + end, high)]
    return sorted(out)


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """The stretch with the largest number of matches less substitutions, of equal ones the last and longest."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(same, 1, -1))])
    gain = total - np.minimum.accumulate(total)
    end = len(same) - int(np.argmax(gain[::-1]))
    return int(np.argmin(total[: end + 1])), end


def test_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[TestItems]:
    """The items in blocks of about ``block_words`` words; the rows of one block at a time, the seeds of all blocks pass through the driver."""
    sized = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("words")), "items")
    n = max(1, -(-(sized.agg(F.sum("words")).first()[0] or 0) // block_words))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    blocks = (sized.filter(F.col("block") == b).orderBy("item_id", "text").collect() for b in range(n))
    return [TestItems([(r.item_id, r.text) for r in rows]) for rows in blocks if rows]


def matches(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per verified place: MATCH."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def against(items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, part in text_slices(batch.column("text")):
                    found = items.value.matches(part)
                    if found:
                        text, item, *rest = zip(*found, strict=True)
                        ids = batch.column("doc_id").take(pa.array([at + t for t in text]))
                        columns = [ids, pa.array([items.value.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in rest[:-1]), pa.array(rest[-1], pa.float64())]
                        yield pa.record_batch(columns, names=["doc_id", "item_id", "start", "end", "matched", "item_words", "coverage"])

        return rows.mapInArrow(run, MATCH)

    blocks = [against(docs.sparkSession.sparkContext.broadcast(b)) for b in test_blocks(benchmark, block_words)]
    return reduce(DataFrame.union, blocks) if blocks else docs.sparkSession.createDataFrame([], MATCH)


def best_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The longest match of each doc_id and item, with the share of the item that all its stretches cover.

    Rows with equal or null ids count as one document here; ``matches`` has every place of every row.
    """
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("matched"), "start", "end")
    return matches(docs, benchmark).withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def marked(docs: DataFrame, benchmark: DataFrame, column: str = "_contaminated", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` and the mark as ``column``, a name that ``docs`` must not have."""
    if column != free_name(docs, column):
        raise ValueError(f"the input has a column {column}")
    docs = docs.withColumn(column, F.lit(False))
    schema = StructType([*docs.schema.fields[:-1], StructField(column, BooleanType())])
    at = docs.columns.index("text")

    def against(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flags = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).copy()
                for start, part in text_slices(batch.column(at)):
                    flags[[start + m[0] for m in items.value.matches(part)]] = True
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(flags)], names=batch.schema.names)

        return run

    for block in test_blocks(benchmark, block_words):
        docs = docs.mapInArrow(against(docs.sparkSession.sparkContext.broadcast(block)), schema)
    return docs
