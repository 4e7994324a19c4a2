"""Removal of passages that occur more than once, by super-k-mers.

A window is ``WINDOW`` words in a row. Its minimiser is the smallest hash among its runs of
``SHORT`` words, the leftmost of equal ones. Consecutive windows with their minimiser at one
place form a super-k-mer, ``WINDOW - SHORT + 1`` windows at most, and travel as one packed
string to the bucket of that minimiser. Equal windows always meet, and a word travels about
three times instead of ``WINDOW`` times.

1. Every document is cut into super-k-mers. Only their minimisers are counted at first: a
   window that occurs twice brings its minimiser twice, so a super-k-mer whose minimiser
   occurs once is done and its words never travel.
2. The others are packed. In a bucket equal strings are put together, the windows of the
   rest are sorted, and neighbours in the order are compared word for word.
3. A minimiser with more than ``HOT`` super-k-mers (copies by the thousand, common phrases)
   would make a bucket of any size. Its equal strings are first counted, before the shuffle:
   all windows of a string that occurs twice are repeated. One of each string stays. If more
   than ``HOT`` different ones are left, they are cut again, as in 1, by the minimisers of
   longer runs, until those are as long as the window and strings that differ share nothing.
   So a bucket never holds more than ``HOT`` strings, and words are compared, not hashes.
4. The ranges found return to their documents, which drop the words covered.

Counts cover all documents, windows are judged on the input. Null and empty texts have no
words and keep none; the SHA-256 is then that of no bytes. Documents with fewer than
``WINDOW`` words have no window. Repeated rows are occurrences of their own and each give a
row. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.llm.common import stored
from pokerlake.llm.words import U64, Words, rolling_hashes, sliding_argmin, text_slices, word_hashes, words_of

WINDOW = 35
SHORT = 5
HOT = 256

RUNS = "doc_id long, text_hash long, start int, windows int, minimiser long"
PACKED = "hot boolean, minimiser long, packed binary, doc_id long, text_hash long, start int, windows int"
CUT_AGAIN = "minimiser long, packed binary, doc_id long, text_hash long, start int, windows int, open boolean"


def super_kmers(texts: pa.Array, window: int = WINDOW, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, minimiser) of each super-k-mer."""
    words = words_of(texts)
    values = rolling_hashes(word_hashes(words), short)
    places = sliding_argmin(values, window - short + 1)
    documents = words.documents
    n = len(places)
    inside = documents[:n] == documents[window - 1 : window - 1 + n]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    place, owner = places[at], documents[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(begins)
    return owner[first], at[first] - words.first[owner[first]], np.diff(np.append(first, len(at))), values[place[first]]


def _cut(window: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in text_slices(batch.column("text")):
                text, start, windows, minimiser = super_kmers(part, window, short)
                rows = pa.array(text + low)
                columns = [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(minimiser.view(np.int64))]
                yield pa.record_batch(columns, names=["doc_id", "text_hash", "start", "windows", "minimiser"])

    return run


def _strings(words: Words, first: np.ndarray, windows: np.ndarray, window: int) -> pa.Array:
    """Words of each super-k-mer (first word, number of windows), joined by one space."""
    data = words.data.tobytes()
    low, high = words.start[first].tolist(), words.end[first + windows + window - 2].tolist()
    return pa.array([b" ".join(data[a:b].split()) for a, b in zip(low, high, strict=True)], pa.binary())


def _pack(window: int):
    """Strings of the listed super-k-mers of each text."""
    names = ["hot", "minimiser", "packed", "doc_id", "text_hash", "start", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in text_slices(batch.column("text")):
                words, runs = words_of(part), batch.column("runs").slice(low, len(part))
                owner = np.repeat(np.arange(len(part)), np.diff(runs.offsets.to_numpy()))
                items = runs.flatten()
                start, windows = (items.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                packed, rows = _strings(words, words.first[owner] + start, windows, window), pa.array(owner + low)
                columns = [items.field(3), items.field(2), packed, batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), items.field(0), items.field(1)]
                yield pa.record_batch(columns, names=names)

    return run


def _cut_again(window: int, short: int):
    """Super-k-mers of the strings of super-k-mers, by the minimisers of longer runs."""
    names = ["minimiser", "packed", "doc_id", "text_hash", "start", "windows", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in text_slices(batch.column("packed").cast(pa.string())):
                owner, start, windows, minimiser = super_kmers(part, window, short)
                words, rows = words_of(part), pa.array(owner + low)
                doc_id, text_hash, before, open_ = (batch.column(c).take(rows) for c in ("doc_id", "text_hash", "start", "open"))
                places = pa.array((before.to_numpy(zero_copy_only=False) + start).astype(np.int32))
                columns = [pa.array(minimiser.view(np.int64)), _strings(words, words.first[owner] + start, windows, window), doc_id, text_hash, places, pa.array(windows.astype(np.int32)), open_]
                yield pa.record_batch(columns, names=names)

    return run


def repeated_windows(strings: list[bytes], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Ranges (first window, one after the last) that occur elsewhere, for each super-k-mer of a bucket."""
    copies: dict[bytes, list[int]] = {}
    for i, packed in enumerate(strings):
        copies.setdefault(packed, []).append(i)
    cuts, owners, places, lengths = [], [], [], {}
    for packed in copies:
        ends = [i for i, b in enumerate(packed) if b == 32] + [len(packed)]
        starts = [0] + [e + 1 for e in ends[:-1]]
        lengths[packed] = len(ends) - window + 1
        for p in range(lengths[packed]):
            cuts.append(packed[starts[p] : ends[p + window - 1]])
            owners.append(packed)
            places.append(p)
    order = sorted(range(len(cuts)), key=cuts.__getitem__)
    flagged: dict[bytes, set[int]] = {p: set(range(lengths[p])) for p, rows in copies.items() if len(rows) > 1}
    for a, b in zip(order, order[1:], strict=False):
        if cuts[a] == cuts[b]:
            flagged.setdefault(owners[a], set()).add(places[a])
            flagged.setdefault(owners[b], set()).add(places[b])
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for packed, marks in flagged.items():
        ranges: list[tuple[int, int]] = []
        for p in sorted(marks):
            if ranges and ranges[-1][1] == p:
                ranges[-1] = (ranges[-1][0], p + 1)
            else:
                ranges.append((p, p + 1))
        for i in copies[packed]:
            out[i] = ranges
    return out


RANGES = "doc_id long, text_hash long, low int, high int"


def _count(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def ranges(bucket: list[tuple]) -> Iterator[tuple]:
        for row, found in zip(bucket, repeated_windows([r[0] for r in bucket], window) if len(bucket) > 1 else [[]] * len(bucket), strict=True):
            for low, high in found if row[4] else ():
                yield row[1], row[2], row[3] + low, row[3] + high + window - 1

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, current = [], None
        for batch in batches:
            out = []
            keys = batch.column("minimiser").to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in ("packed", "doc_id", "text_hash", "start", "open")), strict=True)
            for key, row in zip(keys, rows, strict=True):
                if key != current:
                    out += ranges(bucket)
                    bucket, current = [], key
                bucket.append(row)
            yield table(out)
        yield table(list(ranges(bucket)))

    return run


def _compared(strings: DataFrame, window: int) -> DataFrame:
    """RANGES of the open strings of bounded buckets."""
    return strings.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_count(window), RANGES)


def _hot_ranges(rows: DataFrame, window: int, short: int) -> DataFrame:
    """RANGES of the super-k-mers (by runs of ``short`` words) of minimisers that have many.

    A row is open if its windows may still be found repeated; the others are kept only to be
    compared with. ``rows`` is a stored table.
    """
    end = F.col("start") + F.col("windows") + F.lit(window - 1)
    found = None
    for step in range(4):
        # For a string that occurs once the maxima are its own values.
        own = [F.max(c).alias(c) for c in ("doc_id", "text_hash", "start", "windows", "open")]
        strings = stored(rows.groupBy("minimiser", "packed").agg(F.count(F.lit(1)).alias("n"), *own), "strings")
        copied = strings.filter("n > 1").select("minimiser", "packed")
        whole = rows.filter("open").join(copied, ["minimiser", "packed"]).select("doc_id", "text_hash", F.col("start").alias("low"), end.alias("high"))
        found = whole if found is None else found.unionByName(whole)
        if step == 3:  # strings are windows now
            return found
        sizes = strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("_strings")).filter("_strings > 1")
        sizes = stored(sizes.select("minimiser", (F.col("_strings") > HOT).alias("hot")), "minimisers")
        left = strings.withColumn("open", F.col("open") & (F.col("n") == 1)).join(sizes, "minimiser").drop("n")
        found = found.unionByName(_compared(left.filter("NOT hot"), window))
        if sizes.filter("hot").isEmpty():
            return found
        longer = short + (window - short) * (step + 1) // 3
        cut = stored(left.filter("hot").drop("hot").mapInArrow(_cut_again(window, longer), CUT_AGAIN), "cut-again")
        twice = cut.groupBy("minimiser").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("minimiser")
        rows = stored(cut.join(twice, "minimiser"), "cut-again")
    return found


def repeated_ranges(docs: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """RANGES: words low to high - 1 of the text are covered by windows that occur elsewhere."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    runs = stored(rows.mapInArrow(_cut(window, short), RUNS), "super-k-mers")
    counts = runs.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = stored(counts.select("minimiser", (F.col("n") > HOT).alias("hot")), "minimisers")
    shared = runs.join(counts, "minimiser")
    # A set per document, no longer than the document; equal rows have equal items.
    items = F.collect_set(F.struct("start", "windows", "minimiser", "hot")).alias("runs")
    lists = shared.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(items)
    joined = rows.join(lists, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_hash")
    packed = stored(joined.mapInArrow(_pack(window), PACKED).withColumn("open", F.lit(True)), "packed")
    calm, busy = (packed.filter(f).drop("hot") for f in ("NOT hot", "hot"))
    return _compared(calm, window).unionByName(_hot_ranges(busy, window, short))


def _kept(with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in text_slices(batch.column("text")):
                words = words_of(part)
                removed = np.zeros(len(words.start) + 1, np.int64)
                ranges = batch.column("ranges").slice(low, len(part))
                owner = np.repeat(np.arange(len(part)), np.diff(ranges.offsets.to_numpy()))
                items = ranges.flatten()
                if len(items):
                    base = words.first[owner]
                    np.add.at(removed, base + items.field(0).to_numpy(), 1)
                    np.add.at(removed, base + items.field(1).to_numpy(), -1)
                gone = np.cumsum(removed[:-1]) > 0
                data = words.data.tobytes()
                stay = ~gone
                kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(stay)])[words.first]
                pieces = [data[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)]
                texts = [b" ".join(pieces[a:b]) for a, b in zip(kept, kept[1:], strict=False)]
                n_words = np.diff(words.first)
                columns = [batch.column("doc_id").slice(low, len(part)), pa.array(n_words), pa.array(n_words - np.diff(kept)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.record_batch(columns + [pa.array([t.decode() for t in texts])] * with_text, names=names)

    return run


def dedupe_substrings(docs: DataFrame, window: int = WINDOW, short: int = SHORT, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and the kept text on request."""
    found = repeated_ranges(docs, window, short)
    lists = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    empty = F.array().cast("array<struct<low:int,high:int>>")
    joined = rows.join(lists, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("doc_id", "text", F.coalesce("ranges", empty).alias("ranges")).mapInArrow(_kept(with_text), schema)
