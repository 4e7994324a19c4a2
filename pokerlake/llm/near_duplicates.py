"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the weighted set of its runs of five words; a run that occurs t times weighs
1 + floor(log2 t). Each run sends points of a Poisson process with its weight as rate, and
every point falls into one of ``REGISTERS`` registers, which keeps the earliest. A run stops
as soon as its next point is later than all registers of its document. Two documents agree
in a register with the probability Jaccard of their weights, which is the ordinary Jaccard
where all runs weigh alike.

1. Equal texts are one class from the start, so copies do not meet again.
2. Registers are hashed in bands. In each bucket of two or more classes the member that
   shares most buckets is the centre, and every other member is verified against it on the
   whole texts. Big families of copies are tied to their origin this way.
3. Members that are not similar to their centre are compared with all members of the bucket
   outside their component, inside bounded blocks. One minus the probability Jaccard is a
   metric, so two members whose distances from the centre differ too much cannot be similar;
   the others are compared by ``FINE`` registers, and where these leave a similarity of
   ``SIMILARITY`` possible (four standard deviations), on the whole texts.
4. Connected components of the verified links are the result.

Links have a probability Jaccard of at least ``SIMILARITY``, computed exactly. Texts without
words, null ones included, match nothing; those with one to four words are a single run.
Documents with a null id take no part and are kept. Ids are taken to be unique: of several
texts under one id the smallest is the one compared with others, and equal rows are kept or
not alike. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.llm.common import components, in_blocks, stored
from pokerlake.llm.words import U64, Words, mixed, rolling_hashes, text_slices, tidy, word_hashes, words_of

RUN = 5
SIMILARITY = 0.8
REGISTERS = 160
FINE = 1024
BANDS = 32
BLOCK = 512
#: Rows whose registers are held together: 16 bytes each.
SIGNED_ROWS, MARKED_ROWS = 8_000, 1_250
GOLDEN = U64(0x9E3779B97F4A7C15)


def weighted_runs(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, run, weight), ascending by text and run; texts of one to four words are one run."""
    n = np.diff(words.first)
    all_runs = rolling_hashes(hashes, RUN)
    counts = np.where(n >= RUN, n - RUN + 1, 0)
    owner = np.repeat(np.arange(len(n)), counts)
    at = np.repeat(words.first[:-1], counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    runs = all_runs[at]
    short = np.flatnonzero((n > 0) & (n < RUN))
    alone = np.array([int(rolling_hashes(hashes[words.first[i] : words.first[i + 1]], int(n[i]))[0]) ^ int(n[i]) for i in short], U64)
    owner, runs = np.concatenate([owner, short]), np.concatenate([runs, alone])
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(runs)))
    return owner[first], runs[first], 1 + np.floor(np.log2(times)) if len(times) else np.zeros(0)


def prob_min_hash(texts: int, owner: np.ndarray, runs: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The run with the earliest point of each register (columns) for each text (rows)."""
    earliest = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, U64)
    time = np.zeros(len(runs))
    turn = 0
    while len(runs):
        turn += 1
        draw = mixed(runs + U64(turn * int(GOLDEN) & (1 << 64) - 1))
        time = time - np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
        cell = owner * registers + (mixed(draw ^ GOLDEN) % U64(registers)).astype(np.int64)
        early = np.flatnonzero(time < earliest[cell])
        np.minimum.at(earliest, cell[early], time[early])
        won = early[time[early] == earliest[cell[early]]]
        holder[cell[won]] = runs[won]
        latest = earliest.reshape(texts, registers).max(axis=1)
        going = time < latest[owner]
        owner, runs, weights, time = owner[going], runs[going], weights[going], time[going]
    return holder.reshape(texts, registers)


def probability_jaccard(a_runs, a_weights, b_runs, b_weights) -> float:
    """Exact probability Jaccard of two weighted sets given as ascending runs with weights."""
    union = np.union1d(a_runs, b_runs)
    a, b = np.zeros(len(union)), np.zeros(len(union))
    a[np.searchsorted(union, a_runs)] = a_weights
    b[np.searchsorted(union, b_runs)] = b_weights
    both = (a > 0) & (b > 0)
    ratios, times = np.unique(np.stack([a[both], b[both]]), axis=1, return_counts=True)
    return float(sum(n / np.maximum(a / x, b / y).sum() for (x, y), n in zip(ratios.T, times, strict=True)))


SIGNED = "doc_id long, first long, second long, bands array<long>"


@tidy
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, part in text_slices(batch.column("text"), rows=SIGNED_ROWS):
            words = words_of(part)
            hashes = word_hashes(words)
            holder = prob_min_hash(len(part), *weighted_runs(words, hashes))
            some = np.flatnonzero(np.diff(words.first) > 0)
            holder = holder[some]
            rows = REGISTERS // BANDS
            bands = np.zeros((len(some), BANDS), U64)
            for i in range(rows):
                bands = mixed(bands * GOLDEN + holder[:, i::rows])
            bands = mixed(bands + np.arange(BANDS, dtype=U64))
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS)
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(pa.array(some + low)),
                    *(batch.column(c).take(pa.array(some + low)) for c in ("first", "second")),
                    pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "first", "second", "bands"],
            )


@tidy
def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte of each of ``FINE`` registers, for texts that need a closer look."""
    for batch in batches:
        for low, part in text_slices(batch.column("text"), rows=MARKED_ROWS):
            words = words_of(part)
            holder = prob_min_hash(len(part), *weighted_runs(words, word_hashes(words)), FINE)
            marks = [m.tobytes() for m in (holder & U64(255)).astype(np.uint8)]
            yield pa.record_batch([batch.column("id").slice(low, len(part)), pa.array(marks, pa.binary())], names=["rep", "marks"])


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sets(texts: pa.Array):
        """Weighted runs of each text; neighbours with one text share the work."""
        runs = texts.dictionary_encode()
        words = words_of(runs.dictionary.fill_null(""))
        owner, run, weight = weighted_runs(words, word_hashes(words))
        first = np.searchsorted(owner, np.arange(len(runs.dictionary) + 1))
        return [(run[first[i] : first[i + 1]], weight[first[i] : first[i + 1]]) for i in runs.indices.to_pylist()]

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            left, right = sets(part.column("a_text")), sets(part.column("b_text"))
            value = [probability_jaccard(*x, *y) for x, y in zip(left, right, strict=True)]
            yield pa.record_batch([part.column("a"), part.column("b"), pa.array(value, pa.float64())], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their exact similarity; texts: id, text."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(_verify, "a long, b long, similarity double")


def _plausible(similarity: float):
    least = similarity - 4 * (similarity * (1 - similarity) / FINE) ** 0.5

    def run(rows: pa.Table) -> pa.Table:
        ids, component, block, to_centre = (rows.column(c).to_numpy() for c in ("rep", "component", "block", "to_centre"))
        left = rows.column("left").to_numpy()
        low, high, key = (rows.column(c)[0].as_py() for c in ("low", "high", "key"))
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(len(ids), FINE)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        out = [np.zeros((0, 2), np.int64)]
        for i in np.flatnonzero(left):
            able = (component != component[i]) & ~(left & (ids <= ids[i]))
            able &= np.abs(to_centre - to_centre[i]) <= 1 - similarity + 1e-9
            if low != high:
                able &= block != block[i]
            at = np.flatnonzero(able)
            same = (marks[at] == marks[i]).mean(axis=1)
            at = at[(same - 1 / 256) / (1 - 1 / 256) >= least]
            # The pair belongs to the first bucket that it shares.
            at = at[[bands[i, np.argmax(bands[i] == bands[j])] == key for j in at]] if len(at) else at
            out.append(np.stack([np.minimum(ids[i], ids[at]), np.maximum(ids[i], ids[at])], axis=1))
        found = np.concatenate(out)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that take part, signed rows, one row per class of equal texts)."""
    hashes = F.xxhash64("text").alias("first"), F.xxhash64(F.lit(1), "text").alias("second")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes, "text").filter("doc_id IS NOT NULL")
    signed = stored(rows.mapInArrow(_sign, SIGNED), "signed")
    reps = signed.groupBy("first", "second").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    return rows, signed, stored(reps.select("rep", "first", "second", "bands"), "classes")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest id of its group) and kept (the document stands for its group)."""
    rows, signed, reps = _representatives(docs)
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = stored(keyed.join(shared, "key"), "members")
    weight = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    weighed = members.join(stored(weight, "weights"), "rep")
    best = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("best"))
    centres = stored(best.select("key", (-F.col("best.minus")).alias("centre")), "centres")
    tied = stored(members.join(centres, "key").filter("rep <> centre").select("key", "n", "rep", "centre"), "tied")

    involved = members.select("rep").distinct()
    picked = rows.join(involved, rows.doc_id == involved.rep).groupBy(F.col("rep").alias("id")).agg(F.min("text").alias("text"))
    texts = stored(picked, "texts")

    first_round = stored(verified(tied.select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), texts), "verified")
    links = first_round.filter(F.col("similarity") >= similarity - 1e-12).select("a", "b")
    labels = components(links)

    outcome = first_round.select(F.col("a").alias("rep"), F.col("b").alias("centre"), "similarity")
    measured = stored(tied.join(outcome, ["rep", "centre"]).select("key", "rep", "similarity"), "measured")
    open_keys = stored(measured.filter(F.col("similarity") < similarity - 1e-12).select("key").distinct(), "open")
    labelled = labels.select(F.col("id").alias("rep"), "component")
    again = members.join(open_keys, "key").join(measured, ["key", "rep"], "left").join(labelled, "rep", "left")
    again = again.withColumns(
        {
            "to_centre": 1 - F.coalesce("similarity", F.lit(1.0)),  # the centre itself has no row
            "left": F.coalesce(F.col("similarity") < similarity - 1e-12, F.lit(False)),
            "component": F.coalesce("component", "rep"),
        }
    )
    again = stored(again.select("key", "n", "rep", "to_centre", "left", "component"), "again")
    closer = texts.join(again.select(F.col("rep").alias("id")).distinct(), "id").select("id", "text")
    marks = stored(closer.mapInArrow(_mark, "rep long, marks binary"), "marks")
    blocks = in_blocks(again.join(marks, "rep").join(reps.select("rep", "bands"), "rep"), "key", "n", "rep", BLOCK)
    pairs = stored(blocks.groupBy("key", "low", "high").applyInArrow(_plausible(similarity), "a long, b long").distinct(), "pairs")
    second_round = verified(pairs, texts).filter(F.col("similarity") >= similarity - 1e-12).select("a", "b")
    labels = components(links.unionByName(stored(second_round, "links")))

    to = reps.join(labels, reps.rep == labels.id, "left").select("first", "second", F.coalesce("component", "rep").alias("class_id"))
    found = signed.select("doc_id", "first", "second").join(stored(to, "components"), ["first", "second"]).select("doc_id", "class_id")
    alone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NULL").withColumn("class_id", F.lit(None).cast("long"))
    wordless = rows.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))
    return found.unionByName(wordless).unionByName(alone).withColumn("kept", kept)
