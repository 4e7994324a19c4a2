"""Token counts of whole texts with a ``sentencepiece`` model, each pre-token counted once.

The model writes a space as U+2581 and puts one in front of the text. None of its pieces
holds that sign after another character, a line feed beside another character, or a full
stop or comma right after an ASCII letter (checked when the model is loaded), so no merge
crosses these places: a text cut there falls into pre-tokens, and its number of tokens is
the sum over them.

1. Documents are taken in chunks of a bounded size. A chunk's file in the shared folder
   holds the pre-token frequencies of each of its documents; its distinct pre-tokens
   become rows.
2. These rows are dealt out and sorted by pre-token, and the model counts each distinct
   pre-token once. A frequent pre-token has one row per chunk, however often it occurs.
3. The counts return to their chunk and are summed with the frequencies. Ids are never
   put together.

Null and empty texts have no tokens and no bytes. Every row of the input gives a row, also
for equal or null ids. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pokerlake.llm.common import fresh_folder, storage, stored

CHUNK_BYTES = 24 << 20
SIGN = "▁"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SIGN in p.lstrip(SIGN) or ("\n" in p and p != "\n") or re.search("[A-Za-z][.,]", p) for p in pieces):
        raise ValueError("the model has pieces that reach across a cut")
    return model


def pre_tokens(texts: pa.Array) -> pa.ListArray:
    """Pre-tokens of each text; the first item of each list is always empty and stands for nothing.

    One that begins with spaces is written without its first space, further spaces as
    U+2581. One that was cut off without a space in front is written after a line feed.
    """
    spaced = pc.binary_join_element_wise("", pc.replace_substring(texts.fill_null(""), SIGN, " "), " ")
    runs = pc.replace_substring(pc.replace_substring(spaced, "  ", f" {SIGN}"), f"{SIGN} ", SIGN * 2)
    lines = pc.replace_substring(runs, "\n", " \n\n")
    return pc.split_pattern(pc.replace_substring_regex(lines, "([A-Za-z])([.,])", "\\1 \n\\2"), " ")


def piece_counts(model, tokens: list[str]) -> np.ndarray:
    """Number of pieces of each pre-token: an empty one is a space, a line feed in front adds two."""
    found = model.encode(tokens, num_threads=1)
    return np.array([1 if not t else len(x) - 2 * (t[0] == "\n") for t, x in zip(tokens, found, strict=True)], np.int64)


def _chunk(texts: pa.Array) -> tuple[pa.Array, pa.ListArray, pa.ListArray]:
    """(distinct pre-tokens, steps between their places by document, frequencies by document).

    Frequent pre-tokens come first and places ascend in a document, so steps are small.
    """
    lists = pre_tokens(texts)
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    lengths = np.diff(edges)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary
    code = coded.indices.to_numpy().astype(np.int64)
    keep = np.ones(len(code), bool)
    keep[edges[:-1]] = False
    rank = np.argsort(-np.bincount(code, minlength=len(names)), kind="stable")
    names = names.take(pa.array(rank))
    code = np.argsort(rank)[code] if len(rank) else code
    keep &= np.repeat(pc.binary_length(texts.fill_null("")).to_numpy() > 0, lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    cells = np.sort((owner * len(names) + code)[keep])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(cells)), bool), cells[1:] != cells[:-1]]))
    times = np.diff(np.append(first, len(cells)))
    cells = cells[first]
    offsets = pa.array(np.searchsorted(cells, np.arange(len(texts) + 1) * len(names)).astype(np.int32))
    steps = np.diff(cells % max(1, len(names)), prepend=0).astype(np.int32)
    return names, pa.ListArray.from_arrays(offsets, pa.array(steps)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.uint32)))


def _chunker(folder: str):
    def save(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        ids, texts = (table.column(c).chunk(0) for c in ("doc_id", "text"))
        names, steps, times = _chunk(texts)
        chunk = uuid4().int >> 66
        n_bytes = pc.binary_length(texts.fill_null("")).cast(pa.int64())
        batch = pa.record_batch([ids, n_bytes, steps, times], names=["doc_id", "n_bytes", "steps", "times"])
        system, inner = storage(folder)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{chunk}.arrow") as sink, pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        # One more row than names, so that a chunk of empty texts has one as well.
        names = pa.concat_arrays([names, pa.array([""], names.type)])
        order = pc.sort_indices(names)
        for at in range(0, len(names), 50_000):
            part = order.slice(at, 50_000)
            yield pa.record_batch([pa.array(np.full(len(part), chunk)), part.cast(pa.int32()), names.take(part)], names=["chunk", "place", "token"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                waiting.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= CHUNK_BYTES:
                    yield from save(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from save(waiting)

    return chunks


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        last, last_count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("token"))
            tokens = runs.values.to_pylist()
            counts = piece_counts(model, tokens)
            if tokens[0] == last:
                counts[0] = last_count
            last, last_count = tokens[-1], counts[-1]
            lengths = np.diff(runs.run_ends.to_numpy(), prepend=0)
            yield pa.record_batch([batch.column("chunk"), batch.column("place"), pa.array(np.repeat(counts, lengths).astype(np.int32))], names=["chunk", "place", "pieces"])

    return count


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _summer(folder: str):
    def add(rows: pa.Table) -> pa.Table:
        system, inner = storage(folder)
        with system.open_input_file(f"{inner}/{rows.column('chunk')[0].as_py()}.arrow") as source:
            batch = pa.ipc.open_file(source).get_batch(0)
        pieces = np.zeros(rows.num_rows, np.int64)
        pieces[rows.column("place").to_numpy()] = rows.column("pieces").to_numpy()
        steps, times = batch.column("steps"), batch.column("times")
        total = np.zeros(len(steps.values) + 1, np.int64)
        np.cumsum(pieces[np.cumsum(steps.values.to_numpy(), dtype=np.int64)] * times.values.to_numpy(), out=total[1:])
        n_tokens = np.diff(total[steps.offsets.to_numpy()])
        return pa.table([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_tokens)], schema=RESULT)

    return add


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "frequencies")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = stored(texts.mapInArrow(_chunker(folder), "chunk long, place int, token string"), "pre-tokens")
    counted = tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_counter(model), "chunk long, place int, pieces int")
    return counted.groupBy("chunk").applyInArrow(_summer(folder), "doc_id long, n_bytes long, n_tokens long")
