"""Token ids as Arrow files of equal-length sequences (binary output).

Documents are sorted by id into range slices; each slice becomes one Arrow IPC file whose
batches hold two fixed-size-list columns, ``ids`` (uint16 where the vocabulary fits, else
uint32) and ``mask`` (one bit: a token, or padding at the end of the file). Sequence ``i`` of a file sits at a known
place, so readers map the file and slice it without copying. Beside it lies a file of the
documents (id, place of the first token, number of tokens).

A task writes under a name of its own and reports it in its rows; only the rows of the
attempt that counts reach the manifest, so a repeated or lost attempt leaves at most a
file that nobody refers to.

Null texts are empty and encode to the end id alone. Documents with equal ids follow one
another in the order of a hash of their text; null ids come first. No documents: no files.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pokerlake.llm.common import fresh_folder, slices_of, storage, stored
from pokerlake.llm.subwords import ChunkEncoder
from pokerlake.llm.words import tidy

SEQUENCES_PER_BATCH = 512
MANIFEST = "slice long, file string, documents_file string, documents long, tokens long, sequences long"


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """Reader of an Arrow file; local files are mapped, not read."""
    system, inner = storage(path)
    local = isinstance(system, pafs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(inner) if local else system.open_input_file(inner))


def sequence(path: str, number: int, per_batch: int = SEQUENCES_PER_BATCH) -> tuple[np.ndarray, pa.BooleanArray]:
    """(ids, mask) of one sequence of a file, as views of the mapped file."""
    batch = open_file(path).get_batch(number // per_batch)
    ids, mask = (batch.column(c)[number % per_batch].values for c in ("ids", "mask"))
    return ids.to_numpy(), mask


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


class _SequenceFile:
    """Packs ids into sequences and writes full batches as they fill."""

    def __init__(self, path: str, length: int, kind: np.dtype):
        self.length, self.kind, self.waiting, self.size, self.sequences = length, kind, [], 0, 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        system, inner = storage(path)
        self.sink = system.open_output_stream(inner)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind))
        self.size += len(ids)
        full = self.length * SEQUENCES_PER_BATCH
        if self.size >= full:
            ids = np.concatenate(self.waiting)
            for at in range(0, len(ids) - full + 1, full):
                self._batch(ids[at : at + full], full)
            rest = ids[len(ids) - len(ids) % full :]
            self.waiting, self.size = [rest], len(rest)

    def _batch(self, ids: np.ndarray, tokens: int) -> None:
        mask = np.arange(len(ids)) < tokens
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> None:
        if self.size:
            padded = np.zeros(-(-self.size // self.length) * self.length, self.kind)
            padded[: self.size] = np.concatenate(self.waiting)
            self._batch(padded, self.size)
        self.writer.close()
        self.sink.close()


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _writer(folder: str, tokenizer: str, end_id: int, length: int):
    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = index = None
        documents = tokens = 0
        name = f"{folder}/part-{TaskContext.get().partitionId():08d}-{uuid4().hex[:12]}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system, inner = storage(folder)
                system.create_dir(inner, recursive=True)
                out = _SequenceFile(f"{name}.arrow", length, _encoder(tokenizer).kind(end_id))
                sink = system.open_output_stream(f"{inner}/{name.rsplit('/', 1)[1]}.documents.arrow")
                index = pa.ipc.new_file(sink, DOCUMENTS)
            ids, counts = _encoder(tokenizer).encode(batch.column("text"))
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, np.uint32(end_id))
            out.add(whole)
            counts = counts + 1
            starts = tokens + np.cumsum(counts) - counts
            index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts), pa.array(counts)], schema=DOCUMENTS))
            documents, tokens = documents + batch.num_rows, tokens + len(whole)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            row = [TaskContext.get().partitionId(), f"{name}.arrow", f"{name}.documents.arrow", documents, tokens, out.sequences]
            yield pa.record_batch([pa.array([x]) for x in row], names=["slice", "file", "documents_file", "documents", "tokens", "sequences"])

    return write


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, sequence_length: int = 2048, end_id: int = 2) -> DataFrame:
    """Write the files; the manifest has a row per file: MANIFEST and ``start``, the tokens before it."""
    folder = folder or fresh_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    slices = slices_of(rows, 100_000)
    ordered = rows.repartitionByRange(slices, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = stored(ordered.mapInArrow(_writer(folder, tokenizer, end_id, sequence_length), MANIFEST), "manifest")
    # One row per file, so a window without partitions stays small.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file, index = open_file(row["file"]), open_file(row["documents_file"])
            at, loaded, number, crc, left = 0, np.zeros(0, np.uint32), 0, 0, 0
            for part in range(index.num_record_batches):
                documents = index.get_batch(part)
                starts, counts = (documents.column(c).to_numpy() for c in ("start", "n_tokens"))
                crcs = np.empty(len(counts), np.int64)
                for i, count in enumerate(counts.tolist()):
                    crc, left = 0, count
                    while left:
                        if at == len(loaded):
                            block = file.get_batch(number)
                            ids, mask = (block.column(c).flatten() for c in ("ids", "mask"))
                            loaded, at, number = ids.to_numpy()[: mask.true_count].astype("<u4"), 0, number + 1
                        step = min(left, len(loaded) - at)
                        crc = zlib.crc32(loaded[at : at + step], crc)
                        at, left = at + step, left - step
                    crcs[i] = crc
                yield pa.record_batch(
                    [documents.column("doc_id"), pa.array(starts + row["start"]), pa.array(counts), pa.array(crcs)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_digests(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (ids as little-endian uint32)."""
    files = manifest.select("slice", "file", "documents_file", "start")
    n = max(1, manifest.count())
    return files.repartition(n, "slice").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
