"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each; the index of the cell on a
Hilbert curve orders the rows, so a run of rows covers a compact region of all dimensions
and files cut from runs can be pruned by any of them. Equal texts share the smallest of their
cells and lie together in it. The order is cut where the running size passes equal parts of the total (law
``bytes``), so shards differ by less than a row at each end. A cut that falls inside a
group of equal texts moves to the group's start unless the group is larger than the
largest row.

Running sizes come from range slices of the order: one table of the slices' sums and a sum
inside each slice. The order ends with the id and a hash, so a cell or a group of copies of
any size is spread over slices. Only the cuts pass through the driver.

Null texts have size 8 and the CRC of an empty text; null metadata have a code of their own.
Rows equal in everything are told apart by place. No rows: no shards. Other columns are not
read by ``shards`` and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pokerlake.llm.common import free_name, slices_of, stored

BITS = 4


def hilbert_index(codes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (a row each, a column per dimension) of ``bits`` bits.

    Works on the transposed index: undo the rotations of each level from the top bit down,
    then Gray-decode and interleave.
    """
    x = codes.astype(np.int64).T.copy()
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            upper = (x[i] & level) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, 0) ^ swap
            x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flips ^= np.where((x[n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flips
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def category(column: str, bits: int = BITS) -> Column:
    """Code of a category: a hash; null has the code 0."""
    return F.when(F.col(column).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit((1 << bits) - 1)))


def magnitude(value: Column, bits: int = BITS) -> Column:
    """Code of a size: its logarithm to base two, the top code for all larger ones."""
    log = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(1.0))))
    return F.least(F.coalesce(log, F.lit(0)), F.lit((1 << bits) - 1))


def text_bytes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def default_dimensions() -> list[Column]:
    return [category("source"), category("lang"), magnitude(F.coalesce(F.octet_length("text"), F.lit(0)) / 8)]


def placed(docs: DataFrame, dimensions: list[Column], bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, cell (place on the curve) and same (hash of the text)."""
    dims = [d.cast("int").alias(f"d{i}") for i, d in enumerate(dimensions)]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("same"),
        *dims,
    )

    @F.pandas_udf("long")
    def cell(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(hilbert_index(np.stack([p.to_numpy() for p in part], axis=1), bits))

    names = [f"d{i}" for i in range(len(dims))]
    return rows.withColumn("cell", cell(*names)).drop(*names)


def running(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """``rows`` with ``before`` (sum of sizes) and ``place`` (number of rows) ahead in the order."""
    n = slices_of(rows)
    cut = rows.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id())
    cut = stored(cut, "slices")
    inside = Window.partitionBy("slice").orderBy(*order)
    ahead = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per slice, so the window without partitions stays small.
    above = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("slice").agg(F.sum(size).alias("_size"), F.count(F.lit(1)).alias("_rows"))
    starts = totals.select("slice", F.coalesce(F.sum("_size").over(above), F.lit(0)).alias("_before"), F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_place"))
    local = cut.withColumns({"_sum": F.sum(size).over(ahead) - F.col(size), "_number": F.row_number().over(inside) - 1})
    joined = local.join(F.broadcast(starts), "slice")  # a row per slice of a million rows
    return joined.withColumns({"before": F.col("_sum") + F.col("_before"), "place": F.col("_number") + F.col("_place")}).drop("slice", "_sum", "_number", "_before", "_place")


def cuts(rows: DataFrame, n_shards: int) -> list[int]:
    """Places (sums of sizes) at which shards 1 and up begin, ascending."""
    total, largest = rows.agg(F.sum("size"), F.max("size")).first()
    if total is None:
        return []
    wanted = [total * k // n_shards for k in range(1, n_shards)]
    marks = F.array(*[F.lit(w).cast("long") for w in wanted]) if wanted else F.array().cast("array<long>")
    held = F.filter(marks, lambda m: (F.col("before") <= m) & (m < F.col("before") + F.col("size")))
    # At most one row per cut comes back: its group and the place nearest to the cut.
    at = rows.select("cell", "same", "before", "size", F.explode(held).alias("mark")).collect()
    groups = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(r.cell, r.same) for r in at], "cell long, same long").distinct()), ["cell", "same"])
    spans = {(r.cell, r.same): r for r in groups.groupBy("cell", "same").agg(F.min("before").alias("low"), F.sum("size").alias("bytes")).collect()}
    out = []
    for r in sorted(at, key=lambda r: r.mark):
        group = spans[r.cell, r.same]
        near = r.before if r.mark - r.before <= r.before + r.size - r.mark else r.before + r.size
        whole = group.low if r.mark - group.low <= group.low + group.bytes - r.mark else group.low + group.bytes
        out.append(whole if group.bytes <= largest else near)
    return out


def shards(docs: DataFrame, n_shards: int = 24, dimensions: list[Column] | None = None) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, slot, cell."""
    order = ["cell", "same", "doc_id", "text_crc32"]
    single = stored(placed(docs, dimensions or default_dimensions()), "cells")
    copies = single.groupBy("same").agg(F.min("cell").alias("_least"), F.max("cell").alias("_most")).filter("_least < _most")
    together = single.join(stored(copies.drop("_most"), "copies"), "same", "left").withColumn("cell", F.coalesce("_least", "cell")).drop("_least")
    rows = stored(running(together, order), "places")
    begins = cuts(rows, n_shards)
    shard = sum((F.when(F.col("before") >= b, 1).otherwise(0) for b in begins), F.lit(0))
    numbered = rows.withColumn("shard", shard.cast("int"))
    firsts = F.broadcast(numbered.groupBy("shard").agg(F.min("place").alias("_first")))  # a row per shard
    slot = (F.col("place") - F.col("_first")).cast("long")
    return numbered.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "cell")


def write_shards(docs: DataFrame, folder: str, n_shards: int = 24) -> DataFrame:
    """All columns of ``docs`` as Parquet, a folder per shard, in the order of the curve; returns the assignment.

    The shard is the partition column ``_shard``, with more underscores where ``docs`` has that name.
    Rows with one id and texts of equal CRC share a place.
    """
    assigned = stored(shards(docs, n_shards).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"]), "shards")
    id_, crc, to, shard, slot = (free_name(docs, n) for n in ("_id", "_crc", "_to", "_shard", "_slot"))
    keyed = docs.withColumn(crc, F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long"))
    places = assigned.select(F.col("doc_id").alias(id_), F.col("text_crc32").alias(to), F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = keyed.join(places, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(crc) == F.col(to)))
    ordered = joined.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    ordered.drop(crc, id_, to, slot).write.partitionBy(shard).parquet(folder)
    return assigned
