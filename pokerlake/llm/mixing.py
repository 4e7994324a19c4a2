"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by a hash of id and text into a fixed number of blocks, rows that
repeat both by a number of their own, so that no block holds more than its share. A
source's target says how many passes over it the mix takes; the last pass is partial and
takes whole blocks, in permuted order, that fit what is still missing. The draws of all
sources are divided among output shards by a tree: a node splits its shards in halves and
draws, without replacement, how many blocks of each source go left, so every quota is a
whole number and all quotas add up. A shard then gets the next run of each source's
permuted draws, so draws are disjoint, and sorts its documents by a hash.

The words a document gives are counted from the draws that the tree has handed to a shard. Two
numbers per source pass through the driver; names, blocks and documents stay in Spark. A
block of a source is a group of at most ``BLOCKS`` rows of sums.

Null sources form a source of their own, last in order. Null and empty texts have no words
and go with their block. Of equal rows some may be taken and others not; which ones follows the
order in which the input is read. No documents: no rows. A column of the input keeps its name;
those added are listed at each function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pokerlake.llm.common import stored
from pokerlake.llm.sharding import running

BLOCKS = 1024
WEIGHTS = (5, 2, 1)


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; excess is shared again."""
    target, full = np.zeros(len(sizes)), sizes <= 0
    while not full.all():
        rest = total - target[full].sum()
        target[~full] = rest * weights[~full] / weights[~full].sum()
        over = ~full & (target >= most * sizes)
        if not over.any():
            break
        target[over] = most * sizes[over]
        full |= over
    return target


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns add up to ``quotas``."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def divide(low: int, high: int, rest: np.ndarray) -> None:
        if high - low == 1:
            out[low] = rest
            return
        middle = (low + high) // 2
        draws = int(rest.sum()) * (middle - low) // (high - low)
        generator = np.random.default_rng([seed, low, high])
        left = generator.multivariate_hypergeometric(rest, draws, method="marginals") if draws else np.zeros_like(rest)
        divide(low, middle, left)
        divide(middle, high, rest - left)

    divide(0, shards, quotas.astype(np.int64))
    return out


def _order(blocks: pd.Series, number: int, turn: int, seed: int) -> np.ndarray:
    """Permutation of a source's blocks for one pass."""
    keys = np.random.default_rng([seed, number, turn]).random(BLOCKS)
    return np.argsort(keys[blocks.to_numpy()], kind="stable")


def _draws(seed: int):
    """Draws of one source: whole passes over all blocks, then the blocks that fit the rest."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        number, size, target = int(rows.number[0]), int(rows.source_size[0]), float(rows.target[0])
        whole = min(2, int(target // size)) if size else 0
        parts = [rows.block.to_numpy()[_order(rows.block, number, turn, seed)] for turn in range(whole)]
        missing, picked, words = target - whole * size, [], rows.words.to_numpy()
        order = _order(rows.block, number, whole, seed)
        for at in order if whole < 2 else ():
            if words[at] <= missing:
                picked.append(at)
                missing -= words[at]
        taken = set(picked)
        left = [at for at in order if at not in taken and words[at] < 2 * missing] if whole < 2 else []
        if left:  # one more block, if it brings the sum nearer
            picked.append(min(left, key=lambda at: abs(words[at] - missing)))
        parts.append(rows.block.to_numpy()[np.array(picked, np.int64)])
        out = pd.DataFrame({"block": np.concatenate(parts), "turn": np.repeat(np.arange(len(parts)), [len(p) for p in parts])})
        out["draw"] = np.arange(len(out))
        out.insert(0, "number", number)
        out.insert(0, "source_key", rows.source_key[0])
        return out

    return draw


def placed(docs: DataFrame, seed: int = 7, with_row: bool = False) -> DataFrame:
    """A row per document: doc_id, source_key, block, size, on request ``row`` with all columns of ``docs``."""
    columns = ["doc_id", source_key("source").alias("source_key"), F.xxhash64("text").alias("text_hash"), word_count().alias("size")]
    base = docs.select(*columns, F.monotonically_increasing_id().alias("nr"), *([F.struct(*docs.columns).alias("row")] if with_row else []))
    base = stored(base, "sizes")  # the numbers are drawn once
    same = ["doc_id", "text_hash"]
    repeated = base.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in same])
    equal = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    known = base.join(stored(repeated, "repeated"), equal, "left")
    # A null is left out of the hash.
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash", F.when(F.col("_text_hash").isNotNull(), F.col("nr"))), F.lit(BLOCKS))
    return known.select("doc_id", "source_key", block.cast("int").alias("block"), "size", *(["row"] if with_row else []))


def draw_blocks(sized: DataFrame, shards: int = 16, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7):
    """(sources, draws) for the rows of ``placed``.

    sources: source_key, number, source_size, target. draws: source_key, block, turn, draw and
    the shard that the tree gives the draw to.
    """
    spark = sized.sparkSession
    blocks = stored(sized.groupBy("source_key", "block").agg(F.sum("size").alias("words")), "blocks")
    names = running(blocks.groupBy("source_key").agg(F.sum("words").alias("source_size")), ["source_key"], "source_size")
    names = stored(names.select("source_key", F.col("place").alias("number"), "source_size"), "sources")
    sizes = names.orderBy("number").select("source_size").toPandas()["source_size"].to_numpy(np.float64)
    parts = np.resize(np.array(weights, np.float64), len(sizes))
    target = targets(sizes, parts, share * sizes.sum(), most)
    goals = spark.createDataFrame([(i, float(t)) for i, t in enumerate(target)], "number long, target double")
    sources = stored(names.join(goals, "number"), "targets")
    drawn = stored(blocks.join(sources, "source_key").groupBy("source_key").applyInPandas(_draws(seed), "source_key string, number long, block int, turn int, draw long"), "draws")
    quota = np.zeros(len(sizes), np.int64)
    for r in drawn.groupBy("number").count().toLocalIterator():
        quota[r["number"]] = r["count"]
    ends = np.cumsum(split_quotas(quota, shards, seed), axis=0)
    bounds = spark.createDataFrame([(i, ends[:, i].tolist()) for i in range(len(sizes))], "number long, ends array<long>")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("draw")))
    return sources, drawn.join(bounds, "number").select("source_key", "block", "turn", "draw", shard.alias("shard"))


def source_key(source: str):
    """The source as a key without nulls that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def taken_words(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and ``shards``, where its copies are (ascending)."""
    sized = placed(docs, seed)
    sources, draws = draw_blocks(sized, seed=seed, **options)
    given = draws.groupBy("source_key", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # at most two draws
    joined = sized.join(given, ["source_key", "block"], "left").join(sources, "source_key")
    at = F.coalesce("shards", F.array().cast("array<int>"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size(at)).cast("long").alias("taken"), at.alias("shards"))


def mixed(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself, a row per draw: ``row`` (a row of ``docs``), ``shard`` and ``place`` (order inside the shard)."""
    rows = placed(docs, seed, with_row=True)
    _, draws = draw_blocks(rows.drop("row"), seed=seed, **options)
    place = F.xxhash64(F.lit(seed), "row.doc_id", "turn")
    return rows.join(draws, ["source_key", "block"]).select("row", "shard", place.alias("place"))


def in_order(mix: DataFrame) -> DataFrame:
    """The mix shard after shard, each shuffled by its places; a shard of any size is cut where the order allows."""
    return mix.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def write_shards(mix: DataFrame, folder: str) -> None:
    """One folder per shard, each shard in its local order; large shards become several files."""
    in_order(mix).write.partitionBy("shard").parquet(folder)


def shard_sizes(draws: DataFrame) -> DataFrame:
    """Number of draws of each shard, and the running total."""
    sizes = draws.groupBy("shard").agg(F.count(F.lit(1)).alias("draws"))
    return sizes.withColumn("before", F.sum("draws").over(Window.orderBy("shard")) - F.col("draws"))
