"""Corpus pipeline: from ``documents`` to token files, a stage per operator.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of ``documents``. Nulls, empty texts, ties, repeated rows, empty
tables and extra columns have the results that the operators state; columns of the input
are kept as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pokerlake.llm import decontamination, mixing, near_duplicates, token_files, toxicity
from pokerlake.llm.common import free_name, ship, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of their language stay."""
    ship(spark)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return toxicity.scored(docs, model, score).filter(~toxicity.is_toxic(model, score)).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; of equal rows one."""
    ship(spark)
    kept_id, text_hash = free_name(docs, "_kept_id"), free_name(docs, "_text_hash")
    kept = near_duplicates.classes(docs).filter("kept").select(F.col("doc_id").alias(kept_id))
    one = docs.withColumn(text_hash, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    return one.dropDuplicates(["doc_id", text_hash]).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage stay."""
    ship(spark)
    mark = free_name(docs, "_contaminated")
    marked = decontamination.marked(docs, _table(spark, sf_dir, "benchmark"), mark)
    return marked.filter(~F.col(mark)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shard after shard in local order: a document that it takes twice is there twice, one that it leaves out is gone."""
    ship(spark)
    return mixing.in_order(mixing.mixed(docs)).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32 of each document."""
    ship(spark)
    return token_files.read_digests(token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mix),
    ("token_files", token_ids),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
