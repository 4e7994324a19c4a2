"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pokerlake.llm import decontamination, embedding_links, host_reputation, license_scan, merkle, mixing, near_duplicates, oracles, periodic_runs, sharding, substring_dedup, token_counts, token_files, toxicity
from pokerlake.llm.common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_token_files")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_files.read_digests(token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json")))


@query("op10_token_counts")
def _(spark, sf_dir):
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op7_mixing")
def _(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.scored(docs.select("doc_id", "text", "lang"), model)
    score = F.col("_score")
    return rows.select("doc_id", (toxicity.remainder() == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), toxicity.is_toxic(model).cast("int").alias("by_lang"))


@query("op5_decontamination")
def _(spark, sf_dir):
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_hilbert_sharding")
def _(spark, sf_dir):
    rows = sharding.shards(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


@query("op1_substring_dedup", oracles.SUBSTRING_DEDUP)
def _(spark, sf_dir):
    return substring_dedup.dedupe_substrings(table(spark, sf_dir, "documents"))


@query("op6_near_duplicates", oracles.NEAR_DUPLICATES)
def _(spark, sf_dir):
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


@query("op2_embedding_links", oracles.EMBEDDING_LINKS)
def _(spark, sf_dir):
    return embedding_links.links(table(spark, sf_dir, "embeddings"))


@query("op9_license_scan")
def _(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs", oracles.PERIODIC_RUNS)
def _(spark, sf_dir):
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")))


@query("op12_merkle_manifest", oracles.MERKLE_MANIFEST)
def _(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_rows())


#: The rules of the query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op13_host_reputation", oracles.HOST_REPUTATION)
def _(spark, sf_dir):
    pages = host_reputation.outcomes_of(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return host_reputation.filter_urls(pages, URL_RULES)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
