"""Registered queries of the training-data operators, with DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (divergence, exact_dedup, jaccard_join, mixing, packing, periodic_runs, prefix_table, quality, secret_scan, sharding,
               toxicity, viterbi, wavelet)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, one row per piece."""
    return packing.pack(documents(spark, sf_dir), capacity=2048, end_id=0)


SHARD_LIMIT = 1 << 20


@query("op2_extendible_sharding", sharding.oracle(SHARD_LIMIT))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text by extendible hashing of doc_id."""
    return sharding.shard(documents(spark, sf_dir), SHARD_LIMIT)


@query("op3_source_mixing", mixing.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed by weights 1, 2, 3 to all words, each at most three times."""
    return mixing.mix(documents(spark, sf_dir), weights=(1, 2, 3), share=1.0, max_repeats=3)


@query("op6_exact_dedup", exact_dedup.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents, the largest doc_id staying."""
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, line and repeat counts and compression bands of all documents."""
    return quality.quality(documents(spark, sf_dir))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.shingle_join(documents(spark, sf_dir), k=3, percent=90)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from labelled rows outside the held-out fifth."""
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op9_wavelet_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as wavelet-matrix shards and read back."""
    return wavelet.round_trip(documents(spark, sf_dir), end_id=2)


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return viterbi.token_counts(documents(spark, sf_dir))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: patterns, and candidates that the trained network adds."""
    return secret_scan.secrets(documents(spark, sf_dir))


@query("op11_prefix_table")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the table of last tokens, and decoded again."""
    return prefix_table.round_trip(documents(spark, sf_dir), end_id=2)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which are made to repeat."""
    return periodic_runs.run_digests(documents(spark, sf_dir), plant=True)


@query("op13_source_divergence", divergence.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word shares of every two sources of a language, and each source's ten most peculiar terms."""
    return divergence.divergence(documents(spark, sf_dir), min_docs=10, top=10)
