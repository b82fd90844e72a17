"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import linededup, mixing, pieces, quality, sharding, urlrules
from palisade.llm.common import documents, table
from palisade.llm.fingerprints import fingerprints
from palisade.llm.neardup import near_duplicate_groups
from palisade.llm.passages import repeated_passages
from palisade.llm.toxicity import toxicity


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "lang", "target", "copy", "tokens")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return linededup.remove_spread_lines(docs, report=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_mixing": op2_mixing,
        "op3_line_dedup": op3_line_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_sharding": op5_sharding,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_fingerprints": op9_fingerprints,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": urlrules.oracle(),
        "op3_line_dedup": linededup.oracle(),
        "op5_sharding": sharding.oracle(),
    }
