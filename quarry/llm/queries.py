"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, langid, mixing, neardup, quality, secrets, shards, substrings, urls
from .common import table


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.duplicates(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_substring_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows cover."""
    return substrings.report(table(spark, sf_dir, "documents"))


def op5_benchmark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document leaks."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of distribution divergence for every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and next shard of every document."""
    return shards.assign(table(spark, sf_dir, "documents"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each blob scanned once."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.articles(table(spark, sf_dir, "pages"))


def op10_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.verdicts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hyperminhash, op2_mix_sources, op3_language_id, op4_substring_parse, op5_benchmark_tiles, op6_quality_rules, op7_shard_tree, op8_secret_ledger, op9_text_density, op10_url_digests)}

ORACLE_SQL: dict[str, str] = {"op1_hyperminhash": neardup.ORACLE, "op4_substring_parse": substrings.ORACLE, "op2_mix_sources": mixing.ORACLE, "op10_url_digests": urls.ORACLE}
