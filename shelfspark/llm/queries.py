"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelfspark.llm import bpe, chat, decontaminate, exact_dedup, language_model, line_dedup, mixing, near_dedup, pii, prefix_trie, secrets, toxicity, whitening
from shelfspark.llm.common import table

Plan = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_conflict(table(spark, sf_dir, "conversations"))))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents")).drop("doc_key")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixture.select("doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def plans() -> dict[str, Plan]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_near_dedup": op1_near_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_language_model": op3_language_model,
        "op4_chat_format": op4_chat_format,
        "op5_bpe_round_trip": op5_bpe_round_trip,
        "op6_secret_scan": op6_secret_scan,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_pii_sanitise": op8_pii_sanitise,
        "op9_decontaminate": op9_decontaminate,
        "op10_toxicity": op10_toxicity,
        "op11_mix_sources": op11_mix_sources,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_whiten_embeddings": op13_whiten_embeddings,
    }


def oracle() -> dict[str, str]:
    sql = {
        "op2_line_dedup": line_dedup.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_mix_sources": mixing.ORACLE_SQL,
        "op12_prefix_trie": prefix_trie.ORACLE_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: q for name, q in sql.items() if q}
