"""Queries of the training-data operators over the driver tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tessera.session import scratch_path

from . import chatlog, decontam, htmltext, linededup, merkle, minhash, packing, quality, secrets, toxicity, trie, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.near_lines(_table(spark, sf_dir, "documents"))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(_table(spark, sf_dir, "pages"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


CONTROL_TALK = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(CONTROL_TALK, "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(own.columns).unionByName(own)
    return chatlog.read_back(chatlog.format_conversations(rows))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op13_prefix_trie": op13_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op1_secret_scan": op1_secret_scan,
    "op7_html_text": op7_html_text,
    "op5_toxicity": op5_toxicity,
    "op2_warc_archives": op2_warc_archives,
    "pipeline": corpus_pipeline.run,
    "op6_length_buckets": op6_length_buckets,
    "op4_line_dedup": op4_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filters": op9_url_filters,
}

ORACLE_SQL = {
    "op13_prefix_trie": trie.oracle_sql(),
    "op12_chat_format": chatlog.oracle_sql(extra=CONTROL_TALK),
    "op11_merkle_manifest": merkle.oracle_sql(),
    "op2_warc_archives": warc.oracle_sql(),
    "op6_length_buckets": packing.oracle_sql(),
    "op8_quality_rules": quality.oracle_sql(),
    "op9_url_filters": urlfilter.oracle_sql(),
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
