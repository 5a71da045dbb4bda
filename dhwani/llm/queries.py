"""Registered queries of the training-data operators, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhwani.llm import ann, bpe, chat, decontam, licenses, linededup, lmscore, setjoin, toxicity, urlfilter
from dhwani.llm.common import table


def vocabulary_path() -> str:
    """Place of the byte-level vocabulary; it must be the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.score(table(spark, sf_dir, "documents"), good)


def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_classifier_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.read_back(chat.packs(rows.union(probe)))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "matched", "total", "n_units")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_learned_partitions, op2_cross_entropy_difference, op3_qgram_decontamination, op4_classifier_chains, op5_chat_prefix_tree, op6_ngram_jaccard_join, op7_url_range_join, op8_bpe,
        op9_line_dedup, op10_license_scan,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_prefix_tree": chat.ORACLE, "op6_ngram_jaccard_join": setjoin.ORACLE, "op7_url_range_join": urlfilter.ORACLE, "op9_line_dedup": linededup.ORACLE, "op10_license_scan": licenses.oracle_sql()}
