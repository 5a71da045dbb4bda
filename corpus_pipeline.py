"""Corpus cleaning pipeline: five stages over ``documents``, each written as Parquet and read again.

1. ``toxicity``: classifier chains; documents judged toxic go.
2. ``line_dedup``: lines that stand in an earlier document, or earlier in the same one, or are one edit
   from such a line, are cut; documents of which nothing is left go.
3. ``ngram_jaccard_join``: of each group of near-duplicates the document of smallest id stays.
4. ``decontamination``: documents in which a benchmark item occurs go.
5. ``bpe``: token ids, as little-endian unsigned 32-bit integers, with digests of ids and decoded text.

Models and counts are fitted on each stage's own input. All columns of ``documents`` pass the first four
stages, whatever their names. In every stage: empty tables give empty tables; null and empty texts stay (nothing in them
can repeat or leak; the first stage scores them on no words); repeated rows of a document are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhwani.llm import bpe, decontam, linededup, setjoin, toxicity
from dhwani.llm.common import free_name, table, written
from dhwani.llm.queries import vocabulary_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not judged toxic, as they are; null ids are judged too. Without labels, or without toxic ones, all stay."""
    judged = toxicity.score(docs, table(spark, sf_dir, "labels"), with_row=True)
    return judged.where(~F.col("is_toxic")).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier, by id, text hash (of one id's texts) and place; ``n_chars`` follows the text.

    Documents that lose every line go. Repeated rows keep the same lines; rows with a null id stay as they are.
    """
    lines, kept, near = (free_name(docs, f"line_{x}") for x in ("count", "kept", "near"))
    left = linededup.deduplicated(docs, counts=(lines, kept, near))
    left = left.where((F.col(kept) > 0) | (F.col(lines) == 0)).select(*docs.columns)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents those with its smallest id, as they are; rows with a null id stay.

    All repeated rows of that id stay, and of an id with several texts all its rows, or none.
    """
    return setjoin.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, as they are; rows with a null id stay, those of an id go together."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row; null texts as empty ones, null ids kept."""
    coded = bpe.encoded(docs, vocabulary_path())
    return coded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("decontamination", benchmark_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the fitted models and the tokenizer; ``tests/llm/test_pipeline.py`` compares a whole run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
