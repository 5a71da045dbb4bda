"""Text sources: word lists and tab-separated lexicons, with line numbers.

A missing lexicon is an empty one; a missing word list is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhwani.functions.tables import WS
from dhwani.functions.text import strip_ws


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of text files, in file and line order.

    ``line_no`` orders lines (by file name, then offset of the split); it is not dense. It is derived
    from the scan's own order, so no shuffle is needed.
    """
    lines = spark.read.text(path)
    return lines.select(F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).alias("line_no"), F.col("value").alias("line"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, pronunciation, register) of a tab-separated lexicon, unique by word.

    Blank lines and lines whose first character is ``#`` are skipped. The last line of a word wins;
    the register is that of its last line with one. Pronunciations are joined by `` - ``.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "word string, pronunciation string, register string")
    return parse_lexicon(numbered(spark, path))


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """The same from a table (line_no, line); for repeated words the largest line_no wins."""
    line = strip_ws(F.col("line"))
    rows = lines.select("line_no", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("parts", F.split("line", "\t", -1)).where(F.size("parts") >= 2)
    spoken = F.regexp_replace(strip_ws(F.get("parts", F.lit(1))), WS + "+", " - ")
    tag = strip_ws(F.coalesce(F.get("parts", F.lit(2)), F.lit("")))
    rows = rows.select("line_no", strip_ws(F.get("parts", F.lit(0))).alias("word"), spoken.alias("pronunciation"), F.when(tag != "", tag).alias("register"))
    return rows.groupBy("word").agg(
        F.max_by("pronunciation", "line_no").alias("pronunciation"),
        F.max_by("register", F.when(F.col("register").isNotNull(), F.col("line_no"))).alias("register"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, word): non-blank lines that do not begin with ``#`` before stripping, stripped."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return parse_words(numbered(spark, path))


def parse_words(lines: DataFrame) -> DataFrame:
    word = strip_ws(F.col("line"))
    return lines.where(~F.col("line").startswith("#")).select("line_no", word.alias("word")).where("word <> ''")
