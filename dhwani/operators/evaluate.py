"""Batch evaluation of spoken forms against a lexicon, and risk flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dhwani.functions.phonemes import phonemes, readable, risks
from dhwani.functions.tables import RISK_LABELS
from dhwani.functions.text import normalize, strip_ws

RIGHT, WRONG, UNKNOWN, REPLACED = "✅", "❌", "?", "🔄"
#: Distinct words, and their bytes, that the lexicon may have for its side of the join to be broadcast.
BROADCAST_WORDS, BROADCAST_BYTES = 200_000, 16 << 20
BOM = "\ufeff"


def with_tokens(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds normalized, phonemes and read_as: the whole path from raw text to tokens."""
    return (
        texts.withColumn("normalized", normalize(F.col(column)))
        .withColumn("phonemes", phonemes(F.col("normalized")))
        .withColumn("read_as", readable(F.col("phonemes")))
    )


def joined(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words with pronunciation and register, empty where the lexicon has none; keyed on the stripped word.

    The lexicon is broadcast only when a check of its size allows it.
    """
    answers = lexicon.select(F.col("word").alias("__word"), "pronunciation", "register")
    size = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in answers.columns)
    found = answers.limit(BROADCAST_WORDS + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    if found[0] <= BROADCAST_WORDS and (found[1] or 0) <= BROADCAST_BYTES:
        answers = F.broadcast(answers)
    rows = words.join(answers, strip_ws(F.col("word")) == F.col("__word"), "left").drop("__word")
    return rows.withColumn("pronunciation", F.coalesce("pronunciation", F.lit("")))


def match_mark(spoken: Column, answer: Column) -> Column:
    return F.when(answer == "", UNKNOWN).when(spoken == answer, RIGHT).otherwise(WRONG)


def evaluated(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One result row per word: line_no and the six result columns. Each distinct word is spoken once."""
    heard = words.select(F.col("word").alias("__heard")).distinct().withColumn("__spoken", readable(phonemes(normalize(F.col("__heard")))))
    rows = joined(words, lexicon).join(heard, F.col("word").eqNullSafe(F.col("__heard")))
    answer, spoken = F.col("pronunciation"), F.col("__spoken")
    return rows.select(
        "line_no", F.col("word").alias("Word"), spoken.alias("Engine Output"), answer.alias("Lexicon Answer"),
        F.when(answer != "", answer).otherwise(spoken).alias("Final Output"), match_mark(spoken, answer).alias("Match"), F.lit("").alias("Notes"))


def stage_trace(texts: DataFrame, column: str = "text") -> DataFrame:
    """All columns of ``texts`` with (step, stage, value): the text as it is, normalised, as tokens and as read."""
    rows = with_tokens(texts, column)
    steps = (("RAW", F.col(column)), ("NORMALIZED", F.col("normalized")), ("PHONEMES", F.array_join("phonemes", " ")), ("READ AS", F.col("read_as")))
    steps = F.array(*[F.struct(F.lit(n + 1).alias("step"), F.lit(name).alias("stage"), value.alias("value")) for n, (name, value) in enumerate(steps)])
    return rows.select(*texts.columns, F.inline(steps))


def display_rows(results: DataFrame) -> DataFrame:
    """(line_no, shown): mark, word padded to twenty places and final output, as one console line a word."""
    answer = F.col("Lexicon Answer")
    padded = F.when(F.char_length("Word") < 20, F.rpad("Word", 20, " ")).otherwise(F.col("Word"))
    return results.select("line_no", F.concat(F.lit("  "), display_mark(F.col("Match"), answer), F.lit("  "), padded, F.lit(" "), F.col("Final Output")).alias("shown"))


def display_mark(match: Column, answer: Column) -> Column:
    return F.when((match == WRONG) & (answer != ""), REPLACED).otherwise(match)


def summary(results: DataFrame) -> DataFrame:
    """Totals, marks, engine accuracy of verified words and the share of words the lexicon covers, in percent."""
    count = lambda mark: F.count_if(F.col("Match") == mark)
    right, wrong, unknown, total = count(RIGHT), count(WRONG), count(UNKNOWN), F.count(F.lit(1))
    return results.agg(
        total.alias("words"), (right + wrong).alias("verified"), right.alias("correct"), wrong.alias("corrected"), unknown.alias("unknown"),
        F.coalesce(F.try_divide(right * 100.0, right + wrong), F.lit(0.0)).alias("engine_accuracy_pct"),
        F.when(right + wrong > 0, F.round((right + wrong) * 100.0 / total, 1)).alias("lexicon_coverage_pct"),
        F.coalesce(F.bool_and(F.col("Match") != WRONG), F.lit(True)).alias("all_pass"))


def risk_rows(words: DataFrame, column: str = "word") -> DataFrame:
    """All columns of ``words`` with (pos, rule, code, detail), a row for every risk."""
    return words.withColumn("__risk", F.explode(risks(F.col(column)))).select(*words.columns, "__risk.*")


def risk_label(code: Column) -> Column:
    labels = F.map_from_arrays(F.array(*map(F.lit, RISK_LABELS)), F.array(*map(F.lit, RISK_LABELS.values())))
    return F.try_element_at(labels, code)


def per_distinct_word(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n, read_as) of the distinct whitespace-separated words of normalised texts.

    No rule reaches across white space, so each distinct word is spoken once; counts are combined on
    the map side first.
    """
    found = texts.select(F.explode(F.split(normalize(F.col(column)), " ")).alias("word")).where("word <> ''")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("read_as", readable(phonemes(F.col("word"))))


def write_results(results: DataFrame, path: str, bom: bool = False, one_file: bool = True) -> None:
    """CSV with a header, in input order; ``bom`` puts a byte order mark in front of the header.

    One file, as the result of one evaluation run; with ``one_file`` False as many as the sorted result
    has partitions, whose names follow the order, each with a header.
    """
    columns = [c for c in results.columns if c != "line_no"]
    rows = results.orderBy("line_no").select(*columns)
    if bom:
        rows = rows.withColumnRenamed(columns[0], BOM + columns[0])
    rows = rows.coalesce(1) if one_file else rows
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
