"""Registered queries and the SQL each is compared with.

The driver's tables hold no Bengali, so text queries run on a letter-by-letter transliteration of whole
texts (``BENGALI``), made the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dhwani.functions import phonemes as P
from dhwani.functions import tables as T
from dhwani.functions import text as X
from dhwani.operators import evaluate as E
from dhwani.operators import relational as R
from dhwani.plans import oracles as O
from dhwani.sources import lines as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bengali(text: Column) -> Column:
    return F.translate(F.translate(text, O.UPPER, O.LOWER), O.LOWER, O.BENGALI)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): parts' names as Bengali."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), bengali(F.col("p_name")).alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): benchmark items as Bengali, with Bengali digits in front."""
    number = F.translate(F.col("item_id").cast("string"), "0123456789", T.DIGITS)
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(number, F.lit(" "), bengali(F.col("text"))).alias("text"))


@query(O.DIGITS_TO_ASCII)
def digits_to_ascii(spark, sf_dir):
    return turns(spark, sf_dir).select("id", X.digits_to_ascii(F.col("text")).alias("text"))


@query(O.NUMBER_WORDS)
def number_words(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", X.number_words(F.col("o_orderkey")).alias("words"), X.number_words(F.year("o_orderdate")).alias("year_words"))


@query(O.NORMALIZE_NUMBERS)
def normalize_numbers(spark, sf_dir):
    text = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 7, "0"), F.col("l_quantity").cast("long").cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.normalize_numbers(text).alias("text"))


def _abbreviated(spark, sf_dir):
    n = F.col("p_partkey") % len(T.ABBREVIATIONS)
    short = F.get(F.array(*[F.lit(a) for a, _ in T.ABBREVIATIONS]), n.cast("int"))
    glue = F.get(F.array(*[F.lit(x) for x in O.GLUES]), (F.col("p_partkey") % len(O.GLUES)).cast("int"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(short, F.lit(" "), short, glue, bengali(F.col("p_name")), glue, short).alias("text"))


@query(O.EXPAND_ABBREVIATIONS)
def expand_abbreviations(spark, sf_dir):
    return _abbreviated(spark, sf_dir).select("id", X.expand_abbreviations(F.col("text")).alias("text"))


@query(O.STRIP_LATIN)
def strip_latin(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.strip_latin(F.col("text")), 256).alias("text_sha256"))


@query(O.STRIP_PUNCTUATION)
def strip_punctuation(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.strip_punctuation(F.col("text")), 256).alias("text_sha256"))


@query(O.CLEAN_WHITESPACE)
def clean_whitespace(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean_whitespace(F.col("text")), 256).alias("text_sha256"))


@query(O.NORMALIZE)
def normalize(spark, sf_dir):
    return _abbreviated(spark, sf_dir).unionByName(turns(spark, sf_dir)).select("id", X.normalize(F.col("text")).alias("text"))


@query(O.PREPROCESS)
def preprocess(spark, sf_dir):
    return texts(spark, sf_dir).select("id", X.preprocess(F.translate("text", "ংঁ", "়়")).alias("text"))


@query(O.CHAR_CLASS_HIST)
def char_class_hist(spark, sf_dir):
    chars = turns(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy(X.classify_char(F.col("ch")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(O.SEGMENT)
def segment(spark, sf_dir):
    found = turns(spark, sf_dir).select("id", F.posexplode(P.clusters(X.preprocess(F.col("text")))).alias("pos", "c"))
    return found.select(
        "id", "pos", "c.raw", "c.kind", F.array_join("c.cons", " ").alias("cons"), F.coalesce("c.sign", F.lit("-")).alias("sign"),
        "c.nasal", F.coalesce("c.diac", F.lit("-")).alias("diac"), F.col("c.stops").alias("stops"))


@query(O.WORD_FLAGS)
def word_flags(spark, sf_dir):
    """Neighbour rules from arrays; the SQL side computes them with window functions."""
    flags = lambda a: F.transform(a, lambda x, i: F.struct(
        i.alias("pos"), P.At(a, i).initial().alias("initial"), P.At(a, i).final().alias("final"), P.At(a, i).harmony().alias("harmony"),
        P.At(a, i).penultimate().alias("penultimate"), P.At(a, i).open_e().alias("open_e"), P.At(a, i).keeps_vowel().alias("keeps_vowel"), x["kind"].alias("kind")))
    rows = turns(spark, sf_dir).select("id", F.explode(X.bind(P.clusters(X.preprocess(F.col("text"))), flags)).alias("f")).select("id", "f.*")
    return rows.where("kind <> 'P'").drop("kind")


@query(O.PHONEMES)
def phonemes(spark, sf_dir):
    return turns(spark, sf_dir).select("id", F.array_join(P.phonemes(F.col("text")), " ").alias("tokens"))


@query(O.PHONEMES)
def phonemes_windowed(spark, sf_dir):
    """The relational formulation: one row per cluster, neighbours by lag and lead."""
    return R.phonemes(turns(spark, sf_dir), "id", "text").select("id", F.array_join("phonemes", " ").alias("tokens"))


@query(O.PIPELINE_TOKENS)
def pipeline_tokens(spark, sf_dir):
    rows = E.with_tokens(texts(spark, sf_dir))
    return rows.select("id", "normalized", F.array_join("phonemes", " ").alias("tokens"), "read_as")


LEXICON = O.LEXICON


def lexicon_table(spark: SparkSession) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(LEXICON)), "line_no long, line string")
    return S.parse_lexicon(lines)


def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, word): the words of parts' names, in Bengali."""
    rows = texts(spark, sf_dir).select("id", F.posexplode(F.split("text", " ")).alias("at", "line"))
    return S.parse_words(rows.select((F.col("id") * 100 + F.col("at")).alias("line_no"), "line"))


@query(O.LEXICON_SCAN)
def lexicon_scan(spark, sf_dir):
    return lexicon_table(spark)


@query(O.WORD_SCAN)
def word_scan(spark, sf_dir):
    return word_table(spark, sf_dir)


@query(O.LEXICON_JOIN)
def lexicon_join(spark, sf_dir):
    rows = E.evaluated(word_table(spark, sf_dir), lexicon_table(spark))
    answer = F.col("Lexicon Answer")
    return rows.select("line_no", F.col("Word").alias("word"), answer.alias("answer"), F.col("Final Output").alias("final"), F.col("Match").alias("mark"), E.display_mark(F.col("Match"), answer).alias("shown"), F.col("Notes").alias("notes"))


@query(O.REGISTERS)
def registers(spark, sf_dir):
    rows = E.joined(word_table(spark, sf_dir), lexicon_table(spark))
    return rows.groupBy(F.coalesce("register", F.lit("-")).alias("register")).agg(F.count(F.lit(1)).alias("n"))


@query(O.EVAL_SUMMARY)
def eval_summary(spark, sf_dir):
    return E.summary(E.evaluated(word_table(spark, sf_dir), lexicon_table(spark)))


@query(O.RISK_FLAGS)
def risk_flags(spark, sf_dir):
    return E.risk_rows(turns(spark, sf_dir), "text").select("id", "pos", "rule", "code", "detail")


@query(O.RISK_HIST)
def risk_hist(spark, sf_dir):
    rows = E.risk_rows(texts(spark, sf_dir), "text")
    return rows.groupBy("code", E.risk_label(F.col("code")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(O.DISTINCT_WORDS)
def distinct_words(spark, sf_dir):
    return E.per_distinct_word(texts(spark, sf_dir))


@query(O.SYLLABLES)
def syllables(spark, sf_dir):
    """Constructed words: every conjunct, consonant and vowel with every sign at every place of a word."""
    rows = [(h * 1000 + e * 20 + f, a + x + y + b) for h, x in enumerate(O.HEARTS) for e, y in enumerate(O.ENDS) for f, (a, b) in enumerate(O.FRAMES)]
    return spark.createDataFrame(rows, "id long, text string").select("id", F.array_join(P.phonemes(F.col("text")), " ").alias("tokens"))


@query(O.DOCUMENT_TOKENS)
def document_tokens(spark, sf_dir):
    """Whole documents, as Bengali, to tokens."""
    rows = read(spark, sf_dir, "documents").select("doc_id", P.phonemes(bengali(F.col("text"))).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


@query(O.STAGE_TRACE)
def stage_trace(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate([*O.NORMAL_DEMOS, *O.PATH_DEMOS])), "id long, text string")
    return E.stage_trace(rows).select("id", "step", "stage", "value")


@query(O.RISK_DEMO)
def risk_demo(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(O.RISK_DEMOS)), "id long, text string")
    return E.risk_rows(rows, "text").select("id", "pos", "rule", "code", "detail")


@query(O.DISPLAY_ROWS)
def display_rows(spark, sf_dir):
    return E.display_rows(E.evaluated(word_table(spark, sf_dir), lexicon_table(spark)))


@query(O.GOLDEN_PAIRS)
def goldens(spark, sf_dir):
    """The self-test's pairs: word, expected and found tokens, and whether they agree."""
    rows = spark.createDataFrame(O.GOLDENS, "word string, expected string")
    found = F.array_join(P.phonemes(F.col("word")), " ")
    return rows.select("word", "expected", found.alias("found"), (found == F.col("expected")).alias("pass"))
