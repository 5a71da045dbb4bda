"""Sources, evaluation, sinks and streams on small files."""

import pytest
from pyspark.sql import functions as F

from dhwani.operators import evaluate as E
from dhwani.sources import lines as S
from dhwani.streaming import tokens as stream

LEXICON = "# head\n নাম\tn a m\ttadbhava\nকম\tk  O m\n\nকম\tk o  m\t\nএকা\n  # x\ty\nনাম\tn a m\n"
WORDS = "# list\nনাম\n কম \n #kept\n\nকথা\nনাম\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "lex.tsv").write_text(LEXICON, encoding="utf-8")
    (tmp_path / "words.txt").write_text(WORDS, encoding="utf-8")
    return tmp_path


def test_sources(spark, files):
    lex = S.lexicon(spark, str(files / "lex.tsv"))
    assert sorted(map(tuple, lex.collect())) == [("কম", "k - o - m", None), ("নাম", "n - a - m", "tadbhava")]
    assert S.lexicon(spark, str(files / "none.tsv")).count() == 0
    words = S.words(spark, str(files / "words.txt"))
    assert [r.word for r in words.orderBy("line_no").collect()] == ["নাম", "কম", "#kept", "কথা", "নাম"]
    with pytest.raises(FileNotFoundError):
        S.words(spark, str(files / "none.txt"))


def test_evaluation(spark, files):
    got = E.evaluated(S.words(spark, str(files / "words.txt")), S.lexicon(spark, str(files / "lex.tsv")))
    rows = got.orderBy("line_no").collect()
    assert [(r["Word"], r["Match"]) for r in rows] == [("নাম", "✅"), ("কম", "✅"), ("#kept", "?"), ("কথা", "?"), ("নাম", "✅")]
    total = E.summary(got).first()
    assert (total.words, total.verified, total.correct, total.engine_accuracy_pct, total.lexicon_coverage_pct) == (5, 3, 3, 100.0, 60.0)
    empty = E.summary(got.where("false")).first()
    assert (empty.words, empty.engine_accuracy_pct, empty.lexicon_coverage_pct) == (0, 0.0, None)
    E.write_results(got, str(files / "out"))
    back = spark.read.option("header", True).csv(str(files / "out"))
    assert back.columns == ["Word", "Engine Output", "Lexicon Answer", "Final Output", "Match", "Notes"] and back.count() == 5
    E.write_results(got, str(files / "bom"), bom=True)
    (part,) = (files / "bom").glob("part-*.csv")
    assert part.read_bytes().startswith("\ufeffWord,".encode())
    shown = [r.shown for r in E.display_rows(got).orderBy("line_no").collect()]
    assert shown[0] == f"  ✅  {'নাম':<20} n - a - m" and shown[2].startswith("  ?  #kept")
    assert spark.range(1).select(E.display_mark(F.lit("❌"), F.lit("x"))).first()[0] == "🔄"


def test_stream(spark, files):
    (files / "in").mkdir()
    (files / "in" / "a.txt").write_text("আমি ১০\n\nQUIT\nনাম\n", encoding="utf-8")
    query = stream.start(stream.tokens(stream.lines(spark, str(files / "in"))), str(files / "cp"), "memory", queryName="said")
    query.processAllAvailable()
    query.stop()
    rows = {r.text: r.read_as for r in spark.sql("select * from said").collect()}
    assert rows == {"আমি ১০": "a - m - i - | - d - o - sh", "নাম": "n - a - m"}
    words = stream.lines(spark, str(files / "in")).withColumnRenamed("text", "word")
    S.lexicon(spark, str(files / "lex.tsv")).write.parquet(str(files / "lex"))
    query = stream.start(stream.answered(words, spark.read.parquet(str(files / "lex"))), str(files / "cp2"), "memory", queryName="told")
    query.processAllAvailable()
    query.stop()
    assert {r.word: r.pronunciation for r in spark.sql("select * from told").collect()} == {"আমি ১০": "", "নাম": "n - a - m"}


def test_session_ends_at_a_quit_word(spark, files):
    (files / "typed").mkdir()
    (files / "typed" / "a.txt").write_text("নাম\n\n কম \n Quit \nনাম\n", encoding="utf-8")
    said = []
    ended = stream.session(spark, str(files / "typed"), str(files / "cp3"), lambda rows: said.extend(rows.orderBy("line_no").collect()), 60)
    assert ended and [r.read_as for r in said] == ["n - a - m", "k - o - m"]


def test_stage_trace(spark):
    rows = E.stage_trace(spark.createDataFrame([(1, "কম।")], "id long, text string")).orderBy("step").collect()
    assert [(r.stage, r.value) for r in rows] == [("RAW", "কম।"), ("NORMALIZED", "কম"), ("PHONEMES", "k o m"), ("READ AS", "k - o - m")]
