"""The registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

import os

import duckdb
import pytest

from dhwani.llm import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows):
    return sorted(tuple(map(str, row)) for row in rows)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}/*.parquet" if os.path.isdir(f"{SF}/{t}") else f"{SF}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    got, want = q.queries()[name](spark, SF), con.sql(q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.select(", ".join(columns)).fetchall())


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in c.STAGES:
        docs = c.written(stage(spark, docs, SF), name)
        if name != "bpe":
            assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "bpe"]
    assert docs.join(q.decontam.leaks(spark.read.parquet(f"{SF}/documents.parquet"), bench), "doc_id", "left_semi").count() == 0
