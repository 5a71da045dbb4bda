"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from dhwani.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}/*.parquet" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.select(order).fetchall())


def test_goldens(spark):
    assert all(r["pass"] for r in catalog.QUERIES["goldens"](spark, SF).collect())


def test_goldens_hold_the_self_test(spark):
    found = {r["word"] for r in catalog.QUERIES["goldens"](spark, SF).collect()}
    assert {"আমরা", "তোমরা", "সকাল", "করছি", "কম", "বাংলা", "জ্ঞান", "বিজ্ঞান", "সময়", "বিষয়", "হয়"} <= found
