"""Every query with SQL gives what DuckDB gives, on the smallest tables; queries without SQL run."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CORE = {n: q for m in entry._MODULES for n, q in __import__(m, fromlist=["QUERIES"]).QUERIES.items()}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert CORE[name](spark, SF).count() >= 0
    else:
        same, note = compare(spark, name, CORE[name], sql, SF, con)
        assert same, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_url_keys_of_long_links(spark, tmp_path):
    links = ["https://board.example/" + "a" * n + tail for n in (10, 989, 990, 991, 3000) for tail in ("/x", "/y")]
    spark.createDataFrame(list(enumerate(links)), "row_id long, url string").selectExpr("*", "row_id as source_listing_id").write.parquet(f"{tmp_path}/index_rows.parquet")
    got = {r["row_id"]: r["url_key"] for r in CORE["text_url_keys"](spark, str(tmp_path)).collect()}
    assert got == {i: f"{u}?id={i}" for i, u in enumerate(links)}
