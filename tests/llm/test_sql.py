"""Registered queries of this package against their SQL twins, on whole tables."""

import duckdb
import pytest

from florilege.llm import queries, redirects
from tests.llm.test_texts import PAGES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(result, columns):
    names = [c[0] for c in result.description]
    return sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_twins(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    assert sorted(str(tuple(r)) for r in df.collect()) == rows_of(con.execute(queries.ORACLES[name]), df.columns)


def test_redirect_twin_on_links(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    got = redirects.judge(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == rows_of(con.execute(queries.ORACLES["op9_redirects"]), got.columns)
