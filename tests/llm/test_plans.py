"""What the operators' plans read: texts only where texts are needed."""

import os
import re

import pytest

from corpusloom.llm import queries, sharding, urlfilter

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns(text):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^\n]*)>", text)]


def test_sharding_reads_keys(spark):
    text = plan(sharding.assign(spark.read.parquet(f"{SF}/documents.parquet")))
    assert all(x == {"doc_id"} for x in columns(text)) and columns(text)


def test_url_filter_reads_addresses(spark):
    captures = urlfilter.captures_of(spark.read.parquet(f"{SF}/pages.parquet"))
    text = plan(urlfilter.judged(captures, urlfilter.entries_of(captures)))
    assert all(x <= {"page_id", "url"} for x in columns(text)) and columns(text)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["op7_media_tiles", "op9_warc_salvage"])
def test_one_pass_without_a_shuffle(spark, name):
    assert "Exchange" not in plan(queries.QUERIES[name](spark, SF))


def test_queries_cover_the_ten():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import collections

    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    want = collections.Counter(tuple(str(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall())
    assert collections.Counter(tuple(str(r[n]) for n in names) for r in df.collect()) == want
