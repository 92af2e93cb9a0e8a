"""The queries of the corpus operators against their DuckDB text over the smallest tables, and all of them through the driver's entry."""

import duckdb
import pytest
from test_queries import SF, TABLES, rows

import __spark_entry__
from tidelake.llm import queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("name", "table", "key"), [("op1_url_filters", "pages", "page_id"), ("op2_mixing", "documents", "doc_id"), ("op4_warc", "pages", "page_id"), ("op6_quality_lm", "documents", "doc_id"), ("op12_toxicity", "documents", "doc_id")])
def test_query_without_sql_has_a_row_for_each_of_its_table(spark, duck, name, table, key):
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got[key]) == sorted(x for (x,) in duck.execute(f"SELECT {key} FROM {table}").fetchall())


def test_contract_columns(spark, duck):
    """Hosts, paths, rules and payloads as the contract words them, in SQL."""
    got = queries.op1_url_filters(spark, SF).toPandas()
    sql = r"""SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages"""
    assert rows(got[["page_id", "host", "path"]]) == rows(duck.execute(sql).df())
    fixed = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    for r in got.itertuples():
        fit = [k for k in fixed if (r.host == (h := k.partition("/")[0]) or r.host.endswith("." + h)) and r.path.startswith(k[len(h) :])]
        want = max(fit, key=len) if fit else None
        assert r.rule == want and r.verdict == (fixed[want] if fit else "allow")
    warc = queries.op4_warc(spark, SF).toPandas()
    pages = duck.execute("SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages").df()
    both = warc.merge(pages, on="page_id")
    assert len(both) == len(pages) and (both.payload_bytes == both.n).all()
    assert ((both.record_type == "response") == (both["first"] == both.page_id)).all() and (both.refers_to.fillna(both.page_id) == both["first"]).all()


def test_entry_has_every_query():
    found = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in found if k.startswith("op") and k[2].isdigit()} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
