import duckdb
import pytest

from lamplight.plans import catalog, enriched, registry, rules  # noqa: F401  (all but registry register queries)
from tests.oracle import agree

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, name):
    agree(spark, SF, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_titles_cut_within_references_agree_with_sql(spark, tmp_path):
    titles = ["a &amp; b&amp", "a&quot", "a&#3", "a&am", "R&D &ampx; &lt;b&gt;", " &#x27;a&#39;  \n b &"]
    spark.createDataFrame([(i, "http://h/", f"<html><head><title>{x}</title></head><body><p>&amp</p></body></html>") for i, x in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in registry.QUERIES["html_title"](spark, str(tmp_path)).collect()}
    sql = registry.SQL["html_title"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(duckdb.sql(sql).fetchall()) and got[0] == "a & b&amp"


def test_facets_search_whole_texts(spark):
    tables = {"documents": spark.createDataFrame([(1, "xx", "s", "z" * 300 + " The end"), (2, "xx", "s", "z" * 300)], "doc_id long, lang string, source string, text string"), "labels": spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")}
    assert [r["doc_id"] for r in catalog.facet_filter(tables.get, spark).collect()] == [1]
