import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from against_duckdb import DATA, check  # noqa: E402

from quarterloom.llm import registry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    check(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_give_a_row_each(spark, name):
    table, key = ("pages", "page_id") if "html" in name else ("documents", "doc_id")
    got = registry.QUERIES[name](spark, DATA)
    want = spark.read.parquet(f"{DATA}/{table}.parquet")
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in want.select(key).collect())


def test_article_text_of_the_supplied_pages(spark):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in registry.QUERIES["op5_html_text"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)
