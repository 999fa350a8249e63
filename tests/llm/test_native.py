"""URL filters and line dedup: SQL on small tables, hand-made edge cases."""

import os

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import line_dedup, queries, url_filters
from gradeloom.llm.url_filters import Rule
from tests.oracle import SMALL, connect, same_rows

tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SMALL), connect(), queries.SQL[name])


URLS = [
    (1, "http://Example.ORG/en/17?x=1", "example.org", "/en/17", "example.org/en/1", "block"),
    (2, "http://a.b.example.org/en/2", "a.b.example.org", "/en/2", "org/", "allow"),
    (3, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (4, "https://x.com/de/1#f", "x.com", "/de/1", "com/de/", "block"),
    (5, "https://x.com/DE/1", "x.com", "/DE/1", None, "allow"),
    (6, "http://example.org", "example.org", "", None, "allow"),
    (7, "example.org/es/", "", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "http://x.net/r?u=http://example.org/es/", "x.net", "/r", None, "allow"),
    (10, "http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    (10, "http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    (None, "", "", "", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(a, b, "kept", "mine") for a, b, *_ in URLS], "page_id long, url string, other string, rule string")
    got = url_filters.filter_urls(pages, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, [(r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()])) == sorted(map(repr, URLS))
    assert url_filters.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filters.filter_urls(pages, [], default="block").collect()} == {"block"}


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = [Rule("a.com", "/x/y", "block"), Rule("a.com", "/z/", "block")]
    pages = spark.createDataFrame([("http://a.com/x/1",), ("http://a.com/z/1",), ("http://a.com/z/2",), ("http://b.com/",)], "url string")
    counts = url_filters.token_counts(pages, rules)
    assert counts == {"h:a": 3, "h:com": 4, "p:x": 1, "p:z": 2}
    assert {k: [r.path for r in v] for k, v in url_filters.rarest_token_index(rules, counts).items()} == {"p:x": ["/x/y"], "p:z": ["/z/"]}


def test_rules_need_a_token(spark):
    with pytest.raises(ValueError):
        url_filters.filter_urls(spark.createDataFrame([("u",)], "url string"), [Rule("", "/", "block")])


def test_long_rule_lists_are_joined(spark, monkeypatch):
    pages = spark.createDataFrame([(a, b, "kept", "mine") for a, b, *_ in URLS], "page_id long, url string, other string, Rule string")
    expected = sorted(map(repr, url_filters.filter_urls(pages, queries.URL_RULES).collect()))
    monkeypatch.setattr(url_filters, "PLAN_RULES", 2)
    assert sorted(map(repr, url_filters.filter_urls(pages, queries.URL_RULES).collect())) == expected
    assert url_filters.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_lines_of_many_documents_go(spark):
    docs = [(i, f"\t Shared LINE \nown {i}\n\n  \n", "s", 7) for i in range(3)]
    docs += [(3, None, "s", 7), (4, "", "s", 7), (5, "shared line", "s", 7), (5, "shared line", "s", 7), (6, "É\né", "s", 7), (7, "É", "s", 7), (8, "É", "s", 7), (None, "shared line\nx", "s", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_lines int")
    got = line_dedup.drop_common_lines(df, min_docs=3)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    found = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr)
    expected = [(i, f"own {i}\n\n  \n", 5, 1) for i in range(3)]
    expected += [(3, "", 1, 0), (4, "", 1, 0), (5, "", 1, 1), (5, "", 1, 1), (6, "é", 2, 1), (7, "", 1, 1), (8, "", 1, 1), (None, "x", 2, 1)]
    assert found == sorted(expected, key=repr)
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0


def test_line_repeated_in_one_document_counts_once(spark):
    df = spark.createDataFrame([(1, "a\na\na"), (2, "b")], "doc_id long, text string")
    assert [r["n_dropped"] for r in line_dedup.drop_common_lines(df, min_docs=2).collect()] == [0, 0]


def test_long_text_with_many_dropped_lines(spark):
    text = "\n".join(f"common {i}\nown {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").unionByName(
        spark.createDataFrame([(2, "\n".join(f"common {i}" for i in range(20_000)))], "doc_id long, text string")
    )
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(df, min_docs=2).select("doc_id", "n_dropped", F.length("text").alias("n")).collect()}
    assert got[1]["n_dropped"] == got[2]["n_dropped"] == 20_000
    assert got[2]["n"] == 0
