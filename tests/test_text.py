"""Literal expectations of the text functions."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("query", "typing", "expected"),
    [
        ("the screenshot of my payment error", False, '"payment" OR "error"'),
        ("a screenshot", False, None),
        ("zebr", True, '"zebr"*'),
    ],
)
def test_fts_query(spark, query, typing, expected):
    assert one(spark, T.fts_query(F.lit(query), typing)) == expected


def test_html(spark):
    html = "<html><head><title>x</title></head><style>p{}</style><script>var a='<p>';</script><!-- no --><h1>Trip &amp; plans</h1><p>Fly to  Tokyo on Friday.</p><p>Café &mdash; ramen</p></html>"
    assert one(spark, T.plain_text(F.lit(html))) == "Trip & plans\nFly to Tokyo on Friday.\nCafé — ramen"


@pytest.mark.parametrize(
    ("terms", "expected"),
    [(["k7q2lm"], True), (["trx50"], True), (["4815162342"], True), (["2041"], True), (["417"], False), (["inv", "2041"], False), ([], False)],
)
def test_lookup(spark, terms, expected):
    found = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    assert one(spark, T.is_lookup(found)) is expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("DEBUG=true", False), ("root = true", False), ("Buy milk, eggs and bread tomorrow", True), ("Meeting at 3", False), ("1 2 3 4 5 6 7 8", False)],
)
def test_has_prose(spark, text, expected):
    assert one(spark, T.has_prose(F.lit(text))) is expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("مُحَمَّد", "محمد"), ("أحمد إلى آخر", "احمد الى اخر"), ("مـــد", "مد"), ("ﷲ", "الله"), ("a​b", "a b"), ("co­op", "coop"), ("ＡＢＣ", "ABC"), ("ﬁle", "file")],
)
def test_normalize(text, expected):
    assert T.normalize(text) == expected


@pytest.mark.parametrize(
    ("query", "expected"),
    [("readFile()", ["readfile"]), ("max_batch_size", ["max", "batch", "size"]), ("Foo::bar", ["foo", "bar"]), ("how to read", None), ("reader", None), ("utf8", ["utf8"])],
)
def test_identifier(spark, query, expected):
    assert one(spark, T.identifier(F.lit(query))) == expected


def test_hints_and_code_query(spark):
    assert one(spark, T.kind_hints(F.lit("the podcast in a video"))) == ["video", "audio"]
    assert one(spark, T.kind_hints(F.lit("ভিডিওতে"))) == ["video"]
    assert one(spark, T.code_query(F.lit("Code: parse json"))) == "parse json"
    assert one(spark, T.code_query(F.lit("parse json"))) is None
    assert one(spark, T.line_count(F.lit("a\nb\n"))) == 2
    assert one(spark, T.excerpt(F.lit("a  b\n" * 200), 9)) == "a b a b a…"
    assert [one(spark, T.clock(F.lit(s))) for s in (5, 75, 3700)] == ["0:05", "1:15", "1:01:40"]
