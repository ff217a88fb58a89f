"""URL, text and masking columns on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailweave.functions import masking, text, urls
from trailweave.functions.urls import RouteOptions


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "route", "data"),
    [
        ("http://a.test/items/42", "/items/*", True),
        ("http://a.test/items/42/edit?x=1#top", "/items/*/edit", True),
        ("http://a.test/page2", "/page#", False),
        ("http://a.test/", "/", False),
        ("http://a.test", "/", False),
        ("http://a.test/0f8fad5b-d9cb-469f-a165-70867728950e", "/*", True),
        ("http://a.test/a%20b/c+d", "/a b/c+d", False),
        ("http://a.test/bad%zz", "/bad%zz", False),
    ],
)
def test_route(spark, url, route, data):
    r = one(spark, urls.route(F.col("u")), u=url)
    assert (r["route"], r["data_driven"]) == (route, data)


def test_route_of_another_origin_is_null(spark):
    assert one(spark, urls.route(F.col("u"), F.lit("http://a.test"))["route"], u="http://b.test/x") is None


def test_query_modes(spark):
    u = "http://a.test/s?b=2&a=1&b=3"
    assert one(spark, urls.route(F.col("u"), options=RouteOptions(query="names"))["route"], u=u) == "/s?a&b"
    assert one(spark, urls.route(F.col("u"), options=RouteOptions())["route"], u=u) == "/s"


def test_document_url_keeps_hash_routes(spark):
    assert one(spark, urls.document_url(F.col("u")), u="http://a.test/x#part") == "http://a.test/x"
    assert one(spark, urls.document_url(F.col("u")), u="http://a.test/x#/part") == "http://a.test/x#/part"


@pytest.mark.parametrize(("s", "out"), [("1,234 rows", "# rows"), ("v4.5 of 10", "v# of #"), ("none", "none"), ("", "")])
def test_fold_digits(spark, s, out):
    assert one(spark, text.fold_digits(F.col("s")), s=s) == out


def test_squeeze_knows_wide_space(spark):
    assert one(spark, text.squeeze(F.col("s")), s=" a　  b\t") == "a b"


def test_scrub_takes_longer_values_first(spark):
    assert one(spark, text.scrub(F.col("s"), F.col("v")), s="Edit Alpha Beta now", v=["Alpha", "Alpha Beta", "x"]) == "Edit * now"


def test_clip_and_escape(spark):
    assert one(spark, text.clip(F.col("s"), 3), s="abcd") == "abc…"
    assert one(spark, text.clip(F.col("s"), 4), s="abcd") == "abcd"
    assert one(spark, text.html_escape(F.col("s")), s="<a & 'b'>") == "&lt;a &amp; &#39;b&#39;&gt;"


def test_masking(spark):
    m = lambda u: one(spark, masking.mask_url(F.col("u")), u=u)
    assert m("http://u:pw@a.test/x?Access_Token=1&q=2#code=3") == "http://u:***@a.test/x?Access_Token=***&q=2#code=***"
    assert m("/x?token=") == "/x?token="
    assert one(spark, masking.mask_urls_in_text(F.col("s")), s="see http://a.test/?sid=1 and ?sid=1") == "see http://a.test/?sid=*** and ?sid=1"


def test_fingerprint(spark):
    assert one(spark, text.fingerprint12(F.col("s")), s="abc") == "a9993e364706"
