import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.text import clean, clip_ellipsis, fold_accents, trim_all
from tidemark.functions.urls import canonical_url, host_of, is_homepage
from tidemark.operators import gates
from tidemark.operators.roster import normalize_domain


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def expected_id(namespace, *parts):
    texts = [unicodedata.normalize("NFKC", p).strip() for p in parts]
    identity = "|".join(f"{len(t.encode())}:{t}" for t in texts)
    return f"{namespace}_{hashlib.sha256(identity.encode()).hexdigest()[:32]}"


@pytest.mark.parametrize("parts", [("a", "bc"), ("ab", "c"), ("Zoë", "Ａ"), (" x ", "|1:y")])
def test_stable_ids(spark, parts):
    assert one(spark, ids.stable_id("acct", *[F.lit(p) for p in parts])) == expected_id("acct", *parts)


def test_empty_identity_parts(spark):
    assert one(spark, ids.stable_id("acct", F.lit("  "), F.lit("x"))) is None
    with pytest.raises(Exception, match="must not be empty"):
        one(spark, ids.stable_id("acct", F.lit(""), strict=True))


def test_text(spark):
    assert one(spark, trim_all(F.lit("　\t a b﻿"))) == "a b"
    assert one(spark, clean(F.lit("  ﬁne \n day "))) == "fine day"
    assert one(spark, fold_accents(F.lit("Café & Söhne GmbH"))) == "cafe and sohne gmbh"
    assert one(spark, clip_ellipsis(F.lit("abcd  efgh"), 7)) == "abcd…"


URLS = [
    ("HTTPS://WWW.Example.com:443/a/b/?utm_source=x&id=1&fbclid=2#top", "https://www.example.com/a/b?id=1"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com//", "https://example.com/"),
    ("http://example.com/a", None),
    ("https://user:pw@example.com/a", None),
    ("https://www.linkedin.com/company/x", None),
    ("https://notlinkedin.com/x", "https://notlinkedin.com/x"),
    ("not a url", None),
]


@pytest.mark.parametrize("url,expected", URLS)
def test_news_urls(spark, url, expected):
    assert one(spark, gates.news_url(F.lit(url))) == expected


def test_other_urls(spark):
    assert one(spark, gates.job_url(F.lit("https://J.example.com//a//b/?gh_src=1&ref=2&k=v"))) == "https://j.example.com/a/b?k=v"
    assert one(spark, gates.job_url(F.lit("Jobs/Engineer/?x=1"))) == "jobs/engineer"
    assert one(spark, gates.job_url(F.lit("  "))) is None
    assert one(spark, canonical_url(F.lit("https://h.example.com:8443?q=1"))) == "https://h.example.com:8443/?q=1"
    assert one(spark, host_of(F.lit("https://www.a.example.com./x"))) == "a.example.com."
    assert one(spark, is_homepage(F.lit("https://x.example.com/en-gb-gbp/de"))) is True
    assert one(spark, is_homepage(F.lit("https://x.example.com/news"))) is False


DOMAINS = [("https://WWW.Acme.example/", "acme.example"), ("acme.example", "acme.example"), ("acme", None), ("acme.example/path", None), ("ftp://acme.example", None), ("https://a.example?q=1", None)]


@pytest.mark.parametrize("value,expected", DOMAINS)
def test_domains(spark, value, expected):
    assert one(spark, normalize_domain(F.lit(value))) == expected


def test_robots(spark):
    body = "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /private # no\nAllow: /private/press*\nDisallow: /private/press/\n"
    frontier = spark.createDataFrame(
        [("https://a.example/private/x",), ("https://a.example/private/press1",), ("https://a.example/private/press/1",), ("https://a.example/",), ("https://b.example/",), ("https://c.example/x",), ("https://d.example/x",)], "url STRING")
    robots = spark.createDataFrame([("https://a.example", 200, body), ("https://b.example", 404, None), ("https://c.example", 500, None)], "origin STRING, status INT, body STRING")
    found = {r.url: r.allowed for r in gates.robots_filter(frontier, robots).collect()}
    assert list(found.values()).count(True) == 3
    assert found["https://a.example/private/press1"] and found["https://a.example/"] and found["https://b.example/"]


def test_redaction(spark):
    text = "Bearer abc.def failed?token=xyz&ok=1 key sk-abcdefghijklmnop\nend"
    assert one(spark, gates.redact_text(F.lit(text))) == "[REDACTED] failed?token=[REDACTED]&ok=1 key [REDACTED] end"
    assert len(one(spark, gates.redact_text(F.lit("x" * 900)))) == 500


def test_reported_ids(spark):
    rows = [("m1", "Status: Complete\n**Reported signal IDs:** `a-1`, b-2 none b-2"), ("m2", "Status: WAITING_FOR_CONTEXT\nReported signal IDs: c-3"), ("m3", "Status: Partial\nnothing")]
    found = gates.extract_reported_ids(spark.createDataFrame(rows, "message_id STRING, text STRING")).collect()
    assert sorted(r.signal_id for r in found) == ["a-1", "b-2"]
