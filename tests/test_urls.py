"""Addresses and fingerprints against literal vectors and the stored fingerprints."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.fingerprint import fingerprint, with_fingerprint

#: one address or two per rule: what a canonical address keeps, orders, quotes and drops (RFC 3986, section 6, and the sorted query)
CANONICAL = [
    # host in lower case, port and user as they stand, a lone colon goes
    ("hTTps://Mill.Harbour.TEST:8443/Quay", "https://mill.harbour.test:8443/Quay"),
    ("http://harbour.test:", "http://harbour.test/"),
    ("ftp://Ada:pW@HOST.test/", "ftp://Ada:pW@host.test/"),
    # path: escapes of plain characters are resolved, others are in upper case, slash and question mark stay escaped
    ("http://h.test/%7eada/%41%2f%3F%e2%82%ac", "http://h.test/~ada/A%2F%3F%E2%82%AC"),
    ("http://h.test/a b/ü|x", "http://h.test/a%20b/%C3%BC|x"),
    # query: pairs sorted by name, then value; blanks as +, empty pairs go, names without value get one
    ("http://h.test?z=1&m=2&z=0", "http://h.test/?m=2&z=0&z=1"),
    ("http://h.test/s?q=a%20b+c&&flag", "http://h.test/s?flag=&q=a+b+c"),
    ("http://h.test/s?k=1;j=2", "http://h.test/s?j=2&k=1"),
    ("http://h.test/s?p=x/y&n=é", "http://h.test/s?n=%C3%A9&p=x%2Fy"),
    # fragment: gone
    ("http://h.test/a#part?x", "http://h.test/a"),
    # hosts of other scripts in ASCII
    ("http://Müller.test/x", "http://xn--mller-kva.test/x"),
    # blanks, line breaks and control characters around and inside
    (" \thttp://h.test/a\n/b ", "http://h.test/a/b"),
    # addresses without authority
    ("mailto:ada@h.test?b=2&a=1", "mailto:ada@h.test?a=1&b=2"),
    # none at all
    (None, None), ("", None), ("harbour.test/x", None), ("//harbour.test/x", None),
]


def test_canonical_forms(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CANONICAL)], "i int, url string, want string")
    for r in urls.with_canonical(df.withColumn("got", urls.canonicalize(F.col("url"))), "url", "staged").collect():
        assert r.got == r.want, r.url
        assert r.staged == r.want, r.url


def test_fingerprint_vectors(spark):
    # fixed values: digests of the published fingerprint scheme, which stored caches and seen sets hold; they must not change
    rows = [
        ("http://Example.com:80/a?b=2&a=1#frag", "GET", b"", False, False, "f5676cfd272c58f8cac12be0705d2ee8fd659e1f"),
        ("http://Example.com:80/a?b=2&a=1#frag", "GET", b"", True, False, "1dcd57bfcd5d0a09c7e95e2126e7c8d16d0c3545"),
        ("http://example.com/a%2fb?q=b%a3", "post", b"\x00\xff", False, False, "1306d635576d1f6783dc729acf51b1b8ac359663"),
        ("https://example.com/", " get ", b"", False, False, "eb37c054d6096f9c3824d78f056564736ecc7062"),
        ("https://example.com/path?b=2&a=1#frag", None, None, False, True, "9fd138d3683e58c3a35e97bae1ef218d313f19f0"),
        (None, "GET", b"", False, False, None),
    ]
    df = spark.createDataFrame(rows, "url string, method string, body binary, keep boolean, verbatim boolean, want string")
    got = df.withColumn("got", fingerprint(F.col("url"), F.col("method"), F.col("body"), keep_fragments=F.col("keep"), verbatim=F.col("verbatim")))
    for r in got.collect():
        assert r.got == r.want, r.url


@pytest.mark.parametrize(
    ("headers", "include", "url", "want"),
    [
        ({"x-a": [b"1", b"2"], "x-z": [b"last"]}, ["x-z", "X-A"], "https://example.com/path", "995e1b56e8988ba3e2bad8fe6f49f4caaf4bbfee"),
        ({"x-a": [b"1"]}, ["missing"], "https://example.com/path", "4924be7d6554dc9acfd69298c9d4b32f6bc4ffdf"),
        ({"x-test": [b"one", b"two"]}, ["X-Test", "x-test"], "https://example.com/page", "d3cef5be5bb053d554514504755ad12c72c52292"),
    ],
)
def test_fingerprint_with_headers(spark, headers, include, url, want):
    df = spark.createDataFrame([(url, headers)], "url string, headers map<string, array<binary>>")
    assert df.select(fingerprint(F.col("url"), headers=F.col("headers"), include_headers=include)).first()[0] == want


def test_stored_fingerprints(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/responses.parquet").filter("url is not null")
    assert df.filter(fingerprint(F.col("url")) != F.col("fingerprint")).count() == 0
    assert with_fingerprint(df).filter(F.col("fp") != F.col("fingerprint")).count() == 0


def test_join_follows_rfc(spark):
    base = "http://a/b/c/d;p?q"
    refs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "./../g", "g/./h", "g/../h", "g?y/./x", "http://x/y/../z", "mailto:a@b"]
    df = spark.createDataFrame([(base, r) for r in refs], "base string, ref string")
    for r in urls.resolve(df.withColumn("got", urls.join(F.col("base"), F.col("ref"))), "base", "ref", "staged").collect():
        assert r.staged == r.got
        want = {"http://x/y/../z": "http://x/z"}.get(r.ref, urljoin(base, r.ref))
        assert r.got == want, r.ref


def test_safe_addresses(spark):
    cases = {" http://h.test/a b?q=ü#f g ": "http://h.test/a%20b?q=%C3%BC#f%20g", "http://Müller.test/%zz": "http://xn--mller-kva.test/%zz", "/rel path": "/rel%20path", "http://u:p@h.test/": "http://u:p@h.test/", "http://h.test/a\n": "http://h.test/a"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.s for r in df.select("u", urls.safe(F.col("u")).alias("s")).collect()} == cases


def test_parts(spark):
    df = spark.createDataFrame([("https://user:pass@Example.test:443/path?q=1#fragment",)], "u string")
    u = F.col("u")
    r = df.select(
        urls.hostname(u).alias("host"), urls.netloc(u).alias("netloc"), urls.origin(u).alias("origin"), urls.strip(u).alias("stripped"), urls.strip(u, origin_only=True).alias("root"),
        urls.robots_url(u).alias("robots"), urls.host_suffixes(F.lit("a.b.c")).alias("suffixes"), urls.matches_domain(urls.hostname(u), ["test"]).alias("inside"),
        urls.form_encode(F.expr("array(named_struct('k', 'a b', 'v', 'c&d'))")).alias("form"), urls.has_nofollow(F.lit("external,nofollow")).alias("nofollow"),
    ).first()
    assert r.asDict() == {
        "host": "example.test", "netloc": "user:pass@Example.test:443", "origin": "https://example.test", "stripped": "https://Example.test/path?q=1", "root": "https://Example.test/",
        "robots": "https://example.test/robots.txt", "suffixes": ["a.b.c", "b.c", "c"], "inside": True, "form": "a+b=c%26d", "nofollow": True,
    }
