"""Core operators on small literal inputs."""

import bz2
import gzip
import io
import json
import lzma
import marshal
import os
import pickle
import random
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree

import pytest
import zstandard
from pyspark.sql import functions as F

from webloom import catalog
from webloom.operators import cookies, crawl, dom, frontier, heavy_keys, links, loader, media, policies, robots, stats, throttle
from webloom.plans import chain
from webloom.sinks import exporters
from webloom.sources import feeds
from webloom.streaming import ops


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


QUEUE = "name string, priority int, seq int, is_start boolean"


def names(df):
    return [r.name for r in df.collect()]


def test_scheduling_orders(spark):
    q = spark.createDataFrame([("first", 5, 1, False), ("high", 10, 2, False), ("second", 5, 3, False), ("low", -1, 4, False)], QUEUE)
    assert names(frontier.pop(q, separate_start=False)) == ["high", "first", "second", "low"]
    q = spark.createDataFrame([("n1", 0, 1, False), ("s1", 0, 2, True), ("n2", 0, 3, False), ("s2", 0, 4, True)], QUEUE)
    assert names(frontier.pop(q, lifo=True)) == ["n2", "n1", "s1", "s2"]
    q = spark.createDataFrame([("normal10", 10, 1, False), ("start11", 11, 2, True), ("start10", 10, 3, True)], QUEUE)
    assert names(frontier.pop(q, lifo=True)) == ["start11", "normal10", "start10"]
    assert names(frontier.pop(q, 1)) == ["start11"]
    assert [r.position for r in frontier.ranked(q).orderBy("position").collect()] == [1, 2, 3]
    assert frontier.ranked(q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        frontier.pop(q, -1)


def test_duplicate_filter(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, None, False), (4, "b", True), (5, "b", False), (6, "c", False)], "seq int, fp string, skip boolean")
    seen = spark.createDataFrame([("c",), (None,)], "fp string")
    assert [r.seq for r in frontier.filter_duplicates(df, seen, bypass=F.col("skip")).orderBy("seq").collect()] == [1, 4, 5]
    assert [r.seen for r in frontier.seen_flags(df, "fp", "seq").orderBy("seq").collect()] == [False, True, False, False, True, False]
    assert frontier.filter_duplicates(df.limit(0), seen).count() == 0


def test_heavy_keys_stitches_ranges(spark):
    data = [(f"http://{'hot' if i % 3 else f'h{i % 7}'}.test/", i, 200 if (i // 10) % 2 else 404, b"x" * (i % 5)) for i in range(600)]
    data += [(None, 1000, 200, b"y"), ("no address", 1001, None, None), ("http://hot.test/", 5, 404, b"")]
    df = spark.createDataFrame(data, "url string, response_id int, status int, body binary").withColumn("k", F.lit("clash"))
    got = {r.host: r for r in heavy_keys.host_profile(df).collect()}
    for host in {"hot.test", "h0.test", "h3.test"}:
        mine = sorted((i, s, len(b)) for u, i, s, b in data if u == f"http://{host}/")
        runs, best = 1, 1
        for a, b in zip(mine, mine[1:]):
            runs = runs + 1 if a[1] == b[1] else 1
            best = max(best, runs)
        r = got[host]
        assert (r.responses, r.bytes, r.longest_run) == (len(mine), sum(m[2] for m in mine), best)
        assert r.status_changes == sum(a[1] != b[1] for a, b in zip(mine, mine[1:]))
        assert {x.status: x.responses for x in r.statuses} == {s: sum(m[1] == s for m in mine) for s in {m[1] for m in mine}}
    assert got[""].responses == 1 and got[""].statuses[0].status == -1
    assert {r.host for r in heavy_keys.heavy_hosts(df).collect()} >= {"hot.test"}
    assert heavy_keys.heavy_hosts(df.limit(0)).count() == 0


def test_depth_policy(spark):
    df = spark.createDataFrame([(0, 100), (1, 97), (2, 91)], "depth int, priority int")
    assert rows(policies.depth(df, 2, 3), "depth") == [(1, 97), (2, 91)]


def test_meta_refresh_and_headers(spark):
    html = """<!-- <meta http-equiv="refresh" content="1; url=/no"> --><script><meta http-equiv=refresh content="1;url=/no"></script><META HTTP-EQUIV='Refresh' content='5; URL=../yes?a=1'>"""
    r = spark.createDataFrame([(html, "http://a.test/x/y")], "h string, u string").select(policies.meta_refresh(F.col("h"), F.col("u")).alias("m"), policies.policy_of_header(F.lit("bogus, Origin, same-origin, bad")).alias("p"), policies.basic_auth(F.lit("u"), F.lit("p")).alias("b")).first()
    assert (r.m.delay, r.m.url, r.p, r.b) == (5.0, "http://a.test/yes?a=1", "same-origin", "Basic dTpw")


def test_http_dates_and_freshness(spark):
    dates = [("Sun, 06 Nov 1994 08:49:37 GMT", 784111777.0), ("Sunday, 06-Nov-94 08:49:37 GMT", 784111777.0), ("Tuesday, 31-Mar-26 23:16:40 GMT", 1774999000.0), ("Friday, 01-Jan-69 00:00:00 GMT", -31536000.0), ("Sun Nov  6 08:49:37 1994", 784111777.0), ("Sun, 06 Nov 1994 08:49:37 -0000", 784111777.0), ("nonsense", None), (None, None)]
    got = spark.createDataFrame(dates, "d string, want double").withColumn("got", policies.http_date(F.col("d"))).collect()
    assert [r.got for r in got] == [r.want for r in got]
    base = "Sun, 06 Nov 1994 08:49:37 GMT"
    cases = [("max-age=10", None, False), ("max-age=10", "max-stale=20", True), ("max-age=10, must-revalidate", "max-stale=20", False), ("max-age=inf", None, False), ("max-age=100", None, True), ("max-age=100", "no-cache", False)]
    df = spark.createDataFrame([(200, base, None, None, None, None, cc, rc, want) for cc, rc, want in cases], "status int, date string, expires string, last_modified string, age string, etag string, cache_control string, request_cache_control string, want boolean")
    for r in policies.freshness(df, 784111797.0).collect():
        assert r.fresh == r.want, r.cache_control


PAGE = """<html><head><base href="/root/"><title>T</title></head><body><nav><a href="/n">Nav</a></nav>
<div class="products main"><a href="product/1?b=2&amp;a=1#details" rel="external,nofollow"> Product <b>One</b> </a><a href=product/2>Two</a><a href="file.pdf">P</a><a href="http://[bad">x</a>
<a href="https://other.test/">Off</a><p>one<p>two<li>x<li>y</div></body></html>"""


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://example.test/dir/page", PAGE), (2, None, PAGE), (3, "https://e.test/", None)], "page_id int, url string, html string")
    ex = links.LinkExtractor(allow=("/product/",), deny=(r"/(?:2|broken)$",), allow_domains=("example.test",), restrict_css=(".products",))
    assert [(r.url, r.text, r.nofollow) for r in ex.extract(pages).collect()] == [("https://example.test/root/product/1?b=2&a=1#details", " Product One ", True)]
    every = [r.url for r in links.LinkExtractor().extract(pages).orderBy("pos").collect()]
    assert every == ["https://example.test/n", "https://example.test/root/product/1?b=2&a=1#details", "https://example.test/root/product/2", "https://other.test/"]
    out = links.LinkExtractor(process_value=lambda v: F.when(v == "https://example.test/n", "../out")).extract(pages).collect()
    assert [r.url for r in out] == ["https://example.test/out"]
    rules = [links.Rule(links.LinkExtractor(restrict_css=("nav",))), links.Rule(links.LinkExtractor(allow=("other|/n",)), "cb")]
    assert sorted((r.rule, r.url, r.follow) for r in links.apply_rules(pages, rules).collect()) == [(0, "https://example.test/n", True), (1, "https://other.test/", False)]
    rules[0].process_links = lambda df: df.withColumn("url", F.concat("url", F.lit("?x")))
    rules[1].process_request = lambda df: df.filter(~F.col("url").contains("other")).withColumn("callback", F.lit("changed"))
    rules[1].cb_kwargs, rules[1].errback = {"k": "v"}, "failed"
    got = links.apply_rules(pages, rules).collect()
    assert sorted((r.rule, r.url, r.callback, r.cb_kwargs, r.errback) for r in got) == [(0, "https://example.test/n?x", None, {}, None), (1, "https://example.test/n", "changed", {"k": "v"}, "failed")]
    assert len(set(links.IGNORED_EXTENSIONS)) == 91
    late = spark.createDataFrame([(1, "http://a.test/x/", "<!-- <base href='/no/'> -->" + " " * 4200 + "<base href='/late/'><a href='y'>y</a>"), (2, "http://a.test/x/", "<base href='/b/'><a href=' ü y'>y</a><a href='z.sh'>z</a>")], "page_id int, url string, html string")
    assert [r.url for r in links.LinkExtractor().extract(late).orderBy("page_id").collect()] == ["http://a.test/x/y", "http://a.test/b/%C3%BC%20y"]


def test_selectors(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    d = dom.nodes(pages).cache()
    assert [r.value for r in dom.css(d, "div.products > a:nth-child(2)::text").collect()] == ["Two"]
    assert [r.value for r in dom.css(d, ".main a[href^='http']::attr(href)").orderBy("pre").collect()] == ["http://[bad", "https://other.test/"]
    assert [r.value for r in dom.css(d, "p::text, li::text").orderBy("pre").collect()] == ["one", "two", "x", "y"]
    assert [r.tag for r in dom.css(d, "p + p").collect()] == ["p"]
    assert [r.value for r in dom.xpath(d, "//div[contains(@class, 'products')]/a[1]/@rel").collect()] == ["external,nofollow"]
    assert [r.value for r in dom.xpath(d, "string(//a[2])").collect()] == ["Two"]
    assert dom.collected(dom.xpath(d, "//p/text()")).first()["values"] == ["one", "two"]
    with pytest.raises(ValueError):
        dom.css(d, "a:hover")


def test_loader(spark):
    df = spark.createDataFrame([(1, [" one ", None, " two "], '{"p": [{"n": "Coffee"}, {"n": "Tea"}]}', ["", "0", "later"])], "id int, v array<string>, j string, t array<string>")
    ld = loader.ItemLoader().processors("v", loader.map_compose(F.trim, F.upper)).processors("t", output=loader.take_first).processors("j", loader.select_json("$.p[*].n"), loader.join_with("|"))
    assert rows(ld.add("v", F.col("v")).add("t", F.col("t")).add("j", F.col("j"), scalar=True).load(df, "id")) == [(1, ["ONE", "TWO"], "0", "Coffee|Tea")]


def test_robots(spark):
    text = "﻿User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\n\nUser-agent: bot\nDisallow: /*.gif$\n".encode()
    rb = spark.createDataFrame([("http://a.test", text), ("http://b.test", None)], "origin string, body binary")
    reqs = spark.createDataFrame([(u,) for u in ("http://a.test/private", "http://a.test/private/open", "http://a.test/x.gif", "http://b.test/private", "data:x")], "url string")
    assert {r.url: r.allowed for r in robots.check(reqs, rb, "other").collect()} == {"http://a.test/private": False, "http://a.test/private/open": True, "http://a.test/x.gif": True, "http://b.test/private": True, "data:x": True}
    assert {r.url: r.allowed for r in robots.check(reqs, rb, "Bot").collect()}["http://a.test/x.gif"] is False
    assert rows(robots.crawl_delays(rb, "other")) == [("http://a.test", 2.0)]


def test_cookies(spark):
    ev = [("j", 1.0, 1, "https://www.example.com/a/b", "s=1; Path=/"), ("j", 2.0, 2, "https://www.example.com/a/b", "s=2; Path=/"), ("j", 3.0, 3, "https://www.example.com/", "d=x; Domain=example.com; Secure"), ("j", 4.0, 4, "https://www.example.com/", "bad=1; Domain=com"),
          ("j", 5.0, 5, "https://www.example.com/", "gone=1; Max-Age=0"), ("j", 6.0, 6, "https://www.example.com/", None), ("j", 7.0, 7, "https://www.example.com/", "noname")]
    jar = cookies.jars(spark.createDataFrame(ev, "jar string, ts double, seq int, url string, set_cookie string"))
    assert sorted((r.name, r.value, r.domain) for r in jar.collect()) == [("d", "x", "example.com"), ("s", "2", "www.example.com")]
    req = spark.createDataFrame([(1, "j", "https://www.example.com/a", 10.0), (2, "j", "http://www.example.com/", 10.0), (3, "j", "https://api.example.com/", 10.0), (4, "k", "https://www.example.com/", 10.0)], "id int, jar string, url string, now double")
    assert {r.id: r.cookie for r in cookies.cookie_headers(req, jar).collect()} == {1: "d=x; s=2", 2: "s=2", 3: "d=x", 4: None}


def _throttled(events, start, least, most, concurrency):
    """Brute force: the delay of a slot folded event by event."""
    out = {}
    for slot, _ts, _seq, latency, status, adjust in sorted((e for e in events if e[0] is not None), key=lambda e: (e[0], e[1], e[2])):
        d, up, down, same, ignored = out.get(slot, (start, 0, 0, 0, 0))
        new = None
        if adjust is not False and latency is not None:
            t = latency / concurrency
            new = min(max(t, (d + t) / 2, least), most)
            if status != 200 and new <= d:
                new = None
        out[slot] = (d, up, down, same, ignored + 1) if new is None else (new, up + (new > d), down + (new < d), same + (new == d), ignored)
    return out


def test_throttle(spark):
    schema = "slot string, ts double, seq int, latency double, status int, adjust boolean"
    rng = random.Random(3)
    data = [("a", 1.0, 1, 1.0, 200, True), ("a", 2.0, 2, 0.1, 500, True), ("a", 3.0, 3, 0.1, 200, False), (None, 1.0, 4, 1.0, 200, True)]
    data += [(rng.choice("bcd"), float(rng.randrange(100)), n, rng.choice([None, rng.random() * 8, 0.01]), rng.choice([200, 200, 404]), rng.choice([True, True, None, False])) for n in range(10, 400)]
    ev = spark.createDataFrame(data, schema)
    want = _throttled(data, 0.2, 0.1, 2.0, 2.0)
    for width in (7.0, 1000.0):
        got = {x.slot: (x.delay, x.increased, x.decreased, x.unchanged, x.ignored) for x in throttle.auto_throttle(ev, 0.2, 0.1, 2.0, 2.0, width=width).collect()}
        assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1:] == want[k][1:] for k in want)
    assert throttle.auto_throttle(ev.limit(0)).count() == 0
    q = spark.createDataFrame([("s", float(t), i) for i, t in enumerate([0, 1, 1, 50, 51, 120, 121, 121])] + [("t", 3.0, 1)], "slot string, ts double, seq int")
    for width in (20.0, 60.0, 1e9):
        got = rows(throttle.start_times(q, 10.0, width).select("slot", "seq", "start"), "slot", "seq")
        assert [w[2] for w in got if w[0] == "s"] == [0, 10, 20, 50, 60, 120, 130, 140] and got[-1][2] == 3.0


def test_stats(spark):
    log = spark.createDataFrame([("a", "inc", 1.0, 1), ("a", "inc", 2.0, 2), ("m", "max", 5.0, 3), ("m", "max", 2.0, 4), ("s", "set", 1.0, 6), ("s", "set", 9.0, 5)], "key string, op string, value double, seq int")
    assert rows(stats.folded(log), "key") == [("a", 3.0), ("m", 5.0), ("s", 1.0)]
    assert rows(stats.downloader(spark.createDataFrame([(200, 5), (200, 6), (None, 1)], "status int, bytes int")), "key") == [("downloader/response_bytes", 12), ("downloader/response_count", 3), ("downloader/response_status_count/200", 2)]
    c = spark.createDataFrame([(5, 10, 0)], "items int, pages int, errors int")
    assert stats.close_reason(c, items=5, pages=20).first().reason == "closespider_itemcount"


def test_crawl_resumes(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("c", None)], "src string, dst string")
    start = spark.createDataFrame([("a",), (None,)], "node string")
    assert dict(rows(crawl.expand(start, edges))) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert dict(rows(crawl.expand(start, edges, limit=1))) == {"a": 0, "b": 1, "c": 1}

    def visit(f):
        return f.join(edges, f.fp == edges.src).filter("dst is not null").select(F.col("dst").alias("fp"), (F.col("seq") * 10 + F.ascii("dst")).alias("seq"), F.col("dst").alias("url"))

    first = spark.createDataFrame([("a", 1, "a")], "fp string, seq int, url string")
    store = crawl.Checkpoint(spark, f"file://{tmp_path}/job")
    assert {r.fp: r.depth for r in crawl.crawl(first, visit, store, limit=1).collect()} == {"a": 0, "b": 1, "c": 1}
    os.remove(f"{tmp_path}/job/level=1/_COMMITTED")  # a level that was not finished is done again
    assert store.committed() == 1
    assert {r.fp: r.depth for r in crawl.crawl(first, visit, store).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_redirect_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), (None, "q")], "url string, target string")
    assert {r.url: (r.final, r.hops) for r in policies.redirect_chains(e, 20).collect()} == {"a": ("c", 2), "b": ("c", 1), "x": (None, 21), "y": (None, 21)}


def test_media(spark):
    items = spark.createDataFrame([(1, ["http://a.test/x.png", "http://A.test/x.png", None]), (2, ["http://a.test/gone"]), (3, [])], "item_id int, file_urls array<string>")
    dl = media.downloads(items)
    assert dl.count() == 2
    fetched = dl.filter("url like '%png'").withColumns({"checksum": F.lit("c"), "status": F.lit("downloaded")})
    got = {r.item_id: [f.url for f in r.files] for r in media.completed(items, fetched).collect()}
    assert got == {1: ["http://a.test/x.png", "http://A.test/x.png"], 2: [], 3: []}


def test_feeds(spark):
    xml = """<?xml version="1.0"?><urlset xmlns:x="y"><url><loc>http://a.test/1?x=1&amp;y=2</loc><x:link href="http://a.test/fr"/></url><url><lastmod>never</lastmod></url><url><loc>http://a.test/2</loc></url><url><loc>http://a.te"""
    s = feeds.sitemap(spark.createDataFrame([(1, xml), (2, None), (3, "no xml")], "id int, body string"))
    assert [(r.loc, r.alternates) for r in s.orderBy("pos").collect()] == [("http://a.test/1?x=1&y=2", ["http://a.test/fr"]), ("http://a.test/2", [])]
    c = feeds.csv_rows(spark.createDataFrame([(1, 'name;price\n"a;b";2\nbad\n\nc;3\n')], "id int, body string"), delimiter=";")
    assert [r.row for r in c.orderBy("line").collect()] == [{"name": "a;b", "price": "2"}, {"name": "c", "price": "3"}]
    r = spark.createDataFrame([("curl 'http://a.test/x' -H 'X-A: 1' -d 'a=1' --data b=2 -b 'c=d' --compressed",), ("wget x",), (None,)], "c string").select(feeds.curl_request(F.col("c")).alias("r")).collect()
    assert (r[0].r.method, r[0].r.body, r[0].r.headers, r[0].r.cookies) == ("POST", "a=1&b=2", {"x-a": "1"}, {"c": "d"}) and r[1].r.url is None


def test_bodies(spark):
    raw = b"hello " * 50
    deflate = zlib.compressobj(wbits=-15)
    data = [(gzip.compress(raw), "gzip"), (deflate.compress(raw) + deflate.flush(), "deflate"), (gzip.compress(zlib.compress(raw)), "deflate, x-gzip"), (raw, "unknown"), (b"broken", "gzip"), (None, "gzip"),
            (gzip.compress(raw) + gzip.compress(b"more") + b"\0" * 8, "gzip"), (gzip.compress(raw)[:-9], "gzip"), (zlib.compress(raw)[:-5], "deflate"), (zstandard.compress(raw) + zstandard.compress(b"more"), "zstd")]
    got = feeds.decode_content(spark.createDataFrame(data, "body binary, content_encoding string")).collect()
    assert [g.decoded for g in got] == [raw, raw, raw, raw, b"broken", None, raw + b"more", data[7][0], data[8][0], raw + b"more"]
    assert [g.codings_left for g in got] == [[], [], [], ["unknown"], ["gzip"], ["gzip"], [], ["gzip"], ["deflate"], []]
    assert feeds.decode_content(spark.createDataFrame([(gzip.compress(raw), "gzip")], "body binary, content_encoding string"), most=10).first().too_large
    t = spark.createDataFrame([("привет".encode("cp1251"), "cp1251"), ("é".encode(), "utf-8"), (b"\xff", "utf-8"), (None, "utf-8"), ("é".encode("latin-1"), "iso-8859-1")], "body binary, encoding string")
    assert [r.text for r in feeds.decoded_text(t).collect()] == ["привет", "é", "�", None, "é"]


def test_exports(spark, tmp_path):
    items = spark.createDataFrame([(1, "é", ["a", "b"], b"x"), (2, None, None, None)], "id int, name string, tags array<string>, raw binary").coalesce(1)
    assert [json.loads(r.value) for r in exporters.json_lines(items).collect()] == [{"id": 1, "name": "é", "tags": ["a", "b"], "raw": "x"}, {"id": 2}]
    assert rows(exporters.csv_ready(items, "|")) == [("1", "é", "a|b", "x"), ("2", "", "", "")]
    want = [{"id": 1, "name": "é", "tags": ["a", "b"], "raw": "x"}, {"id": 2}]

    def content(fmt, codec="none", **how):
        """The one file of a feed written twice, the second time over the first."""
        path = f"{tmp_path}/{fmt}-{codec}"
        for _ in range(2):
            assert exporters.export(items, path, fmt, "overwrite", codec, **how)
        (name,) = [f for f in os.listdir(path) if f[0] not in "._"]
        return {"none": open, "gzip": gzip.open, "bz2": bz2.open, "lzma": lzma.open}[codec](f"{path}/{name}", "rb").read()

    for codec in ("none", "lzma"):
        assert json.loads(content("json", codec)) == want and [json.loads(x) for x in content("jsonlines", codec).splitlines()] == want
        assert content("csv", codec).decode() == "id,name,tags,raw\r\n1,é,\"a,b\",x\r\n2,,,\r\n"
        tree = ElementTree.fromstring(content("xml", codec))
        assert [(x.findtext("id"), x.findtext("name") or None, [v.text for v in x.iterfind("tags/value")]) for x in tree] == [("1", "é", ["a", "b"]), ("2", None, [])]
    dumps = io.BytesIO(content("pickle"))
    assert [pickle.load(dumps), pickle.load(dumps)] == [{"id": 1, "name": "é", "tags": ["a", "b"], "raw": b"x"}, {"id": 2, "name": None, "tags": None, "raw": None}] and not dumps.read()
    dumps = io.BytesIO(content("marshal", "lzma"))
    assert [marshal.load(dumps), marshal.load(dumps)] == want and "'name': 'é'" in content("pprint").decode()
    assert json.loads(content("json", indent=2)) == want
    assert exporters.export(items, f"{tmp_path}/json-none", "json", "append") and len([f for f in os.listdir(f"{tmp_path}/json-none") if f[0] != "."]) == 2
    with pytest.raises(Exception, match="neither an address|absolute"):
        exporters.export(items, "some/folder", "json")
    assert not exporters.export(items.limit(0), f"{tmp_path}/none", store_empty=False)
    with pytest.raises(ValueError):
        exporters.export(items, f"{tmp_path}/x", "nothing")
    exporters.export(exporters.batches(items, 1, ["id"]), f"{tmp_path}/b", "json", batch="batch_id", name="f-%(batch_id)02d")
    assert {f: json.load(open(f"{tmp_path}/b/{f}"))[0]["id"] for f in os.listdir(f"{tmp_path}/b")} == {"f-01.json": 1, "f-02.json": 2}

    class Shout:
        def __init__(self, f, options):
            self.f = f

        def add(self, row):
            self.f.write(f"{row['id']}!".encode())

        def end(self):
            pass

    exporters.register_writer("shout", Shout, "txt")
    try:
        assert content("shout") == b"1!2!"
    finally:
        del exporters.WRITERS["shout"]
    assert sorted(r.batch_id for r in exporters.batches(spark.range(5).toDF("id"), 2, ["id"]).collect()) == [1, 1, 2, 2, 3]
    assert exporters.uri("f-%(batch_id)03d-%(name)s-100%.json", {"batch_id": 7, "name": "x"}) == "f-007-x-100%.json"


def test_chains(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    answer = chain.Step("cache", 900, on_request=lambda d: d.withColumn("route", F.when(F.col("id") == 1, "cache").otherwise(F.col("route"))))
    drop = chain.Step("offsite", 50, on_request=lambda d: d.withColumn("route", F.when(F.col("id") < 3, "ignored").otherwise(F.col("route"))))
    assert [s.name for s in chain.ordered([answer, drop])] == ["offsite", "cache"]
    assert dict(rows(chain.requests(df, chain.ordered([answer, drop])))) == {1: "ignored", 2: "ignored", 3: None}
    assert dict(rows(chain.requests(df, chain.ordered([answer, drop], [chain.Step("offsite", None)])))) == {1: "cache", 2: None, 3: None}
    s = spark.createDataFrame([("A", "1", "default", 1), ("A", "2", "spider", 2), ("A", "3", "project", 3)], "name string, value string, layer string, seq int")
    assert rows(chain.resolve_settings(s)) == [("A", "2")]
    assert chain.contract(df, (4, None), ["id", "x"]) == ["field x is missing", "3 rows, expected 4 to any number"]


def test_stream_throttle_equals_batch(spark, tmp_path):
    data = [("a", 1.0, 1, 1.0, 200, True), ("a", 2.0, 2, 0.1, 500, True), ("b", 3.0, 3, 2.0, 200, True)]
    schema = "slot string, ts double, seq int, latency double, status int, adjust boolean"
    batch = spark.createDataFrame(data, schema)
    batch.write.parquet(f"{tmp_path}/in")
    st = ops.throttle(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 0.2, 0.1, 2.0, 2.0)
    got = ops.drain(st, f"{tmp_path}/out", f"{tmp_path}/cp").select("slot", "delay")
    assert rows(got, "slot") == rows(throttle.auto_throttle(batch, 0.2, 0.1, 2.0, 2.0).select("slot", "delay"), "slot")


def test_headlines_of_all_pages(spark, tmp_path):
    html = ["<h1>Plain</h1>", "<h1>Salt &amp; <b>bold</b> pepper</h1>", "<div><h1 class='a'>One</h1></div><h1>Two &lt;x&gt;</h1>", "<p>none</p>", "<h1></h1>"]

    class Brute(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out = [], []

        def handle_starttag(self, tag, attrs):
            self.open.append(tag)
            self.out += [""] if tag == "h1" else []

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            if self.open[-1:] == ["h1"]:
                self.out[-1] += data

    want = []
    for i, h in enumerate(html):
        b = Brute()
        b.feed(h)
        want += [(i, t) for t in b.out if t]
    rows = [(i, "http://a.test/", h.encode()) for i, h in enumerate(html)] + [(9, "http://a.test/", None)]
    spark.createDataFrame(rows, "response_id long, url string, body binary").write.parquet(f"{tmp_path}/responses.parquet")
    got = catalog.queries()["css_headlines"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.title) for r in got) == sorted(want) and len(want) == 4


def test_crawl_says_when_requests_are_left(spark, tmp_path):
    visit = lambda f: f.select((F.col("fp") + 1).alias("fp"), "seq", "url").filter("fp < 4")
    first = spark.createDataFrame([(0, 1, "a")], "fp int, seq int, url string")
    store = crawl.Checkpoint(spark, f"file://{tmp_path}/job")
    with pytest.raises(RuntimeError, match="requests are left"):
        crawl.crawl(first, visit, store, most_levels=2)
    assert crawl.crawl(first, visit, store).count() == 4
