"""Requests, fetching, media, proxies and statistics on small literal inputs."""

import gzip

import pytest
from pyspark.sql import functions as F

from webloom import runtime
from webloom.operators import dom, frontier, loader, media, policies, requests, stats
from webloom.plans import chain
from webloom.sources import feeds, fetch

FORM = """<base href='/b/'><form id=one action='go?x=1' method=post><input name=a value='1 &amp; 2'><input type=checkbox name=c checked><input type=radio name=r value=x><input type=file name=f>
<select name=s><option>first<option value=2>two</select><select name=m multiple><option value=1><option value=2 selected><option value=3 selected></select><textarea name=t>text~*</textarea>
<input name=off disabled value=no><input value=unnamed><button type=button name=b>B</button><input type=submit name=s1 value=Go><button name=s2 value=Other>O</button></form><form name=two action=''><input name=q></form>"""


def _form(spark, html=FORM, **how):
    pages = spark.createDataFrame([(1, "http://a.test/p?z=1", html), (2, "http://a.test/", "<p>none</p>"), (3, "http://a.test/", None)], "page_id int, url string, html string")
    return [(r.page_id, r.url, r.method, r.body, r.content_type) for r in requests.forms(pages, **how).collect()]


def test_forms(spark):
    body = "a=1+%26+2&c=on&s=first&m=2&m=3&t=text~%2A"
    post = lambda b: [(1, "http://a.test/b/go?x=1", "POST", b, requests.FORM_TYPE)]
    assert _form(spark, id="one") == post(body + "&s1=Go")
    assert _form(spark, css="#one", click={"name": "s2"}) == post(body + "&s2=Other")
    assert _form(spark, dont_click=True, overrides={"a": "new", "c": None, "z": "é"}) == post("s=first&m=2&m=3&t=text~%2A&a=new&z=%C3%A9")
    assert _form(spark, click={"nr": "1"}) == post(body + "&s2=Other") and _form(spark, click={"name": "none"}) == []
    assert _form(spark, name="two") == [(1, "http://a.test/p?q=", "GET", None, None)] and _form(spark, number=1) == _form(spark, name="two") and _form(spark, number=5) == []
    with pytest.raises(ValueError):
        _form(spark, css="form", xpath="//form")


def test_forms_of_many_pages_are_not_joined(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://a.test/p?z=1").alias("url"), F.when(F.col("id") % 4 < 3, F.concat(F.lit(FORM), F.lit("<form name=own><input name=n value="), "id", F.lit("></form>"))).alias("html"))
    d = requests.forms(pages, name="own")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("Join", "Broadcast", "Exchange"))
    want = [(i, f"http://a.test/p?n={i}", "GET", None) for i in range(40) if i % 4 < 3]
    assert sorted((r.page_id, r.url, r.method, r.body) for r in d.collect()) == want
    given = requests.forms(pages, name="own", nodes=dom.nodes(pages).repartition(3))
    plan = given._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert sorted((r.page_id, r.url, r.method, r.body) for r in given.collect()) == want


def test_follow(spark):
    pages = spark.createDataFrame([(1, "http://a.test/x/", "<a href=' y '>1</a><a>none</a><link href='/l'><p>z</p><a href='y'>2</a>"), (2, None, "<a href='q'>"), (3, "http://a.test/", None)], "page_id int, url string, html string")
    got = [r.url for r in requests.follow_all(pages, css="a, link, p").orderBy("pos").collect()]
    assert got == ["http://a.test/x/y", "http://a.test/l", "http://a.test/x/y"]
    assert [r.url for r in requests.follow_all(pages, xpath="//p/text()").collect()] == ["http://a.test/x/z"]
    one = requests.follow(pages.withColumn("ref", F.lit("../ü")))
    assert {r.page_id: r.target for r in one.collect()} == {1: "http://a.test/%C3%BC", 2: None, 3: "http://a.test/%C3%BC"}
    with pytest.raises(ValueError):
        requests.follow_all(pages)


def test_request_kinds(spark):
    df = spark.createDataFrame([("http://a.test/x?q=1#f", "post", {"x-b": [b"2"], "x-a": [b"1", b"3"]}, b"data"), ("http://a.test", "get", None, None)], "url string, method string, headers map<string,array<binary>>, body binary")
    u, m, h, b = (F.col(c) for c in ("url", "method", "headers", "body"))
    r = df.select(requests.to_curl(u, m, h, b, F.array(F.struct(F.lit("c").alias("k"), F.lit("d").alias("v")))).alias("curl"), requests.to_http(u, m, h, b).alias("http"), requests.wire_size(u, m, h, b).alias("size")).collect()
    assert r[0].curl == "curl -X POST http://a.test/x?q=1#f --data-raw 'data' -H 'x-a: 1' -H 'x-b: 2' --cookie 'c=d'" and r[1].curl == "curl -X GET http://a.test --cookie 'c=d'"
    assert bytes(r[0].http) == b"POST /x?q=1 HTTP/1.1\r\nHost: a.test\r\nx-a: 1\r\nx-a: 3\r\nx-b: 2\r\n\r\ndata" and r[0].size == len(r[0].http) and r[1].size == len(r[1].http)
    back = df.select(requests.from_dict(requests.to_dict(df)).alias("r")).select("r.*").collect()
    assert (back[0].method, back[0].headers, bytes(back[0].body)) == ("POST", {"x-b": [b"2"], "x-a": [b"1", b"3"]}, b"data") and back[1].body is None
    assert spark.range(1).select(requests.from_dict(F.lit("no json")).alias("r")).first().r is None
    call = feeds.curl_request(F.lit(r[0].curl))
    assert spark.range(1).select(call.alias("c")).first().c.headers == {"x-a": "1", "x-b": "2"}


def test_proxies(spark):
    rows = [("http://a.test/", None, None), ("https://a.test/", None, None), ("ftp://a.test/", None, None), ("http://in.corp.test/", None, None), ("http://a.test/", "socks4://u@p.test", True), ("http://a.test/", "p.test:1", True), ("http://a.test/", None, True), ("http://a.test/", "http://u:p%3A@p.test:80", True)]
    df = spark.createDataFrame(rows, "url string, proxy string, has_proxy boolean")
    got = [(r.proxy, r.proxy_auth) for r in policies.proxied(df, {"all": "all.test:9", "https": "https://s.test"}, ("corp.test",)).collect()]
    assert got == [("http://all.test:9", None), ("https://s.test", None), (None, None), (None, None), (None, None), ("http://p.test:1", None), (None, None), ("http://p.test:80", "Basic dTpwOg==")]


def test_request_defaults(spark):
    df = spark.createDataFrame([("http://a.test/", {"user-agent": [b"own"]}, 5.0), ("http://b.test/", {}, None)], "url string, headers map<string,array<binary>>, download_timeout double")
    got = policies.with_request_defaults(df, {"Accept": "*/*"}, "bot", 180.0, ("u", "p", "a.test")).collect()
    assert got[0].headers == {"user-agent": [b"own"], "accept": [b"*/*"], "authorization": [b"Basic dTpw"]} and got[0].download_timeout == 5.0
    assert got[1].headers == {"user-agent": [b"bot"], "accept": [b"*/*"]} and got[1].download_timeout == 180.0


def test_redirect_headers(spark):
    rows = [(1, "http://a.test/x", "POST", 307, "http://a.test:8080/", 0), (2, "https://a.test/", "GET", 301, "http://a.test/", 0), (3, "http://a.test/", "GET", 301, "https://a.test/", 0), (4, "http://a.test/", "GET", 301, "http://b.test/", 0), (5, "http://a.test/", "GET", 302, "ftp://a.test/", 0), (6, "ftp://a.test/", "GET", 302, "ftp://a.test/y", 0)]
    df = spark.createDataFrame(rows, "id int, url string, method string, status int, location string, priority int").withColumns({"body": F.lit("b").cast("binary"), "redirect_times": F.lit(None).cast("int")})
    got = {r.id: (r.outcome, r.drop_headers and r.drop_headers[1:]) for r in policies.redirect(df).collect()}
    assert got == {1: ("follow", ["Authorization"]), 2: ("follow", ["Cookie", "Authorization"]), 3: ("follow", ["Authorization"]), 4: ("follow", ["Cookie", "Authorization"]), 5: ("unsupported", None), 6: ("follow", [])}


def test_fetch(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a b.txt").write_bytes(b"file")
    pages = spark.createDataFrame([("k", 1, 200, b"old", 1.0), ("k", 2, 404, b"new", 2.0), ("k", 3, 500, b"none", None)], "fingerprint string, response_id int, status int, body binary, stored_at double")
    reqs = spark.createDataFrame([(1, "http://a.test/", "k"), (2, "https://a.test/", "gone"), (3, f"file://{tmp_path}/f/a%20b.txt", None), (4, "file:///no/such", None), (5, "data:,x%20y", None), (6, "gopher://a.test/", None), (7, None, None)], "id int, url string, fp string")
    store = fetch.from_pages(pages)
    want = {1: (404, b"new", None), 2: (None, None, "not_found"), 3: (200, b"file", None), 4: (None, None, "not_found"), 5: (200, b"x y", None), 6: (None, None, "not_supported"), 7: (None, None, "not_supported")}
    for root in (None, f"{tmp_path}/f"):
        got = fetch.fetch(reqs, {"http": store, "https": store, "file": fetch.from_files(root)})
        assert {r.id: (r.status, r.body and bytes(r.body), r.error) for r in got.collect()} == want
    assert fetch.fetch(reqs.filter("id = 5"), {"data": None}).first().error == "not_supported"
    fetch.register("own", lambda r: r.withColumns({"status": F.lit(201), "body": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")}))
    try:
        assert fetch.fetch(reqs.withColumn("url", F.lit("own:x")).limit(1)).first().status == 201
    finally:
        del fetch.HANDLERS["own"]


def test_guards_and_early_stop(spark):
    df = spark.createDataFrame([(1, b"x" * 10, 10, None), (2, b"x" * 10, 12, None), (3, b"x" * 30, None, None), (4, None, 50, "timeout"), (5, b"x" * 18, 18, None)], "id int, body binary, said int, error string")
    got = {r.id: (r.error, r.flags, r.body is None) for r in fetch.guarded(df, 20, 15, declared="said").collect()}
    assert got == {1: (None, [], False), 2: ("dataloss", [], True), 3: ("too_large", ["large"], True), 4: ("timeout", ["large"], True), 5: (None, ["large"], False)}
    assert {r.id: (r.error, r.flags) for r in fetch.guarded(df, 0, 0, False, "said").collect()}[2] == (None, ["dataloss"])
    assert [(len(r.body or b""), r.download_stopped) for r in fetch.stopped_early(df, 12).orderBy("id").collect()] == [(10, False), (10, False), (12, True), (0, False), (12, True)]
    maps = spark.createDataFrame([(1, "xml", "http://a.test/", b"<x/>"), (2, "binary", "http://a.test/", gzip.compress(b"<u/>" * 9)), (3, "text", "http://a.test/s.xml?x", b"<y/>"), (4, "html", "http://a.test/", b"<html>"), (5, "binary", "http://a.test/", gzip.compress(b"x" * 99)), (6, "binary", "u", b"\x1f\x8bbroken"), (7, None, None, None)], "id int, kind string, url string, body binary")
    got = {r.id: r.b and bytes(r.b) for r in maps.select("id", fetch.sitemap_body(F.col("kind"), F.col("url"), F.col("body"), 50).alias("b")).collect()}
    assert got == {1: b"<x/>", 2: b"<u/>" * 9, 3: b"<y/>", 4: None, 5: None, 6: None, 7: None}


def test_media_store(spark, tmp_path):
    m = spark.createDataFrame([("full/a", b"1"), ("full/a", b"2"), ("full/b", None), ("full/c", b"3")], "path string, body binary")
    folder = f"{tmp_path}/store"
    assert {r.path: (r.checksum, r.size) for r in media.store(m, folder, 1.0).collect()} == {"full/a": ("c81e728d9d4c2f636f067f89cc14862c", 1), "full/c": ("eccbc87e4b5ce2fe28308fd9f2a7baf3", 1)}
    media.store(m.filter("path = 'full/c'").withColumn("body", F.lit("newer").cast("binary")), folder, 2.0)
    assert {r.path: (r.size, r.stored_at) for r in media.stat(spark, folder).collect()} == {"full/a": (1, 1.0), "full/c": (5, 2.0)}
    for bad in ("", "/x", "a/../b", "./a", "a//b"):
        with pytest.raises(Exception, match="not a path"):
            media.store(spark.createDataFrame([(bad, b"x")], "path string, body binary"), folder, 3.0)


def test_item_loader_sources(spark):
    pages = spark.createDataFrame([(1, "<div class=a><b>x1</b><b>x2</b></div><b>y3</b>", '{"p": {"q": ["s", "t"]}}'), (2, "<p>", "{}")], "page_id int, html string, json string")
    nodes = dom.nodes(pages)
    ld = loader.ItemLoader().add_css("all", "b::text").add_xpath("num", "//b", pattern=r"\w(\d)").add_jmes("js", F.col("json"), "p.q[*]")
    ld.nested(xpath="//div").add_css("in", "b")
    got = {r.page_id: (r["all"], r.num, r.js, r["in"]) for r in ld.load(pages, "page_id", nodes=nodes).collect()}
    assert got == {1: (["x1", "x2", "y3"], ["1", "2", "3"], ["s", "t"], ["x1", "x2"]), 2: ([], [], [], [])}
    with pytest.raises(ValueError):
        ld.load(pages, "page_id")
    b = dom.css(nodes, "b::text")
    assert {r.page_id: r.value for r in dom.first(b, default="none", pages=pages).collect()} == {1: "x1", 2: "none"}
    assert [(r.at, r.value) for r in dom.matches(b, r"(\d)").orderBy("pre").collect()] == [(0, "1"), (0, "2"), (0, "3")]
    assert dom.attributes(dom.css(nodes, "div")).first().attrs == {"class": "a"}


def test_admission_outputs_and_close(spark):
    q = spark.createDataFrame([("a", 1, i, False) for i in range(9)] + [("b", 5, 20, False), (None, 0, 30, False)], "slot string, priority int, seq int, is_start boolean")
    busy = spark.createDataFrame([("a",), ("a",)], "slot string")
    assert [r.seq for r in frontier.admit(q, None, 100, 2).collect()] == [20, 0, 1, 30]
    assert [r.seq for r in frontier.admit(q, busy, 4, 3).collect()] == [20, 0]
    assert frontier.admit(q, busy, 1, 3).count() == 0
    o = spark.createDataFrame([(1, ["x", None, "y"]), (2, None), (3, [])], "id int, output array<string>")
    assert sorted((r.id, r.at, r.output) for r in chain.outputs(o).collect()) == [(1, 0, "x"), (1, 2, "y")]
    assert [r.output for r in chain.outputs(o.withColumn("output", F.get("output", F.lit(0)))).collect()] == ["x"]
    c = spark.createDataFrame([(5, 10, 0, 100.0, 7.0, 4)], "items int, pages int, errors int, elapsed double, since_item double, pages_since_item int")
    assert stats.close_reason(c, timeout=50, items=9).first().reason == "closespider_timeout" and stats.close_reason(c, timeout_no_item=5, pages_no_item=9).first().reason == "closespider_timeout_no_item"


def test_policy_counters_and_observation(spark):
    log = spark.createDataFrame([("offsite", "filtered", None, "a"), ("offsite", "filtered", None, "a"), ("offsite", "filtered", None, "b"), ("item", "dropped", "Empty", None), ("retry", "retry", "500", None), ("other", "x", "y", None)], "policy string, outcome string, reason string, domain string")
    assert {r.key: r.value for r in stats.policies(log).collect()} == {"offsite/filtered": 3, "offsite/domains": 2, "item_dropped_count": 1, "item_dropped_reasons_count/Empty": 1, "retry/count": 1, "retry/reason_count/500": 1}
    df, seen = stats.observed(log, "log", n=F.count("*"))
    df.collect()
    assert seen.get == {"n": 6}


def test_scratch_folder(spark, monkeypatch):
    with runtime.intermediates():
        df = runtime.materialize(spark.range(3), "x")
        assert df.count() == 3
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert not os.path.exists(path)

    class Conf:
        def get(self, *_):
            return None

    class Nothing:
        master = "yarn"

        class _jsc:
            @staticmethod
            def sc():
                return Nothing

        @staticmethod
        def getCheckpointDir():
            return Nothing

        @staticmethod
        def isDefined():
            return False

    class Cluster:
        conf, sparkContext = Conf(), Nothing()

    with pytest.raises(RuntimeError, match="share"):
        runtime.scratch_dir(Cluster())
