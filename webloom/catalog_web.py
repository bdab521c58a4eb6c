"""Queries of fetching, requests, media and further policies and statistics, with independent SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

import html.entities

from pyspark.sql import functions as F

from webloom.catalog import _HEADER_SQL, _QUEUE, _pages, _queue, _slot_events, _xml, query
from webloom.functions import urls
from webloom.operators import dom, frontier, links, loader, media, policies, requests, stats
from webloom.plans import chain
from webloom.runtime import scratch_path, spread, table
from webloom.sinks import exporters
from webloom.sources import fetch, stores

# --- media ------------------------------------------------------------------------------------------------


@query("""SELECT 'full/' || response_id || '.html' AS path, md5(body) AS checksum, octet_length(body)::BIGINT AS size FROM responses WHERE body IS NOT NULL""")
def media_store(spark, d):
    m = table(spark, d, "responses").select(F.concat(F.lit("full/"), "response_id", F.lit(".html")).alias("path"), "body")
    return media.store(m, scratch_path(spark, "media"), 1.0).select("path", "checksum", "size")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'uptodate' ELSE 'download' END AS status, CASE WHEN p_partkey % 3 < 2 THEN md5(p_name) END AS checksum FROM part""")
def media_freshness(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("full/"), "p_partkey").alias("path"), "p_name")
    stored = p.filter("id % 3 < 2").select("path", F.md5("p_name").alias("checksum"), F.when(F.col("id") % 3 == 0, 1e9).otherwise(1e9 - 91 * 86400).alias("stored_at"))
    return media.to_download(p.select("id", "path"), stored, 1e9 + 3600).select("id", "status", "checksum")


# --- fetching ----------------------------------------------------------------------------------------------


@query(f"""WITH {_QUEUE}, b AS (SELECT fingerprint, max_by(response_id, (coalesce(stored_at, -1e300), response_id)) AS response_id FROM responses GROUP BY fingerprint)
  SELECT request_id, r.response_id, r.status, octet_length(r.body) AS size, CASE WHEN r.status IS NULL THEN 'not_found' END AS error FROM q LEFT JOIN b ON q.fp = b.fingerprint LEFT JOIN responses r ON r.response_id = b.response_id""")
def fetch_pages(spark, d):
    got = fetch.from_pages(table(spark, d, "responses"))(_queue(spark, d))
    return got.select("request_id", "response_id", "status", F.octet_length("body").alias("size"), "error")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 2 THEN 200 END AS status, CASE WHEN p_partkey % 4 < 2 THEN p_name END AS body, CASE p_partkey % 4 WHEN 2 THEN 'not_supported' WHEN 3 THEN 'bad_address' END AS error FROM part""")
def fetch_schemes(spark, d):
    n, name = F.col("p_partkey") % 4, F.col("p_name")
    url = F.when(n == 0, F.concat(F.lit("DATA:text/plain;base64,"), F.base64(name.cast("binary")))).when(n == 1, F.concat(F.lit("own:"), name)).when(n == 2, F.lit("gopher://a.test/")).otherwise("data:nothing")
    own = lambda r: r.withColumns({"status": F.lit(200), "body": F.substring("url", 5, 1000).cast("binary"), "error": F.lit(None).cast("string")})
    got = fetch.fetch(table(spark, d, "part").select(F.col("p_partkey").alias("id"), url.alias("url")), {"own": own})
    return got.select("id", "status", F.col("body").cast("string").alias("body"), "error")


@query("""WITH h AS (SELECT fingerprint, max(try_cast(decode(value) AS BIGINT)) AS said FROM headers WHERE lower(name) = 'content-length' GROUP BY fingerprint), r AS (SELECT response_id, octet_length(body) AS size, said FROM responses LEFT JOIN h USING (fingerprint)),
  g AS (SELECT *, greatest(coalesce(size, said), coalesce(said, size)) AS most FROM r)
  SELECT response_id, CASE WHEN most > 6000 THEN 'too_large' WHEN size < said THEN 'dataloss' END AS error, coalesce(most > 4000, false) AS large, CASE WHEN coalesce(most > 6000, false) OR coalesce(size < said, false) THEN NULL ELSE size END AS kept FROM g""")
def fetch_guards(spark, d):
    h = table(spark, d, "headers").filter(F.lower("name") == "content-length").groupBy("fingerprint").agg(F.max(F.col("value").cast("string").try_cast("long")).alias("said"))
    r = table(spark, d, "responses").join(h, "fingerprint", "left").withColumn("error", F.lit(None).cast("string"))
    g = fetch.guarded(r, 6000, 4000, declared="said")
    return g.select("response_id", "error", F.coalesce(F.array_contains("flags", "large"), F.lit(False)).alias("large"), F.octet_length("body").alias("kept"))


@query("""WITH r AS (SELECT response_id, body, coalesce(status = 200 AND octet_length(body) > 1000, false) AS stopped FROM responses)
  SELECT response_id, CASE WHEN stopped THEN md5(unhex(left(hex(body), 2000))) ELSE md5(body) END AS checksum, stopped FROM r""")
def fetch_early_stop(spark, d):
    s = fetch.stopped_early(table(spark, d, "responses"), 1000, F.col("status") == 200)
    return s.select("response_id", F.md5("body").alias("checksum"), F.col("download_stopped").alias("stopped"))


# --- requests ------------------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES (0::BIGINT, 'http://a.test/x%20y', true, true), (1::BIGINT, 'https://b.test/?q=%C3%A9', true, true), (2::BIGINT, 'data:,x', true, true)) t(seq, url, dont_filter, is_start)""")
def start_requests(spark, d):
    return requests.marked_start(requests.start(spark, [" http://a.test/x y", "https://b.test/?q=é", "data:,x\n"]))




def _resolved(column: str) -> str:
    """SQL that resolves the named character references of HTML 4."""
    for name, code in html.entities.name2codepoint.items():
        if name != "amp":
            column = f"replace({column}, '&{name};', chr({code}))"
    return f"replace({column}, '&amp;', '&')"


#: an address as a page's link names it, made safe: everything outside letters, digits and marks percent-encoded
_SAFE_HREF = r"""array_to_string(list_transform(string_split({h}, ''), lambda c: CASE WHEN regexp_matches(c, '[A-Za-z0-9:/?#\[\]@!$&''()*+,;=._~|%-]') THEN c ELSE url_encode(c) END), '')"""
_SITE = r"""(regexp_extract(trim(url, ' ' || chr(10)), '^([A-Za-z]+://[^/?#]*)', 1))"""
_HREFS = rf"""r AS (SELECT response_id AS page_id, lower(regexp_extract({_SITE}, '^[A-Za-z]+', 0)) || regexp_replace({_SITE}, '^[A-Za-z]+', '') AS site,
  unnest(regexp_extract_all(regexp_replace(decode(body), '(?s)<!--.*?-->|<script.*?</script>', '', 'g'), '(?is)<a\b[^>]*?\bhref="([^"]*)"', 1)) AS raw FROM responses WHERE url IS NOT NULL),
  p AS (SELECT page_id, site, {_resolved("raw")} AS h FROM r)"""


@query(rf"WITH {_HREFS} SELECT page_id, site || {_SAFE_HREF.format(h='h')} AS url, count(*) AS n FROM p GROUP BY ALL")
def follow_all(spark, d):
    return requests.follow_all(_pages(spark, d), css="a").groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query(rf"WITH {_HREFS} SELECT DISTINCT page_id, site || {_SAFE_HREF.format(h='h')} AS url FROM p WHERE NOT regexp_matches(h, '/(?:log-in|sign-up)$')")
def link_addresses(spark, d):
    ex = links.LinkExtractor(deny=(r"/(?:log-in|sign-up)$",))
    return ex.extract(_pages(spark, d)).select("page_id", "url")


@query(r"""WITH b AS (SELECT response_id AS page_id, regexp_replace(decode(body), '(?s)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>', '', 'g') AS t FROM responses WHERE url IS NOT NULL AND body IS NOT NULL),
  e AS (SELECT lower(unnest(regexp_extract_all(t, '<([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>', 1))) AS tag FROM b) SELECT tag, count(*) AS n FROM e WHERE tag NOT IN ('script', 'style') GROUP BY tag""")
def dom_tags(spark, d):
    return dom.nodes(_pages(spark, d)).filter(~F.col("tag").isin("script", "style")).groupBy("tag").agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 'http://a.test/f/go' ELSE 'http://a.test/f/go?' || q END AS url, CASE WHEN p_partkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN p_partkey % 2 = 0 THEN q END AS body FROM
  (SELECT p_partkey, 'name=' || replace(url_encode(p_name), '%20', '+') || CASE WHEN p_size % 3 = 0 THEN '&small=on' ELSE '' END || '&c=' || CASE WHEN p_size % 5 = 0 THEN '2' ELSE '1' END || '&note=x+y&b=go&extra=1' AS q FROM part)""")
def form_requests(spark, d):
    p = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size"))
    page = F.concat(
        F.lit("<form name='other'><input name='no' value='1'></form><form name='f' action='go' method='"), F.when(F.col("p_partkey") % 2 == 0, "post").otherwise("get"), F.lit("'><input name='name' value='"), _xml(F.col("p_name")),
        F.lit("'><input type='checkbox' name='small'"), F.when(F.col("p_size") % 3 == 0, " checked").otherwise(""), F.lit("><input name='off' disabled><input type='reset' name='r'><select name='c'><option value='1'>one<option value='2'"),
        F.when(F.col("p_size") % 5 == 0, " selected").otherwise(""), F.lit(">two</select><textarea name='note'>x y</textarea><button name='b' value='go'>Go</button><input type='submit' name='s'><input name='gone' value='1'></form>"),
    )
    pages = p.select(F.col("p_partkey").alias("page_id"), F.lit("http://a.test/f/page").alias("url"), page.alias("html"))
    return requests.forms(pages, name="f", overrides={"extra": "1", "gone": None}).select("page_id", "url", "method", "body")


@query("""SELECT n_nationkey AS id, 'POST' AS method, '{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}' AS body FROM nation""")
def json_requests(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
    r = n.select(F.col("key").alias("id"), requests.json_request(requests.sorted_struct(n, ["region", "key", "name"])).alias("r"))
    return r.select("id", "r.method", "r.body")


@query("""SELECT n_nationkey AS id, '<?xml version=''1.0''?>' || chr(10) || '<methodCall>' || chr(10) || '<methodName>find</methodName>' || chr(10) || '<params>' || chr(10) || '<param>' || chr(10) || '<value><string>' || n_name || '</string></value>' || chr(10) || '</param>' || chr(10) || '</params>' || chr(10) || '</methodCall>' || chr(10) AS body FROM nation""")
def xmlrpc_requests(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("id"), requests.xmlrpc_request("find", F.array("n_name"))["body"].alias("body"))


@query(f"WITH {_QUEUE} SELECT request_id, url, method, body, CAST(coalesce(priority, 0) AS VARCHAR) AS priority, callback FROM q")
def request_dicts(spark, d):
    """Requests written as JSON and read back."""
    q = _queue(spark, d).select("request_id", "url", "method", "body", "priority", "callback")
    back = q.select("request_id", requests.from_dict(requests.to_dict(q)).alias("r"))
    return back.select("request_id", "r.url", "r.method", F.col("r.body").cast("string").alias("body"), F.col("r.priority").cast("string").alias("priority"), "r.callback")


@query("SELECT response_id, status, md5(body) AS checksum FROM responses WHERE url IS NOT NULL")
def response_dicts(spark, d):
    """Responses written as JSON and read back."""
    r = table(spark, d, "responses").filter("url is not null").select("response_id", "url", "status", "body")
    back = r.select("response_id", requests.from_dict(requests.to_dict(r, requests.RESPONSE), requests.RESPONSE).alias("r"))
    return back.select("response_id", "r.status", F.md5("r.body").alias("checksum"))


@query(rf"""WITH {_QUEUE}, t AS (SELECT *, regexp_extract(cu, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(cu, '(\?[^#]+)', 1) AS s, lower(regexp_extract(cu, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h FROM q),
  l AS (SELECT *, method || ' ' || CASE WHEN p = '' THEN '/' ELSE p END || s || ' HTTP/1.1' || chr(13) || chr(10) AS line FROM t)
  SELECT request_id, trim(regexp_replace('curl -X ' || method || ' ' || url || CASE WHEN body = '' THEN '' ELSE ' --data-raw ''' || body || '''' END || ' -H ''x-a: 1''', '\s+', ' ', 'g')) AS curl,
    line || 'Host: ' || h || chr(13) || chr(10) || 'x-a: 1' || chr(13) || chr(10) || chr(13) || chr(10) || body AS http, (length(line) + 8 + length(h) + 8 + 2 + octet_length(encode(body)))::BIGINT AS size FROM l""")
def request_texts(spark, d):
    h = F.create_map(F.lit("x-a"), F.array(F.lit("1").cast("binary")))
    u, m, b = F.col("url"), F.col("method"), F.col("body").cast("binary")
    return _queue(spark, d).select("request_id", requests.to_curl(u, m, h, b).alias("curl"), requests.to_http(u, m, h, b).cast("string").alias("http"), requests.wire_size(u, m, h, b).cast("long").alias("size"))


@query("""SELECT response_id, status || ' ' || coalesce(phrase, 'Unknown Status') AS message FROM responses LEFT JOIN (VALUES (200, 'OK'), (201, 'Created'), (204, 'No Content'), (206, 'Partial Content'), (301, 'Moved Permanently'), (302, 'Found'), (304, 'Not Modified'), (307, 'Temporary Redirect'), (308, 'Permanent Redirect'),
  (400, 'Bad Request'), (401, 'Unauthorized'), (403, 'Forbidden'), (404, 'Not Found'), (405, 'Method Not Allowed'), (410, 'Gone'), (418, 'I''m a teapot'), (500, 'Internal Server Error'), (502, 'Bad Gateway'), (503, 'Service Unavailable'), (504, 'Gateway Time-out')) t(code, phrase) ON status = code""")
def status_messages(spark, d):
    return table(spark, d, "responses").select("response_id", requests.status_message(F.col("status")).alias("message"))


@query(r"""WITH u AS (SELECT response_id, lower(regexp_extract(trim(url, ' ' || chr(10)), '^([A-Za-z]+):', 1)) AS s, lower(regexp_extract(trim(url, ' ' || chr(10)), '^[A-Za-z]+://([^/?#:]*)', 1)) AS h FROM responses WHERE url IS NOT NULL)
  SELECT response_id, CASE response_id % 5 WHEN 0 THEN 'http://own.test:3128' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CASE WHEN h = 'test' OR h LIKE '%.test' THEN NULL WHEN s = 'https' THEN 'http://secure.test:8080' ELSE 'http://all.test' END END AS proxy,
    CASE WHEN response_id % 5 = 0 THEN 'Basic ' || base64(encode('me:p@ss')) WHEN response_id % 5 > 2 AND s = 'https' AND NOT (h = 'test' OR h LIKE '%.test') THEN 'Basic ' || base64(encode('u:')) END AS proxy_auth FROM u""")
def request_proxies(spark, d):
    n = F.col("response_id") % 5
    r = table(spark, d, "responses").filter("url is not null").select("response_id", "url", F.when(n == 0, "http://me:p%40ss@own.test:3128").when(n == 1, "http://bad.test/path").alias("proxy"), (n < 3).alias("has_proxy"))
    return policies.proxied(r, {"all": "all.test", "https": "http://u@secure.test:8080"}, bypass=(".test",)).select("response_id", "proxy", "proxy_auth")


@query("""WITH p AS (SELECT *, p_size % 4 <> 0 AND p_size * 2.5 < 100 AS meant FROM part)
  SELECT p_partkey AS id, CASE WHEN NOT meant THEN 'none' WHEN p_partkey % 7 = 0 THEN 'too_many' ELSE 'follow' END AS outcome, CASE WHEN meant AND p_partkey % 7 <> 0 THEN 'http://a.test/n/' || p_partkey END AS target,
  CASE WHEN meant AND p_partkey % 7 <> 0 THEN 'meta refresh' END AS reason FROM p""")
def meta_refreshes(spark, d):
    p = table(spark, d, "part")
    head = "<html><!-- <meta http-equiv=refresh content='0; url=/no'> --><noscript><meta http-equiv='refresh' content='1;url=/no'></noscript><META HTTP-EQUIV=\"Refresh\" content=\""
    page = F.concat(F.lit(head), (F.col("p_size") * F.lit(2.5)).cast("string"), F.lit("; URL=n/"), "p_partkey", F.lit('">'))
    r = p.select(
        F.col("p_partkey").alias("id"), F.lit("http://a.test/x").alias("url"), F.when(F.col("p_size") % 4 == 0, "HEAD").otherwise("POST").alias("method"), F.lit("b").cast("binary").alias("body"), page.alias("html"),
        F.when(F.col("p_partkey") % 7 == 0, 20).otherwise(1).alias("redirect_times"), F.lit(0).alias("priority"),
    )
    return policies.meta_refreshed(r).select("id", "outcome", "target", F.get("new_redirect_reasons", F.lit(0)).alias("reason"))


@query("""WITH r AS (SELECT response_id, status, response_id % 4 AS k FROM responses)
  SELECT response_id, CASE WHEN status NOT IN (301, 302, 303, 307, 308) OR k = 1 OR (k = 2 AND status = 301) THEN 'none' WHEN k = 3 THEN 'too_many' ELSE 'follow' END AS outcome,
    CASE WHEN status IN (301, 302, 303, 307, 308) AND (k = 0 OR (k = 2 AND status <> 301)) THEN 'a,http://a.test/x' END AS visited, CASE WHEN status IN (301, 302, 303, 307, 308) AND (k = 0 OR (k = 2 AND status <> 301)) THEN 4 END AS ttl,
    CASE WHEN status IN (301, 302, 303, 307, 308) AND (k = 0 OR (k = 2 AND status <> 301)) THEN 'Referer' || CASE WHEN status IN (301, 302, 303) THEN ',Content-Type,Content-Length,Content-Encoding,Content-Language,Content-Location' ELSE '' END || ',Authorization' END AS dropped FROM r""")
def redirect_histories(spark, d):
    k = F.col("response_id") % 4
    r = table(spark, d, "responses").select(
        "response_id", F.lit("http://a.test/x").alias("url"), F.lit("POST").alias("method"), F.lit("b").cast("binary").alias("body"), "status", F.lit(" https://a.test/y ").alias("location"), F.lit(1).alias("redirect_times"), F.lit(0).alias("priority"),
        (k == 1).alias("dont_redirect"), F.when(k == 2, F.array(F.lit(301))).alias("handle_statuses"), F.when(k == 3, 0).otherwise(5).alias("redirect_ttl"), F.array(F.lit("a")).alias("redirect_urls"),
    )
    got = policies.redirect(r)
    return got.select("response_id", "outcome", F.array_join("new_redirect_urls", ",").alias("visited"), F.col("new_redirect_ttl").alias("ttl"), F.array_join("drop_headers", ",").alias("dropped"))


@query(rf"""WITH {_QUEUE}, h AS (SELECT request_id, priority, is_start, seq, lower(regexp_extract(cu, '^[A-Za-z]+://([^/?#:]*)', 1)) AS slot FROM q), b AS (SELECT slot, count(*) AS busy FROM h WHERE request_id % 97 = 0 GROUP BY slot),
  w AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY priority DESC NULLS LAST, is_start, seq) AS r FROM h WHERE request_id % 97 <> 0), f AS (SELECT * FROM w LEFT JOIN b USING (slot) WHERE r <= 4 - coalesce(busy, 0))
  SELECT request_id, slot FROM (SELECT *, row_number() OVER (ORDER BY priority DESC NULLS LAST, is_start, seq) AS k FROM f) WHERE k <= 600 - (SELECT count(*) FROM h WHERE request_id % 97 = 0)""")
def slot_admission(spark, d):
    q = _queue(spark, d).withColumn("slot", urls.slot_key(F.col("url")))
    busy = F.col("request_id") % 97 == 0  # what is under way
    return frontier.admit(q.filter(~busy), q.filter(busy).select("slot"), 600, 4).select("request_id", "slot")


# --- cache -------------------------------------------------------------------------------------------------------


@query(rf"""WITH {_HEADER_SQL}, p AS (PIVOT l ON name IN ('date', 'last-modified', 'cache-control', 'etag', 'content-length') USING first(v)),
  s AS (SELECT fingerprint, max_by(status, (coalesce(stored_at, -1e300), response_id)) AS status FROM responses GROUP BY fingerprint),
  x AS (SELECT p.fingerprint, status, substr(p.fingerprint, 1, 1) AS k, substr(p.fingerprint, 2, 1) AS r, epoch(coalesce(try_strptime("date", '%a, %d %b %Y %H:%M:%S GMT'), try_strptime("date", '%a %b %d %H:%M:%S %Y'))) AS dt,
    epoch(coalesce(try_strptime("last-modified", '%a, %d %b %Y %H:%M:%S GMT'), try_strptime("last-modified", '%a %b %d %H:%M:%S %Y'))) AS lm, coalesce("cache-control", '') AS cc, etag, CASE WHEN substr(p.fingerprint, 1, 1) IN ('4', '5') THEN try_cast("content-length" AS DOUBLE) END AS age FROM p JOIN s USING (fingerprint)),
  y AS (SELECT *, k IN ('0', '1', '2', '3') AS expires, coalesce(dt, 1775000000.0) AS d0, CASE k WHEN '0' THEN 1774999000.0 WHEN '1' THEN 784111777.0 WHEN '2' THEN 1776000000.0 END AS ex, CASE WHEN regexp_matches(cc, 'max-age=[0-9]+') THEN CAST(regexp_extract(cc, 'max-age=([0-9]+)', 1) AS DOUBLE) END AS ma FROM x),
  z AS (SELECT *, CASE WHEN ma IS NOT NULL THEN ma WHEN expires THEN greatest(coalesce(ex - d0, 0.0), 0.0) WHEN lm <= d0 THEN (d0 - lm) / 10 WHEN status IN (300, 301, 308) THEN 31536000.0 ELSE 0.0 END AS l0, greatest(1775000000.0 - d0, coalesce(age, 0.0), 0.0) AS ca FROM y),
  w AS (SELECT *, CASE WHEN r = '1' THEN least(l0, 60.0) ELSE l0 END AS li FROM z)
  SELECT fingerprint, li AS lifetime, ca AS current_age, NOT contains(cc, 'no-cache') AND r <> '0' AND (ca < li OR (NOT contains(cc, 'must-revalidate') AND (r = '2' OR (r = '3' AND ca < li + 5000000)))) AS fresh, NOT contains(cc, 'no-store') AND r <> '4' AND status <> 304 AND (contains(cc, 'max-age') OR expires OR status IN (300, 301, 308) OR (status IN (200, 203, 401) AND (lm IS NOT NULL OR etag IS NOT NULL))) AS storable,
    (CASE WHEN etag IS NULL THEN '' ELSE 'if-none-match' END) || (CASE WHEN lm IS NULL THEN '' ELSE 'if-modified-since' END) AS asked FROM w WHERE status IS NOT NULL""")
def cache_directives(spark, d):
    """Freshness with Expires, Age and the directives of requests, dealt out by the digits of the fingerprint."""
    m = stores.header_map(table(spark, d, "headers"))
    last = lambda n: F.element_at(F.element_at("headers", n), -1).cast("string").alias(n.replace("-", "_"))
    k, r = F.substring("fingerprint", 1, 1), F.substring("fingerprint", 2, 1)
    expires = F.when(k == "0", "Tue, 31 Mar 2026 23:16:40 GMT").when(k == "1", "Sunday, 06-Nov-94 08:49:37 GMT").when(k == "2", "Sun, 12 Apr 2026 13:20:00 +0000").when(k == "3", "0")
    asked = F.when(r == "0", "No-Cache").when(r == "1", "max-age=60").when(r == "2", "max-stale").when(r == "3", "max-stale=5000000").when(r == "4", "no-store")
    h = m.select("fingerprint", last("date"), last("last-modified"), last("cache-control"), last("etag"), expires.alias("expires"), F.when(k.isin("4", "5"), last("content-length")).alias("age"), asked.alias("request_cache_control"))
    s = table(spark, d, "responses").groupBy("fingerprint").agg(F.max_by("status", F.struct(F.coalesce("stored_at", F.lit(float("-inf"))), "response_id")).alias("status")).filter("status is not null")
    f = policies.freshness(h.join(s, "fingerprint"), 1775000000.0)
    names = F.array_join(F.array_sort(F.map_keys(policies.conditional_headers(F.col("etag"), F.col("last_modified")))), "")
    return f.select("fingerprint", "lifetime", "current_age", "fresh", "storable", F.regexp_replace(names, "^(if-modified-since)(if-none-match)$", "$2$1").alias("asked"))


@query("""WITH r AS (SELECT response_id, status, response_id % 3 = 0 AS fresh, response_id % 2 = 0 AS cached FROM responses)
  SELECT response_id, CASE WHEN cached AND fresh THEN 'hit' WHEN cached AND response_id % 5 = 0 THEN 'errorrecovery' WHEN cached AND (status = 304 OR status >= 500) THEN 'revalidate' WHEN cached THEN 'invalidate' WHEN status = 200 THEN 'firsthand' ELSE 'uncacheable' END AS route FROM r""")
def cache_routes(spark, d):
    r = table(spark, d, "responses")
    failed = F.when(F.col("response_id") % 5 == 0, "timeout")
    route = policies.cache_route(F.col("response_id") % 3 == 0, F.col("response_id") % 2 == 0, F.col("status"), failed, policies.revalidated(F.lit("max-age=1"), F.col("status")), F.col("status") == 200)
    return r.select("response_id", route.alias("route"))


# --- statistics ------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT response_id, status, response_id % 3 AS times, url FROM responses WHERE status IS NOT NULL),
  k AS (SELECT 'httperror/response_ignored_count' AS key FROM e WHERE status NOT BETWEEN 200 AND 299 UNION ALL SELECT 'httperror/response_ignored_status_count/' || status FROM e WHERE status NOT BETWEEN 200 AND 299
    UNION ALL SELECT 'retry/count' FROM e WHERE status >= 500 AND times < 2 UNION ALL SELECT 'retry/reason_count/' || status FROM e WHERE status >= 500 AND times < 2 UNION ALL SELECT 'retry/max_reached' FROM e WHERE status >= 500 AND times = 2
    UNION ALL SELECT 'urllength/request_ignored_count' FROM e WHERE length(url) > 60)
  SELECT key, count(*) AS value FROM k GROUP BY key""")
def stats_policies(spark, d):
    r = table(spark, d, "responses").filter("status is not null")
    none = F.lit(None).cast("string")
    errors = r.filter(~policies.http_error(F.col("status"))).select(F.lit("httperror").alias("policy"), F.lit("ignored").alias("outcome"), F.col("status").cast("string").alias("reason"), none.alias("domain"))
    tries = r.select(policies.retry(F.col("status"), (F.col("response_id") % 3).cast("int"), statuses=tuple(range(500, 600))).alias("outcome"), F.col("status").cast("string").alias("reason"))
    long_ = r.filter(~policies.url_length(F.col("url"), 60)).select(F.lit("urllength").alias("policy"), F.lit("filtered").alias("outcome"), none.alias("reason"), none.alias("domain"))
    return stats.policies(errors.unionByName(tries.filter("outcome <> 'pass'").select(F.lit("retry").alias("policy"), "outcome", "reason", none.alias("domain"))).unionByName(long_))


@query(f"""WITH {_QUEUE}, r AS (SELECT 'downloader/response_count' AS key, count(*) AS value FROM responses UNION ALL SELECT 'downloader/response_bytes', sum(coalesce(octet_length(body), 0))::BIGINT FROM responses
    UNION ALL SELECT 'downloader/response_status_count/' || status, count(*) FROM responses WHERE status IS NOT NULL GROUP BY status),
  m AS (SELECT 'downloader/request_count' AS key, count(*) AS value FROM q UNION ALL SELECT 'downloader/request_bytes', sum(octet_length(encode(body)))::BIGINT FROM q UNION ALL SELECT 'downloader/request_method_count/' || method, count(*) FROM q GROUP BY method),
  e AS (SELECT 'downloader/exception_count' AS key, count(*) AS value FROM events WHERE event_type = 'error' UNION ALL SELECT 'downloader/exception_type_count/timeout', count(*) FROM events WHERE event_type = 'error')
  SELECT * FROM r UNION ALL SELECT * FROM m UNION ALL SELECT * FROM e WHERE value > 0""")
def stats_transfers(spark, d):
    q = _queue(spark, d).select("method", F.octet_length("body").alias("bytes"))
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.lit("timeout").alias("type"))
    return stats.downloader(table(spark, d, "responses").select("status", F.coalesce(F.octet_length("body"), F.lit(0)).alias("bytes")), q, e)


@query("SELECT 'log_count/' || upper(event_type) AS key, count(*) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def stats_log_counts(spark, d):
    return stats.log_counts(table(spark, d, "events").select(F.col("event_type").alias("level")))


@query("""WITH t AS (SELECT event_type AS key, date_trunc('day', ts) AS tick, count(*) AS value FROM events WHERE contains(event_type, 'c') AND NOT contains(event_type, 'k') GROUP BY ALL) SELECT key, tick, value, value - coalesce(lag(value) OVER (PARTITION BY key ORDER BY tick), 0) AS delta FROM t""")
def stats_chosen_deltas(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.date_trunc("day", "ts").alias("tick")).agg(F.count("*").alias("value"))
    return stats.deltas(t, include=["c"], exclude=["k"])


@query("""WITH s AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS items, count(*) AS pages FROM events)
  SELECT 'items_per_minute' AS key, round(60.0 * items / n, 6) AS value FROM s UNION ALL SELECT 'responses_per_minute', round(60.0 * pages / n, 6) FROM s UNION ALL SELECT 'elapsed_time_seconds', n FROM s""")
def stats_core(spark, d):
    run = table(spark, d, "events").agg(F.min("ts").alias("start_time"), F.max("ts").alias("finish_time"), F.lit("finished").alias("reason"), F.count_if(F.col("event_type") == "purchase").alias("items"), F.count("*").alias("pages"))
    return stats.core(run).filter(~F.col("key").isin("start_time", "finish_time", "finish_reason")).select("key", F.col("value").cast("double").alias("value"))


@query("SELECT event_type AS signal, user_id % 5 AS sender, count(*) AS sent, min(ts) AS first, max(ts) AS last FROM events GROUP BY ALL")
def stats_signals(spark, d):
    return stats.signals(table(spark, d, "events").select(F.col("event_type").alias("signal"), (F.col("user_id") % 5).alias("sender"), "ts"))


# --- items and feeds ------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, p_name || '/' || p_partkey AS both FROM part""")
def item_selectors(spark, d):
    p = table(spark, d, "part")
    page = F.concat(F.lit("<div><h1>"), _xml(F.col("p_name")), F.lit("</h1><div class='spec'><b data-brand='"), "p_brand", F.lit("'>Size: "), "p_size", F.lit(" cm</b></div><b>Size: 0 cm</b></div>"))
    pages = p.select(F.col("p_partkey").alias("page_id"), page.alias("html"), F.to_json(F.struct(F.struct(F.col("p_partkey").alias("id")).alias("part"))).alias("json"))
    ld = loader.ItemLoader(default_out=loader.take_first).processors("both", output=loader.join_with("/"))
    ld.add_css("name", "h1::text").add_xpath("both", "//h1/text()").add_jmes("both", F.col("json"), "part.id")
    spec = ld.nested(css=".spec")
    spec.add_css("brand", "b::attr(data-brand)").add_css("size", "b", pattern=r"Size: (\d+)")
    return ld.load(pages, "page_id", nodes=dom.nodes(pages)).select("page_id", "name", "brand", "size", "both")


@query("SELECT n_nationkey AS id, i AS at, CASE WHEN i < n_nationkey % 4 THEN n_name || i END AS output, CASE WHEN i = n_nationkey % 4 THEN 'failed' END AS error FROM nation, range(0, 4) t(i) WHERE i < n_nationkey % 4 OR (i = n_nationkey % 4 AND n_nationkey % 5 = 0)")
def callback_outputs(spark, d):
    n = table(spark, d, "nation")
    k = (F.col("n_nationkey") % 4).cast("int")
    outs = F.transform(F.slice(F.array(*map(F.lit, range(4))), F.lit(1), k), lambda i: F.concat("n_name", i.cast("string")))
    r = n.select(F.col("n_nationkey").alias("id"), F.when(k > 0, outs).alias("output"), F.when(F.col("n_nationkey") % 5 == 0, "failed").alias("error"))
    return chain.outputs(r, error="error").withColumn("at", F.col("at").cast("long"))


_FEED = "SELECT n_nationkey AS id, n_name || ', \"' || n_regionkey || '\"' AS name, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END AS region FROM nation"


def _feed(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit(', "'), "n_regionkey", F.lit('"')).alias("name"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).cast("long").alias("region"))


def _written(spark, d, fmt, **how):
    """The feed written twice, the second time over the first."""
    path = scratch_path(spark, fmt)
    for _ in range(2):
        exporters.export(_feed(spark, d), path, fmt, "overwrite", **how)
    return path


@query(_FEED)
def feed_csv_file(spark, d):
    return spark.read.schema("id long, name string, region long").option("header", True).option("escape", '"').csv(_written(spark, d, "csv"))


@query(_FEED)
def feed_json_file(spark, d):
    return spark.read.schema("id long, name string, region long").option("multiLine", True).json(_written(spark, d, "json", codec="gzip"))


@query(_FEED)
def feed_xml_file(spark, d):
    return spark.read.schema("id long, name string, region long").option("rowTag", "item").format("xml").load(_written(spark, d, "xml"))


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 7 + 1 AS batch, n_nationkey AS id, n_name || ', \"' || n_regionkey || '\"' AS name FROM nation")
def feed_batch_files(spark, d):
    """A file per batch, named by its number; the number is read back from the name."""
    path = scratch_path(spark, "batches")
    exporters.export(exporters.batches(_feed(spark, d), 7, ["id"]), path, "jsonlines", batch="batch_id", name="feed-%(batch_id)03d")
    rows = spark.read.schema("id long, name string").json(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"feed-(\d+)\.jl$", 1).cast("long").alias("batch"), "id", "name")


@query("""WITH e AS (SELECT user_id AS slot, epoch(ts) AS ts, event_id AS seq FROM events) SELECT slot, count(*) AS n, true AS spaced, true AS waits FROM e GROUP BY slot""")
def slot_random_delays(spark, d):
    """Random delays stay between half and one and a half of the delay, and no request starts before it arrives."""
    from pyspark.sql import Window as W

    from webloom.operators import throttle

    s = throttle.start_times(_slot_events(spark, d), 900.0, randomize=True)
    gap = F.col("start") - F.lag("start").over(W.partitionBy("slot").orderBy("ts", "seq"))
    return s.withColumn("gap", gap).groupBy("slot").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("gap") >= 449.99, F.lit(True))).alias("spaced"), F.bool_and(F.col("start") >= F.col("ts") - 1e-3).alias("waits"))
