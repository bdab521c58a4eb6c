"""Requests as rows: start requests, followed links, forms, JSON and XML-RPC bodies, renderings and sizes."""

from __future__ import annotations

import re
import xmlrpc.client

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import dom
from webloom.operators.links import with_base

#: The phrases of HTTP statuses as crawlers print them.
STATUS_PHRASES = {
    100: "Continue", 101: "Switching Protocols",
    200: "OK", 201: "Created", 202: "Accepted", 203: "Non-Authoritative Information", 204: "No Content", 205: "Reset Content.", 206: "Partial Content", 207: "Multi-Status",
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 305: "Use Proxy", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable",
    407: "Proxy Authentication Required", 408: "Request Time-out", 409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed",
    413: "Request Entity Too Large", 414: "Request-URI Too Long", 415: "Unsupported Media Type", 416: "Requested Range not satisfiable", 417: "Expectation Failed", 418: "I'm a teapot",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Time-out", 505: "HTTP Version not supported",
    507: "Insufficient Storage Space", 510: "Not Extended",
}
FORM_TYPE = "application/x-www-form-urlencoded"


def start(spark: SparkSession, start_urls: list[str]) -> DataFrame:
    """``seq, url, dont_filter, is_start`` of the addresses a crawl begins with, in their order; none of them is a duplicate."""
    rows = spark.createDataFrame(list(enumerate(start_urls)), "seq long, url string")
    return rows.select("seq", urls.safe(F.col("url")).alias("url"), F.lit(True).alias("dont_filter"), F.lit(True).alias("is_start"))


def marked_start(requests: DataFrame) -> DataFrame:
    """Requests that come from the start of a crawl: marked as such unless they say otherwise."""
    mark = F.coalesce(F.col("is_start"), F.lit(True)) if "is_start" in requests.columns else F.lit(True)
    return requests.withColumn("is_start", mark)


def status_phrases(spark: SparkSession) -> DataFrame:
    """``status, phrase``: a dimension of some fifty rows, to be broadcast."""
    return spark.createDataFrame(sorted(STATUS_PHRASES.items()), "status int, phrase string")


def status_message(status: Column) -> Column:
    """Code and phrase; 'Unknown Status' for codes without one, null for null."""
    known = F.create_map(*[F.lit(x) for kv in sorted(STATUS_PHRASES.items()) for x in kv])
    return F.concat(status.cast("string"), F.lit(" "), F.coalesce(F.element_at(known, status.cast("int")), F.lit("Unknown Status")))


# --- following ------------------------------------------------------------------------------------------


def follow(pages: DataFrame, ref: str = "ref", url: str = "url", html: str | None = "html") -> DataFrame:
    """``pages`` with ``target``: column ``ref`` resolved against the page's base and made safe; null stays null."""
    d = with_base(pages, url, html) if html else pages.withColumn("_base", F.col(url))
    d = urls.resolve(d.withColumn("_ref", F.trim(F.col(ref))), "_base", "_ref", "_joined")
    return d.withColumn("target", urls.safe(F.col("_joined"))).drop("_base", "_ref", "_joined")


def follow_all(pages: DataFrame, css: str | None = None, xpath: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``page_id, pos, url`` of what a selection of each page (page_id, url, html) names, in document order.

    Selected ``a`` and ``link`` elements give their address (those without one are passed over, as are other elements), selected texts and attributes
    themselves. Repeated targets stay; pages with a null address give none.
    """
    if (css is None) == (xpath is None):
        raise ValueError("one of css and xpath")
    found = dom.css(dom.nodes(pages) if nodes is None else nodes, css) if css is not None else dom.xpath(dom.nodes(pages) if nodes is None else nodes, xpath)
    ref = F.col("value") if "value" in found.columns else F.when(F.col("tag").isin("a", "link"), F.element_at("attrs", "href"))
    refs = found.select("page_id", F.col("pre").alias("pos"), ref.alias("_r")).filter("_r is not null")
    site = with_base(pages.select("page_id", "url", "html").filter("url is not null"), "url").select("page_id", "_base")
    d = urls.resolve(refs.join(site, "page_id").withColumn("_r", F.trim("_r")), "_base", "_r", "_joined")
    return d.select("page_id", "pos", urls.safe(F.col("_joined")).alias("url"))


# --- forms -----------------------------------------------------------------------------------------------


def form_request(url: Column, pairs: Column, method: Column | None = None) -> Column:
    """Struct (url, method, body, content_type) that sends pairs (k, v): POST in the body, other methods as the query of the address.

    Without pairs the request stays as it is; without a method, pairs make it a POST. Values that are null count as ''.
    """
    has = F.coalesce(F.size(pairs) > 0, F.lit(False))
    m = F.upper(F.coalesce(method, F.when(has, "POST").otherwise("GET"))) if method is not None else F.when(has, "POST").otherwise("GET")
    query = urls.form_encode(pairs)
    post = has & (m == "POST")
    with_query = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), query, F.regexp_extract(url, r"(#[\s\S]*)$", 1))
    return F.struct(
        F.when(has & ~post, with_query).otherwise(url).alias("url"), m.alias("method"), F.when(post, query).alias("body"), F.when(post, FORM_TYPE).alias("content_type")
    )


def _named(attribute: str, want: str):
    return lambda x: F.element_at(x["attrs"], attribute) == want


def forms(pages: DataFrame, name: str | None = None, id: str | None = None, number: int = 0, css: str | None = None, xpath: str | None = None,
          overrides: dict[str, str | None] | None = None, click: dict[str, str] | None = None, dont_click: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """``page_id, url, method, body, content_type``: the request that submits one form of each page (page_id, url, html).

    The form is the ``number``-th of those with the name and id (and in the selection). What it sends: its enabled controls in document
    order - inputs, checked boxes, selected options (the first one of a single choice if none is), texts - then the control that is
    clicked: the first submit button, or the one that ``click`` names by its attributes; a page on which it names none or several gives no
    row. ``overrides`` replace controls of their name at the end; null removes them. Pages without such a form give no row.
    """
    if css is not None and xpath is not None:
        raise ValueError("css and xpath cannot both be set")
    site = with_base(pages.select("page_id", "url", "html").filter("url is not null"), "url")
    if nodes is None and css is None and xpath is None:
        parts = dom.form_parts(site)
    else:
        nodes = dom.nodes(pages) if nodes is None else nodes
        chosen = dom.css(nodes, css) if css is not None else dom.xpath(nodes, xpath) if xpath is not None else nodes
        parts = dom.form_parts_of(site, nodes, chosen)
    found = F.col("forms")
    for key, want in (("name", name), ("id", id)):
        if want is not None:
            found = F.filter(found, _named(key, want))
    # all that belongs to a page stands in its row, so nothing is joined; each step's columns are used more than once
    d = parts.withColumn("_f", F.get(found, F.lit(number))).filter("_f is not null")
    d = d.select("page_id", "url", "_base", F.col("_f.attrs").alias("_form"), F.filter("controls", lambda n: (n["pre"] > F.col("_f.pre")) & (n["pre"] <= F.col("_f.post"))).alias("_inside"))
    attr = lambda n, k: F.element_at(n["attrs"], k)
    has = lambda n, k: F.map_contains_key(n["attrs"], k)
    kind = lambda n: F.lower(F.coalesce(attr(n, "type"), F.when(n["tag"] == "button", "submit").otherwise("")))
    box = lambda n: (n["tag"] == "input") & n["kind"].isin("checkbox", "radio")
    button = lambda n: ((n["tag"] == "button") & (n["kind"] == "submit")) | ((n["tag"] == "input") & n["kind"].isin("submit", "image"))
    sends = lambda n: (n["tag"] != "button") & attr(n, "name").isNotNull() & ~((n["tag"] == "input") & n["kind"].isin("submit", "image", "button", "reset", "file")) & ~(box(n) & ~has(n, "checked"))
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    empty = F.array().cast("array<struct<k:string,v:string>>")
    control = F.filter("_inside", lambda n: (n["tag"] != "option") & ~has(n, "disabled"))
    options = F.transform(F.filter("_inside", lambda n: n["tag"] == "option"), lambda n: F.struct(n["pre"].alias("pre"), has(n, "selected").alias("on"), F.coalesce(attr(n, "value"), n["text"]).alias("v")))
    d = d.select("page_id", "url", "_base", "_form", F.transform(control, lambda n: n.withField("kind", kind(n))).alias("_control"), options.alias("_options"))

    def selected(n: Column) -> Column:
        """Options of a select: those selected, or the first one of a single choice."""
        own = F.filter("_options", lambda o: (o["pre"] > n["pre"]) & (o["pre"] <= n["post"]))
        on = F.filter(own, lambda o: o["on"])
        taken = F.when(F.exists(own, lambda o: o["on"]), on).when(has(n, "multiple"), F.slice(own, 1, 0)).otherwise(F.slice(own, 1, 1))
        return F.transform(taken, lambda o: pair(attr(n, "name"), o["v"]))

    def pairs_of(n: Column) -> Column:
        value = F.when(n["tag"] == "textarea", n["text"]).otherwise(F.coalesce(attr(n, "value"), F.when(box(n), "on").otherwise("")))
        return F.when(n["tag"] == "select", selected(n)).otherwise(F.array(pair(attr(n, "name"), value)))

    sent = F.flatten(F.transform(F.filter("_control", sends), pairs_of))
    buttons = F.transform(F.filter("_control", button), lambda n: F.struct(attr(n, "name").alias("n"), F.coalesce(attr(n, "value"), F.lit("")).alias("v"), n["attrs"].alias("attrs")))
    d = d.select("page_id", "url", "_base", "_form", sent.alias("sent"), buttons.alias("buttons"))
    hit = F.col("buttons")
    if click:
        for k, want in click.items():
            if k != "nr":
                hit = F.filter(hit, _named(k, want))
        if "nr" in click:
            hit = F.slice(F.col("buttons"), int(click["nr"]) + 1, 1)
        if not dont_click:
            d = d.filter((F.size("buttons") == 0) | (F.size(hit) == 1))
    clicked = F.when(F.lit(dont_click), F.lit(None)).otherwise(F.get(hit, F.lit(0)))
    pairs = F.concat("sent", F.when(clicked["n"].isNotNull(), F.array(F.struct(clicked["n"].alias("k"), clicked["v"].alias("v")))).otherwise(empty))
    if overrides:
        names = list(overrides)
        more = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in overrides.items() if v is not None]) if any(v is not None for v in overrides.values()) else empty
        pairs = F.concat(F.filter(pairs, lambda x: ~x["k"].isin(*names)), more)
    d = d.withColumn("_pairs", pairs).withColumn("_action", F.coalesce(F.nullif(F.trim(F.element_at("_form", "action")), F.lit("")), F.col("url")))
    d = urls.resolve(d, "_base", "_action", "_to")
    method = F.upper(F.coalesce(F.element_at("_form", "method"), F.lit("GET")))
    method = F.when(method.isin("GET", "POST"), method).otherwise("GET")
    return d.select("page_id", form_request(urls.safe(F.col("_to")), F.col("_pairs"), method).alias("r")).select("page_id", "r.*")


# --- JSON and XML-RPC -------------------------------------------------------------------------------------


def json_request(data: Column, body: Column | None = None, method: Column | None = None) -> Column:
    """Struct (method, body, headers) of a request that sends a struct as JSON with sorted keys; a body given by itself goes first.

    Null fields are left out, as in every JSON this engine writes.
    """
    text = F.to_json(data)
    out = text if body is None else F.coalesce(body, text)
    by_data = F.when(data.isNotNull() if body is None else data.isNotNull() & body.isNull(), "POST").otherwise("GET")
    m = F.upper(F.coalesce(method, by_data)) if method is not None else by_data
    headers = {"content-type": "application/json", "accept": "application/json, text/javascript, */*; q=0.01"}
    return F.struct(m.alias("method"), out.alias("body"), F.create_map(*[F.lit(x) for kv in headers.items() for x in kv]).alias("headers"))


def sorted_struct(df: DataFrame, columns: list[str]) -> Column:
    """The columns as a struct whose fields stand in the order of their names, as ``json_request`` wants it."""
    return F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])


def xmlrpc_request(methodname: str, params: Column) -> Column:
    """Struct (method, body, content_type, dont_filter) of an XML-RPC call with an array of strings as parameters."""

    @F.pandas_udf("string")
    def body(p: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else xmlrpc.client.dumps(tuple(v), methodname) for v in p])

    return F.struct(F.lit("POST").alias("method"), body(params).alias("body"), F.lit("text/xml").alias("content_type"), F.lit(True).alias("dont_filter"))


# --- renderings and sizes -------------------------------------------------------------------------------------


def _target(url: Column) -> Column:
    p = urls.path(url)
    return F.concat(F.when(p == "", "/").otherwise(p), F.regexp_extract(urls.clean(url), r"(\?[^#]+)", 1))


def _pairs(headers: Column) -> Column:
    """(name, value) of a map from name to values, in order of the names."""
    each = F.transform(F.array_sort(F.map_keys(headers)), lambda k: F.transform(F.element_at(headers, k), lambda v: F.struct(k.alias("k"), v.cast("binary").alias("v"))))
    return F.coalesce(F.flatten(each), F.array().cast("array<struct<k:string,v:binary>>"))


def wire_size(url: Column, method: Column, headers: Column, body: Column) -> Column:
    """Bytes of a request on the wire: request line, headers (with a Host, if they lack one), body."""
    line = F.length(F.concat(F.upper(method), F.lit(" "), _target(url), F.lit(" HTTP/1.1\r\n")))
    size = F.aggregate(_pairs(headers), F.lit(0), lambda n, p: n + F.length(p["k"]) + F.octet_length(p["v"]) + 4)
    host = F.when(F.coalesce(F.map_contains_key(headers, "host"), F.lit(False)) | (urls.hostname(url) == ""), 0).otherwise(8 + F.length(urls.hostname(url)))
    return line + size + host + 2 + F.coalesce(F.octet_length(body), F.lit(0))


def response_size(status: Column, headers: Column, body: Column) -> Column:
    """Bytes of a response on the wire: status line with its phrase, headers, body."""
    standard = {205: "Reset Content", 408: "Request Timeout", 416: "Range Not Satisfiable", 418: "I'm a Teapot", 413: "Content Too Large", 414: "URI Too Long", 504: "Gateway Timeout",
                505: "HTTP Version Not Supported", 507: "Insufficient Storage"}
    known = F.create_map(*[F.lit(x) for k, v in sorted((STATUS_PHRASES | standard).items()) for x in (k, len(v))])
    size = F.aggregate(_pairs(headers), F.lit(0), lambda n, p: n + F.length(p["k"]) + F.octet_length(p["v"]) + 2)
    between = 2 * F.greatest(F.coalesce(F.size(F.map_keys(headers)), F.lit(0)) - 1, F.lit(0))
    return 15 + F.coalesce(F.element_at(known, status.cast("int")), F.lit(0)) + size + between + 4 + F.coalesce(F.octet_length(body), F.lit(0))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def to_curl(url: Column, method: Column, headers: Column, body: Column, cookies: Column | None = None) -> Column:
    """The curl command that makes the request: first value of each header, cookies (k, v) last."""
    data = F.when(F.coalesce(F.octet_length(body), F.lit(0)) > 0, F.concat(F.lit("--data-raw '"), body.cast("string"), F.lit("'"))).otherwise("")
    heads = F.array_join(
        F.transform(F.coalesce(F.array_sort(F.map_keys(headers)), F.array().cast("array<string>")), lambda k: F.concat(F.lit("-H '"), k, F.lit(": "), F.element_at(headers, k)[0].cast("string"), F.lit("'"))), " "
    )
    out = [F.lit("curl -X "), F.upper(method), F.lit(" "), url, F.lit(" "), data, F.lit(" "), heads]
    if cookies is not None:
        jar = F.array_join(F.transform(cookies, lambda c: F.concat(c["k"], F.lit("="), c["v"])), "; ")
        out += [F.lit(" "), F.when(F.coalesce(F.size(cookies), F.lit(0)) > 0, F.concat(F.lit("--cookie '"), jar, F.lit("'"))).otherwise("")]
    return _squeezed(F.concat(*out))


def to_http(url: Column, method: Column, headers: Column, body: Column) -> Column:
    """The request as HTTP text (binary): request line, Host, headers, empty line, body."""
    head = F.concat(F.upper(method), F.lit(" "), _target(url), F.lit(" HTTP/1.1\r\nHost: "), urls.hostname(url), F.lit("\r\n"))
    lines = F.array_join(F.transform(_pairs(headers), lambda p: F.concat(p["k"], F.lit(": "), p["v"].cast("string"), F.lit("\r\n"))), "")
    return F.concat(F.concat(head, lines, F.lit("\r\n")).cast("binary"), F.coalesce(body.cast("binary"), F.lit(b"")))


#: a request as one JSON text; bytes are held as Base64
REQUEST = "url string, callback string, errback string, method string, headers map<string,array<string>>, body string, cookies map<string,string>, meta map<string,string>, encoding string, priority string, dont_filter boolean, flags array<string>, cb_kwargs map<string,string>"
RESPONSE = "url string, status int, headers map<string,array<string>>, body string, flags array<string>, protocol string, ip_address string"


def to_dict(df: DataFrame, kind: str = REQUEST) -> Column:
    """Each row as the JSON of a request (or of a response, with ``RESPONSE``): the fields the row has; header values and body as Base64."""
    names = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", kind)]
    cols = []
    for n in names:
        if n in df.columns:
            c = F.col(f"`{n}`")
            if n == "headers":
                c = F.transform_values(c, lambda _, v: F.transform(v, lambda x: F.base64(x.cast("binary"))))
            elif n == "body":
                c = F.base64(c.cast("binary"))
            elif n == "priority":
                c = c.cast("string")
            cols.append(c.alias(n))
    return F.to_json(F.struct(*cols))


def from_dict(text: Column, kind: str = REQUEST) -> Column:
    """Struct of a request or response from its JSON: method in upper case (GET without one), bytes decoded. Null where the text is no such JSON."""
    r = F.from_json(text, kind)
    names = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", kind)]
    cols = []
    for n in names:
        c = r[n]
        if n == "headers":
            c = F.transform_values(c, lambda _, v: F.transform(v, lambda x: F.unbase64(x)))
        elif n == "body":
            c = F.unbase64(c)
        elif n == "method":
            c = F.upper(F.coalesce(c, F.lit("GET")))
        elif n == "priority":
            c = F.coalesce(c.try_cast("decimal(38,0)"), F.lit(0))
        cols.append(c.alias(n))
    return F.when(r["url"].isNotNull(), F.struct(*cols))
