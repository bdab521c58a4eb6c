"""Feeds and bodies as rows: sitemaps, CSV and XML feeds, data addresses, content coding, types and encodings, curl commands."""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import re
import shlex
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls

# --- sitemaps --------------------------------------------------------------------------------------


def _tag(block: Column, name: str) -> Column:
    v = F.regexp_extract(block, rf"(?is)<(?:\w+:)?{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{name}\s*>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return F.nullif(F.trim(v), F.lit(""))


def sitemap(docs: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``key, kind, pos, loc, lastmod, changefreq, priority, alternates`` of the entries of sitemaps and sitemap indexes.

    Prefixes of names mean nothing; entries without a loc are left out; a file that breaks off gives the
    entries before the break. Null bodies give none.
    """
    t = F.regexp_replace(F.col(body).cast("string"), r"(?s)<!--.*?-->", "")
    kind = F.when(t.rlike(r"(?i)<(?:\w+:)?sitemapindex\b"), "sitemapindex").when(t.rlike(r"(?i)<(?:\w+:)?urlset\b"), "urlset")
    blocks = F.regexp_extract_all(t, F.lit(r"(?is)<(?:\w+:)?(?:url|sitemap)(?:\s[^>]*)?>(.*?)</(?:\w+:)?(?:url|sitemap)\s*>"), F.lit(1))
    e = docs.filter(F.col(body).isNotNull()).select(key, kind.alias("kind"), F.posexplode(blocks).alias("pos", "b")).filter("kind is not null")
    links = F.regexp_extract_all(F.col("b"), F.lit(r"""(?is)<(?:\w+:)?link\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    out = e.select(key, "kind", "pos", _tag(F.col("b"), "loc").alias("loc"), _tag(F.col("b"), "lastmod").alias("lastmod"), _tag(F.col("b"), "changefreq").alias("changefreq"), _tag(F.col("b"), "priority").alias("priority"), links.alias("alternates"))
    return out.filter("loc is not null")


def sitemap_urls(entries: DataFrame, rules: list[tuple[str, str]], follow: list[str] = ("",), alternates: bool = False, key: str = "id") -> DataFrame:
    """``key, url, callback`` of page entries by the first rule (pattern, callback) that fits, ``callback`` null with ``kind`` sitemapindex to follow."""
    locs = F.concat(F.array("loc"), F.when(F.lit(alternates), F.col("alternates")).otherwise(F.array().cast("array<string>")))
    each = entries.select(key, "kind", "pos", F.posexplode(locs).alias("at", "url"))
    cb = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        cb = F.when(F.col("url").rlike(pattern), name).otherwise(cb)
    wanted = F.lit(False)
    for f in follow:
        wanted = wanted | F.col("url").rlike(f)
    each = each.withColumn("callback", F.when(F.col("kind") == "urlset", cb))
    return each.filter(((F.col("kind") == "sitemapindex") & wanted) | F.col("callback").isNotNull())


# --- CSV and XML -----------------------------------------------------------------------------------


def csv_rows(docs: DataFrame, key: str = "id", body: str = "body", delimiter: str = ",", quote: str = '"', headers: list[str] | None = None) -> DataFrame:
    """``key, line, row map<string,string>`` of CSV texts; rows whose number of fields differs from the header's are dropped."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = csv.reader(io.StringIO(text), delimiter=delimiter, quotechar=quote)
                names = headers
                for n, r in enumerate(rows):
                    if names is None:
                        names = r
                    elif len(r) == len(names):
                        out.append((k, n, list(zip(names, r))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.schema.field(0).type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.map_(pa.string(), pa.string()))], [key, "line", "row"])

    return docs.filter(F.col(body).isNotNull()).select(key, F.col(body).cast("string")).mapInArrow(run, f"{key} {kind}, line int, row map<string,string>")


def xml_nodes(docs: DataFrame, node: str, key: str = "id", body: str = "body") -> DataFrame:
    """``key, pos, xml, attrs`` of each element of the name, whatever its prefix; nested elements of one name end at the first end tag."""
    t = F.regexp_replace(F.col(body).cast("string"), r"(?s)<!--.*?-->", "")
    name = re.escape(node.split(":")[-1])
    found = F.regexp_extract_all(t, F.lit(rf"(?s)(<(?:\w+:)?{name}(?:\s[^>]*)?(?:/>|>.*?</(?:\w+:)?{name}\s*>))"), F.lit(1))
    each = docs.filter(F.col(body).isNotNull()).select(key, F.posexplode(found).alias("pos", "xml"))
    start = F.regexp_extract("xml", r"^<[^>]*>", 0)
    pairs = F.transform(F.regexp_extract_all(start, F.lit(r"""([\w:-]+\s*=\s*(?:"[^"]*"|'[^']*'))"""), F.lit(1)), lambda a: F.struct(F.regexp_extract(a, r"^([\w:-]+)", 1).alias("k"), F.regexp_extract(a, r"""=\s*["'](.*)["']$""", 1).alias("v")))
    return each.withColumn("attrs", F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))))


def xml_text(xml: Column, name: str) -> Column:
    """Text of the first element of the name inside ``xml``."""
    return _tag(xml, name.split(":")[-1])


# --- bodies -----------------------------------------------------------------------------------------


def data_url(url: Column) -> Column:
    """Struct (media_type, charset, body) of a data address; null for others."""
    m = lambda i: F.regexp_extract(url, r"(?is)^data:([^;,]*)((?:;[^,]*?)??)(;base64)?,([\s\S]*)$", i)
    raw = m(4)
    plain = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    charset = F.regexp_extract(m(2), r"(?i);charset=\"?([^;\"]*)", 1)
    return F.when(
        url.rlike(r"(?i)^data:[^,]*,"),
        F.struct(
            F.when(m(1) == "", "text/plain").otherwise(F.lower(m(1))).alias("media_type"), F.when(charset == "", "US-ASCII").otherwise(charset).alias("charset"),
            F.when(m(3) != "", F.try_to_binary(F.regexp_replace(plain, r"\s", ""), F.lit("base64"))).otherwise(plain.cast("binary")).alias("body"),
        ),
    )


class _Cut(ValueError):
    """A coded body that ends before its end."""


def _members(body: bytes, most: int, wbits: int) -> bytes:
    """All members of a gzip body (or the one zlib or raw deflate stream), at most ``most`` + 1 bytes of them."""
    out, rest = [], body
    size = 0
    while rest:
        d = zlib.decompressobj(wbits)
        part = d.decompress(rest, most + 1 - size)
        out.append(part)
        size += len(part)
        if size > most:
            break
        if not d.eof:
            raise _Cut
        rest = d.unused_data if wbits == 31 else b""
        if not rest.lstrip(b"\0"):  # padding after the last member
            break
    return b"".join(out)


def _unbrotli(body: bytes, most: int) -> bytes:
    import brotli

    d, out, size = brotli.Decompressor(), [], 0
    for s in range(0, len(body), 1 << 14):
        out.append(d.process(body[s : s + (1 << 14)]))
        size += len(out[-1])
        if size > most:
            break
    else:
        if not d.is_finished():
            raise _Cut
    return b"".join(out)


def _unzstd(body: bytes, most: int) -> bytes:
    import zstandard

    out, size = [], 0
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True) as r:
        while chunk := r.read(min(1 << 20, most + 1 - size)):
            out.append(chunk)
            size += len(chunk)
    return b"".join(out)


def _inflate(body: bytes, codings: list[str], most: int) -> tuple[bytes, list[str], bool]:
    left = list(codings)
    while left:
        c = left[-1]
        try:
            if c in ("gzip", "x-gzip"):
                body = _members(body, most, 31)
            elif c == "deflate":
                try:
                    body = _members(body, most, 15)
                except zlib.error:
                    body = _members(body, most, -15)
            elif c == "zstd":
                body = _unzstd(body, most)
            elif c == "br":
                body = _unbrotli(body, most)
            elif c != "identity":
                break
        except (zlib.error, ImportError, OSError, ValueError, _zstd_error()):
            break
        left.pop()
        if len(body) > most:
            return b"", left, True
    return body, left, False


def _zstd_error():
    try:
        import zstandard
    except ImportError:
        return OSError
    return zstandard.ZstdError


def decode_content(df: DataFrame, body: str = "body", encoding: str = "content_encoding", most: int = 1 << 30) -> DataFrame:
    """``df`` with ``decoded``, ``codings_left`` and ``too_large``: codings are undone from the last to the first; unknown, broken and cut off ones stay."""

    @F.pandas_udf("struct<decoded:binary,codings_left:array<string>,too_large:boolean>")
    def run(b: pd.Series, e: pd.Series) -> pd.DataFrame:
        out = []
        for x, c in zip(b, e):
            codings = [y.strip().lower() for y in (c or "").split(",") if y.strip()]
            out.append((None, codings, False) if x is None else _inflate(bytes(x), codings, most))
        return pd.DataFrame(out, columns=["decoded", "codings_left", "too_large"])

    return df.withColumn("_d", run(F.col(body), F.col(encoding))).select(*df.columns, "_d.*")


def response_type(content_type: Column, url: Column, body: Column) -> Column:
    """Class of a response: 'html', 'xml', 'json', 'text' or 'binary' by its type, its address, its first bytes."""
    ct = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"^([^;]*)", 1)))
    ext = F.lower(F.regexp_extract(urls.path(url), r"\.([A-Za-z0-9]+)$", 1))
    head = F.substring(body.cast("binary"), 1, 4096)
    hexa = F.hex(head)
    text = F.lower(F.ltrim(F.regexp_replace(head.cast("string"), "^\\ufeff", "")))
    by_type = (
        F.when(ct.isin("text/html", "application/xhtml+xml", "application/vnd.wap.xhtml+xml"), "html")
        .when(ct.isin("text/xml", "application/xml") | ct.endswith("+xml"), "xml")
        .when((ct == "application/json") | ct.endswith("+json") | ct.isin("application/x-json"), "json")
        .when(ct.startswith("text/"), "text")
        .when((ct != "") & ~ct.isin("application/octet-stream", "application/x-unknown"), "binary")
    )
    by_ext = F.when(ext.isin("html", "htm", "xhtml"), "html").when(ext.isin("xml", "rss", "atom"), "xml").when(ext == "json", "json").when(ext.isin("txt", "csv", "md"), "text")
    by_body = (
        F.when(hexa.rlike("^(?:EFBBBF|FEFF|FFFE|0000FEFF)") & ~text.rlike("^<"), "text")
        .when(text.startswith("<?xml"), "xml").when(text.startswith("<!doctype html") | text.startswith("<html"), "html")
        .when(hexa.rlike("^(?:..)*00"), "binary").when(F.try_validate_utf8(head.cast("string")).isNotNull(), "text").otherwise("binary")
    )
    return F.coalesce(by_type, by_ext, F.when(body.isNull(), "text"), by_body)


def declared_encoding(content_type: Column, body: Column) -> Column:
    """Charset of a response: header, byte order mark, declaration in the first bytes; utf-8 by default."""
    head = F.substring(body.cast("binary"), 1, 4096)
    hexa = F.hex(F.substring(head, 1, 4))
    text = F.decode(head, "ISO-8859-1")
    header = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", 1)
    bom = F.when(hexa.startswith("0000FEFF"), "utf-32be").when(hexa == "FFFE0000", "utf-32le").when(hexa.startswith("EFBBBF"), "utf-8").when(hexa.startswith("FEFF"), "utf-16be").when(hexa.startswith("FFFE"), "utf-16le")
    meta = F.regexp_extract(text, r"(?is)<(?:\?xml\b[^>]*?\bencoding|meta\b[^>]*?\bcharset)\s*=\s*[\"']?\s*([\w.:-]+)", 1)
    return F.lower(F.coalesce(F.nullif(header, F.lit("")), bom, F.nullif(meta, F.lit("")), F.lit("utf-8")))


def decoded_text(df: DataFrame, body: str = "body", encoding: str = "encoding") -> DataFrame:
    """``df`` with ``text``: common charsets in the JVM, others by Arrow batch; what cannot be decoded becomes U+FFFD."""

    @F.pandas_udf("string")
    def odd(b: pd.Series, e: pd.Series) -> pd.Series:
        def one(x, c):
            if x is None or c is None:
                return None
            try:
                return bytes(x).decode(c, "replace")
            except LookupError:
                return bytes(x).decode("utf-8", "replace")

        return pd.Series([one(x, c) for x, c in zip(b, e)])

    common = F.col(encoding).isin("utf-8", "utf8", "us-ascii", "ascii", "iso-8859-1")
    # the Python function sees the body of the odd rows only
    rest = odd(F.when(~common, F.col(body)), F.when(~common, F.col(encoding)))
    utf8 = F.make_valid_utf8(F.col(body).cast("string"))
    return df.withColumn("text", F.when(F.col(encoding) == "iso-8859-1", F.decode(F.col(body), "ISO-8859-1")).when(common, F.regexp_replace(utf8, "^\\ufeff", "")).otherwise(rest))


# --- curl --------------------------------------------------------------------------------------------

#: Options of curl that say nothing about the request.
_IGNORED = {"-s", "--silent", "-k", "--insecure", "-L", "--location", "--compressed", "-v", "--verbose", "-#", "--progress-bar", "-i", "--include", "-f", "--fail", "-g", "--globoff"}


def parse_curl(command: str) -> dict | None:
    """Request a curl command makes; None where the text is no such command."""
    try:
        args = shlex.split(command)
    except ValueError:
        return None
    if not args or args[0] != "curl":
        return None
    out = {"url": None, "method": None, "headers": {}, "body": None, "cookies": {}}
    data, k = [], 1
    values = {"-X": "method", "--request": "method", "--url": "url"}
    while k < len(args):
        a = args[k]
        k += 1
        v = None
        if a.startswith("--") and "=" in a:
            a, v = a.split("=", 1)
        elif re.match(r"-[XHdbuAe].", a) and not a.startswith("--"):
            a, v = a[:2], a[2:]
        takes = a in values or a in ("-H", "--header", "-d", "--data", "--data-raw", "--data-binary", "--data-urlencode", "-b", "--cookie", "-u", "--user", "-A", "--user-agent", "-e", "--referer")
        if takes and v is None:
            if k >= len(args):
                return None
            v, k = args[k], k + 1
        if a in values:
            out[values[a]] = v
        elif a in ("-H", "--header"):
            n, _, hv = v.partition(":")
            if n.strip().lower() == "cookie":
                out["cookies"].update(c.strip().split("=", 1) for c in hv.split(";") if "=" in c)
            else:
                out["headers"][n.strip().lower()] = hv.strip()
        elif a in ("-b", "--cookie"):
            out["cookies"].update(c.strip().split("=", 1) for c in v.split(";") if "=" in c)
        elif a in ("-u", "--user"):
            import base64

            out["headers"]["authorization"] = "Basic " + base64.b64encode(v.encode("latin-1", "replace")).decode()
        elif a in ("-A", "--user-agent"):
            out["headers"]["user-agent"] = v
        elif a in ("-e", "--referer"):
            out["headers"]["referer"] = v
        elif a.startswith(("-d", "--data")):
            data.append(v[1:] if v.startswith("$") else v)
        elif a in _IGNORED:
            continue
        elif not a.startswith("-") and out["url"] is None:
            out["url"] = a
        elif a.startswith("-"):
            return None
    if out["url"] is None:
        return None
    if "://" not in out["url"]:
        out["url"] = "http://" + out["url"]
    if data:
        out["body"] = "&".join(data)
    out["method"] = (out["method"] or ("POST" if data else "GET")).upper()
    return out


def curl_request(command: Column) -> Column:
    """Struct of the request of each curl command; fields are null where it cannot be read."""

    @F.pandas_udf("struct<url:string,method:string,headers:map<string,string>,body:string,cookies:map<string,string>>")
    def run(commands: pd.Series) -> pd.DataFrame:
        empty = {"url": None, "method": None, "headers": None, "body": None, "cookies": None}
        return pd.DataFrame([(parse_curl(c) if c is not None else None) or empty for c in commands], columns=list(empty))

    return run(command)


def compress(data: bytes, codec: str) -> bytes:
    return {"gzip": gzip.compress, "bz2": bz2.compress, "lzma": lzma.compress, "none": bytes}[codec](data)
