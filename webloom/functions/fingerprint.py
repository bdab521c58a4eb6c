"""Request fingerprints: SHA-1 over the sorted JSON of body, headers, method and canonical address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import canonicalize, with_canonical


def json_text(c: Column) -> Column:
    """JSON string with ASCII characters only."""

    def one(t: Column) -> Column:
        u16 = F.hex(F.encode(t, "UTF-16BE"))
        return (
            F.when(t == '"', '\\"').when(t == "\\", "\\\\").when(t == "\n", "\\n").when(t == "\r", "\\r").when(t == "\t", "\\t").when(t == "\b", "\\b").when(t == "\f", "\\f")
            .when(t.rlike(r"^[\x20-\x7e\x7f]$"), t)
            .otherwise(F.regexp_replace(F.lower(u16), "(....)", "\\\\\\\\u$1"))
        )

    slow = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([\s\S])"), F.lit(1)), one), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r'^[\x20-\x7f&&[^"\\]]*$'), c).otherwise(slow), F.lit('"'))


def headers_json(headers: Column, include: list[str]) -> Column:
    """The included headers of a map from lower-case name to values, as the fingerprint holds them."""
    names = F.array(*[F.lit(n) for n in sorted({n.lower() for n in include})])
    here = F.filter(names, lambda n: F.size(F.coalesce(F.element_at(headers, n), F.array().cast("array<binary>"))) > 0)
    one = lambda n: F.concat(
        F.lit('"'), F.lower(F.hex(n.cast("binary"))), F.lit('": ["'),
        F.array_join(F.transform(F.element_at(headers, n), lambda v: F.lower(F.hex(v.cast("binary")))), '", "'), F.lit('"]'),
    )
    return F.array_join(F.transform(here, one), ", ")


def fingerprint(
    url: Column, method: Column | None = None, body: Column | None = None, headers: Column | None = None, include_headers: list[str] | None = None,
    keep_fragments: bool | Column = False, verbatim: Column | None = None,
) -> Column:
    """40 hex digits naming a request; null where the address has no canonical form."""
    u = canonicalize(url, keep_fragments)
    if verbatim is not None:
        u = F.when(F.coalesce(verbatim, F.lit(False)), url).otherwise(u)
    m = F.upper(F.coalesce(method, F.lit("GET"))) if method is not None else F.lit("GET")
    b = F.lower(F.hex(F.coalesce(body.cast("binary"), F.lit(b"")))) if body is not None else F.lit("")
    h = headers_json(headers, include_headers) if headers is not None and include_headers else F.lit("")
    method_json = json_text(m) if method is not None else F.lit('"GET"')
    return F.sha1(F.concat(F.lit('{"body": "'), b, F.lit('", "headers": {'), h, F.lit('}, "method": '), method_json, F.lit(', "url": '), json_text(u), F.lit("}")).cast("binary"))


def with_fingerprint(df: DataFrame, url: str = "url", out: str = "fp", method: str | None = None, body: str | None = None) -> DataFrame:
    """``df`` with the fingerprint of its requests: what ``fingerprint`` gives without headers, for many rows."""
    d = with_canonical(df, url, "_c")
    plain = F.col("_c").rlike(r'^[\x20-\x7f&&[^"\\]]*$')
    text = F.when(plain, F.concat(F.lit('"'), "_c", F.lit('"'))).otherwise(json_text(F.col("_c")))
    m = F.lit('"GET"')
    if method:
        up = F.upper(F.coalesce(method, F.lit("GET")))
        m = F.when(up.rlike("^[A-Z]+$"), F.concat(F.lit('"'), up, F.lit('"'))).otherwise(json_text(up))
    b = F.lower(F.hex(F.coalesce(F.col(body).cast("binary"), F.lit(b"")))) if body else F.lit("")
    return d.withColumn(out, F.sha1(F.concat(F.lit('{"body": "'), b, F.lit('", "headers": {}, "method": '), m, F.lit(', "url": '), text, F.lit("}")).cast("binary"))).drop("_c")
