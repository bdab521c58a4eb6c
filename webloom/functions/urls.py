"""Address functions as Column expressions: everything stays in the JVM.

Most addresses need no byte-level work, so every function first tests for that and only falls back to
token transforms where an escape or an unusual character is present.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that stand unquoted in a path, in a query name or value, and in a fragment.
PATH_SAFE = r":/?\[\]@!$&'()*+,;=a-zA-Z0-9\-._~|%"
COMPONENT_SAFE = r"a-zA-Z0-9\-._~"
FRAGMENT_SAFE = r":/?#\[\]@!$&'()*+,;=a-zA-Z0-9\-._~|%"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}

_TOKENS = r"(%[0-9A-Fa-f]{2}|[\s\S])"
#: scheme, authority (with //), path, query (with ?), fragment (with #)
_PARTS = r"^([A-Za-z][A-Za-z0-9+\-.]*):(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"


def clean(url: Column) -> Column:
    """Without control characters and blanks around it, and without tabs and line breaks inside."""
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "\t\r\n", "")


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(1))


def _escape(token: Column) -> Column:
    return F.regexp_replace(F.hex(token.cast("binary")), "(..)", "%$1")


def _ascii(hex2: Column) -> Column:
    return F.decode(F.unhex(hex2), "US-ASCII")


def quote(c: Column, safe: str) -> Column:
    """``c`` with every character outside ``safe`` percent-encoded; existing escapes count as characters."""
    slow = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([\s\S])"), F.lit(1)), lambda t: F.when(t.rlike(f"^[{safe}]$"), t).otherwise(_escape(t))), "")
    return F.when(c.rlike(f"^[{safe}]*$"), c).otherwise(slow)


def safe(url: Column) -> Column:
    """An address as a request holds it: no control characters or blanks around it, unsafe characters percent-encoded, the host in ASCII.

    Escapes that are there stay as they are; what has no scheme is quoted as a path with query and fragment.
    """
    u = clean(url)
    part = lambda i: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+\-.]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$", i)
    loc = part(2)
    user = F.regexp_extract(loc, r"^(//[\s\S]*@)", 1)
    host = F.regexp_extract(loc, r"([^@/]*)$", 1)
    ascii_host = F.when(host.rlike(r"[^\x00-\x7f]"), F.coalesce(F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), host), host)).otherwise(host)
    slow = F.concat(
        part(1), F.when(loc == "", "").when(user == "", F.concat(F.lit("//"), ascii_host)).otherwise(F.concat(quote(user, PATH_SAFE), ascii_host)),
        quote(part(3), PATH_SAFE), quote(part(4), PATH_SAFE), quote(part(5), FRAGMENT_SAFE),
    )
    return F.when(u.rlike(f"^[{FRAGMENT_SAFE}]*$"), u).otherwise(slow)


def canonical_path(path: Column) -> Column:
    """Escapes are resolved (but for / and ?) and set anew; an empty path becomes /."""

    def one(t: Column) -> Column:
        byte = F.upper(F.substring(t, 2, 2))
        return (
            F.when(t.rlike("^%(2[fF]|3[fF])$"), F.upper(t))
            .when(t.rlike("^%[0-9A-Fa-f]{2}$"), F.when(byte.rlike("^[2-7]") & _ascii(byte).rlike(f"^[{PATH_SAFE}]$"), _ascii(byte)).otherwise(F.concat(F.lit("%"), byte)))
            .when(t.rlike(f"^[{PATH_SAFE}]$"), t)
            .otherwise(_escape(t))
        )

    plain = path.rlike(f"^[{PATH_SAFE}]+$") & ~path.contains("%")
    return F.when(path == "", "/").when(plain, path).otherwise(F.array_join(F.transform(_tokens(path), one), ""))


def canonical_query(query: Column) -> Column:
    """Pairs split at & and ;, sorted by the bytes of name and value, quoted anew; '' for a query without pairs."""

    def to_hex(c: Column) -> Column:
        return F.array_join(F.transform(_tokens(c), lambda t: F.when(t.rlike("^%[0-9A-Fa-f]{2}$"), F.upper(F.substring(t, 2, 2))).when(t == "+", "20").otherwise(F.hex(t.cast("binary")))), "")

    def from_hex(c: Column) -> Column:
        return F.array_join(
            F.transform(
                F.regexp_extract_all(c, F.lit("(..)"), F.lit(1)),
                lambda b: F.when(b == "20", "+").when(b.rlike("^[2-7]") & _ascii(b).rlike(f"^[{COMPONENT_SAFE}]$"), _ascii(b)).otherwise(F.concat(F.lit("%"), b)),
            ),
            "",
        )

    parts = F.filter(F.split(query, "[&;]"), lambda x: x != "")
    name = lambda x: F.regexp_extract(x, r"^([^=]*)", 1)
    value = lambda x: F.regexp_extract(x, r"^[^=]*=([\s\S]*)$", 1)
    plain = query.rlike(f"^[{COMPONENT_SAFE}=&;]*$") & ~query.rlike("=[^&;]*=")
    # = becomes the smallest character, so that sorting the texts sorts by name, then by value
    marked = F.translate(F.regexp_replace(F.translate(query, ";", "&"), "(^|&)([^&=]+)(?=&|$)", "$1$2="), "=", "\x01")
    fast = F.translate(F.array_join(F.array_remove(F.array_sort(F.split(marked, "&")), ""), "&"), "\x01", "=")
    slow = F.array_join(
        F.transform(F.array_sort(F.transform(parts, lambda x: F.struct(to_hex(name(x)).alias("n"), to_hex(value(x)).alias("v")))), lambda p: F.concat(from_hex(p["n"]), F.lit("="), from_hex(p["v"]))), "&"
    )
    return F.when(query == "", "").when(plain & ~query.rlike("[&;]"), F.concat(query, F.when(query.contains("="), "").otherwise("="))).when(plain, fast).otherwise(slow)


def canonical_authority(authority: Column) -> Column:
    """Host in lower case and ASCII, without a trailing colon; user and port stay."""
    user = F.regexp_extract(authority, r"^([\s\S]*@)", 1)
    host = F.regexp_extract(authority, r"([^@]*)$", 1)
    host = F.when(host.rlike(r"[^\x00-\x7f]"), F.coalesce(F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), host), host)).otherwise(host)
    return F.concat(user, F.regexp_replace(F.lower(host), ":+$", ""))


def canonicalize(url: Column, keep_fragments: bool | Column = False) -> Column:
    """Canonical form of an address; null for null and for texts without a valid scheme."""
    u = clean(url)
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    authority, query, fragment = part(2), F.substring(part(4), 2, 1 << 30), F.substring(part(5), 2, 1 << 30)
    q = canonical_query(query)
    keep = keep_fragments if isinstance(keep_fragments, Column) else F.lit(keep_fragments)
    out = F.concat(
        F.lower(part(1)), F.lit(":"),
        F.when(authority == "", "").otherwise(F.concat(F.lit("//"), canonical_authority(F.substring(authority, 3, 1 << 30)))),
        canonical_path(part(3)),
        F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)),
        F.when(keep & (fragment != ""), F.concat(F.lit("#"), quote(fragment, FRAGMENT_SAFE))).otherwise(""),
    )
    return F.when(u.rlike(_PARTS), out)


_SPLIT = "\x1f"


def with_canonical(df: DataFrame, url: str, out: str, keep_fragments: bool = False) -> DataFrame:
    """``df`` with column ``out``, the canonical form of column ``url``: what ``canonicalize`` gives, for many rows.

    One regular expression cuts the address; the parts are columns of their own, which the optimizer keeps
    apart because each is used several times. Plain parts never reach the token transforms.
    """
    d = df.withColumn("_u", clean(F.col(url)))
    cut = F.split(F.regexp_replace("_u", _PARTS, _SPLIT.join(("$1", "$2", "$3", "$4", "$5"))), _SPLIT)
    d = d.withColumn("_cut", F.when(F.col("_u").rlike(_PARTS) & ~F.col("_u").contains(_SPLIT), cut))
    d = d.withColumns(
        {
            "_auth": F.substring(F.col("_cut")[1], 3, 1 << 30), "_path": F.col("_cut")[2], "_query": F.substring(F.col("_cut")[3], 2, 1 << 30), "_frag": F.substring(F.col("_cut")[4], 2, 1 << 30),
        }
    )
    plain_host = F.col("_auth").rlike(r"^[A-Za-z0-9.\-]+(?::\d+)?$")
    d = d.withColumns({"_auth": F.when(plain_host, F.lower("_auth")).otherwise(canonical_authority(F.col("_auth"))), "_path": canonical_path(F.col("_path")), "_query": canonical_query(F.col("_query"))})
    text = F.concat(
        F.lower(F.col("_cut")[0]), F.lit(":"), F.when(F.col("_cut")[1] == "", "").otherwise(F.concat(F.lit("//"), "_auth")), "_path", F.when(F.col("_query") == "", "").otherwise(F.concat(F.lit("?"), "_query"))
    )
    if keep_fragments:
        text = F.concat(text, F.when(F.col("_frag") == "", "").otherwise(F.concat(F.lit("#"), quote(F.col("_frag"), FRAGMENT_SAFE))))
    return d.withColumn(out, F.when(F.col("_u").contains(_SPLIT), canonicalize(F.col(url), keep_fragments)).otherwise(text)).drop("_u", "_cut", "_auth", "_path", "_query", "_frag")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean(url), _PARTS, 1))


def netloc(url: Column) -> Column:
    """User, host and port as they stand."""
    return F.substring(F.regexp_extract(clean(url), _PARTS, 2), 3, 1 << 30)


def hostname(url: Column) -> Column:
    """Host in lower case, without user, port and brackets; '' where there is none."""
    host = F.regexp_extract(netloc(url), r"([^@]*)$", 1)
    return F.lower(F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(host, r":[^:]*$", "")))


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(clean(url), _PARTS, 3)


def port_of(s: Column) -> Column:
    """The port a scheme has by itself; '' for others."""
    return F.coalesce(*[F.when(s == k, v) for k, v in DEFAULT_PORTS.items()], F.lit(""))


def origin(url: Column) -> Column:
    """scheme://host[:port], the port left out where it is the scheme's own."""
    s, p = scheme(url), port(url)
    return F.concat(s, F.lit("://"), hostname(url), F.when((p == "") | (p == port_of(s)), "").otherwise(F.concat(F.lit(":"), p)))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def slot_key(url: Column, slot: Column | None = None) -> Column:
    """Download slot: the one named, else the host."""
    return F.coalesce(slot, hostname(url)) if slot is not None else hostname(url)


def strip(url: Column, credentials: bool = True, default_port: bool = True, origin_only: bool = False, fragment: bool = True) -> Column:
    """Address without credentials, default port and fragment; with ``origin_only`` also without path and query."""
    u = clean(url)
    s, loc = scheme(url), netloc(url)
    if credentials or origin_only:
        loc = F.regexp_extract(loc, r"([^@]*)$", 1)
    if default_port:
        loc = F.when(F.regexp_extract(loc, r":(\d+)$", 1) == port_of(s), F.regexp_replace(loc, r":\d+$", "")).otherwise(loc)
    tail = F.lit("/") if origin_only else F.concat(path(url), F.regexp_extract(u, _PARTS, 4), F.lit("") if fragment else F.regexp_extract(u, _PARTS, 5))
    return F.when(u.rlike(_PARTS), F.concat(s, F.lit("://"), loc, tail))


def add_scheme(url: Column, default: str = "http") -> Column:
    """``url`` with a scheme: itself if it has one, ``file`` for paths, else ``default``."""
    u = F.trim(url)
    return (
        F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), u)
        .when(u.rlike(r"^(/|\./|\.\./|~/|[A-Za-z]:\\)"), F.concat(F.lit("file://"), u))
        .otherwise(F.concat(F.lit(default + "://"), F.regexp_replace(u, "^//", "")))
    )


def matches_domain(host: Column, domains: list[str] | Column) -> Column:
    """Whether ``host`` is one of the domains or below one. With an array column the list may differ by row."""
    if isinstance(domains, Column):
        return F.exists(domains, lambda d: (host == F.lower(d)) | host.endswith(F.concat(F.lit("."), F.lower(d))))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d.lower()) | host.endswith("." + d.lower())
    return out


def host_suffixes(host: Column) -> Column:
    """a.b.c, b.c, c: makes the test against a large list of domains an equality join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def has_extension(url: Column, extensions: list[str]) -> Column:
    """Whether the path ends in one of the extensions (one pattern, not a test each)."""
    if not extensions:
        return F.lit(False)
    return F.lower(path(url)).rlike("(?:" + "|".join(re.escape(e.lower()) for e in extensions) + ")$")


def _remove_dots(p: Column) -> Column:
    """Dot segments of a path resolved (RFC 3986, 5.2.4)."""
    segments = F.split(p, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(~p.rlike(r"(^|/)\.\.?(/|$)"), p).otherwise(F.array_join(closed, "/"))


def _resolved(r: Column, b: Column, root: Column, site: Column, folder: Column, bpath: Column, rpath: Column, rest: Column) -> Column:
    absolute = r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    # one dot-segment removal serves the absolute, rooted and relative cases
    head = F.when(absolute, F.regexp_extract(r, r"^([A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?)", 1)).otherwise(site)
    whole = F.when(absolute, F.regexp_extract(r, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)).when(rpath.startswith("/"), rpath).otherwise(F.concat(folder, rpath))
    own = F.regexp_replace(b, r"#[\s\S]*$", "")
    return (
        F.when(r.startswith("//"), F.concat(root, r))
        .when(r == "", own)
        .when(r.startswith("#"), F.concat(own, r))
        .when(r.startswith("?"), F.concat(site, bpath, r))
        .otherwise(F.concat(head, _remove_dots(whole), rest))
    )


def _base_parts(b: Column) -> dict[str, Column]:
    bp = lambda i: F.regexp_extract(b, _PARTS, i)
    return {
        "root": F.concat(F.lower(bp(1)), F.lit(":")), "site": F.concat(F.lower(bp(1)), F.lit(":"), bp(2)), "bpath": bp(3),
        "folder": F.when((bp(2) != "") & (bp(3) == ""), "/").otherwise(F.regexp_extract(bp(3), r"^([\s\S]*/)", 1)),
    }


def join(base: Column, ref: Column) -> Column:
    """Reference resolved against a base address (RFC 3986); null if either is null. Over many rows use ``resolve``."""
    r, b = clean(ref), clean(base)
    return _resolved(r, b, rpath=F.regexp_extract(r, r"^([^?#]*)", 1), rest=F.regexp_extract(r, r"^[^?#]*([\s\S]*)$", 1), **_base_parts(b))


def resolve(df: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """``df`` with column ``out``: ``ref`` resolved against ``base``.

    The parts are columns of their own, each used several times, so the optimizer keeps them apart: every
    part is computed once a row and the generated code stays small.
    """
    d = df.withColumns({"_r": clean(F.col(ref)), "_b": clean(F.col(base))})
    d = d.withColumns({f"_{k}": v for k, v in _base_parts(F.col("_b")).items()} | {"_rpath": F.regexp_extract("_r", r"^([^?#]*)", 1), "_rest": F.regexp_extract("_r", r"^[^?#]*([\s\S]*)$", 1)})
    c = {k: F.col(f"_{k}") for k in ("r", "b", "root", "site", "folder", "bpath", "rpath", "rest")}
    return d.withColumn(out, _resolved(**c)).drop(*[f"_{k}" for k in c])


def _form_text(c: Column) -> Column:
    """A name or value of a form: blanks as +, all but letters, digits and ``-._~`` percent-encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def form_encode(pairs: Column) -> Column:
    """application/x-www-form-urlencoded text of an array of structs k, v; null values count as ''."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(_form_text(p["k"]), F.lit("="), _form_text(F.coalesce(p["v"], F.lit(""))))), "&")


def has_nofollow(rel: Column) -> Column:
    return F.coalesce(F.array_contains(F.split(F.lower(rel), r"[\s,]+"), "nofollow"), F.lit(False))
