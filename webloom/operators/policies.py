"""Request and response policies: each a filter or a projection over columns, nothing row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls

#: Statuses that are fetched again.
RETRY_STATUSES = (500, 502, 503, 504, 522, 524, 408, 429)


# --- filters -------------------------------------------------------------------------------------


def http_error(status: Column, allowed: Column | None = None, allow_all: bool = False) -> Column:
    """Whether a response goes on to the callback: 2xx, or a status allowed for it."""
    ok = status.between(200, 299)
    if allow_all:
        return F.lit(True)
    return ok | F.coalesce(F.array_contains(allowed, status), F.lit(False)) if allowed is not None else ok


def url_length(url: Column, limit: int = 2083) -> Column:
    return F.lit(True) if limit <= 0 else F.length(url) <= limit


def offsite(url: Column, domains: list[str], bypass: Column | None = None) -> Column:
    """Whether a request stays on the allowed domains; no domains allow everything, entries that are addresses are ignored."""
    real = [d.lower() for d in domains if d and "://" not in d]
    inside = urls.matches_domain(urls.hostname(url), real) if real else F.lit(True)
    return inside if bypass is None else inside | F.coalesce(bypass, F.lit(False))


def depth(requests: DataFrame, limit: int = 0, adjust: int = 0) -> DataFrame:
    """Children with their own depth and priority; those deeper than ``limit`` are dropped. ``depth`` and ``priority`` come from the parent."""
    out = requests.withColumn("depth", F.coalesce("depth", F.lit(0)) + 1).withColumn("priority", F.col("priority") - F.col("depth") * adjust)
    return out.filter(F.col("depth") <= limit) if limit else out


# --- retry -----------------------------------------------------------------------------------------


def retry(status: Column, times: Column, error: Column | None = None, most: int = 2, statuses: tuple = RETRY_STATUSES, dont: Column | None = None) -> Column:
    """'retry', 'give_up' or 'pass' for a response (or an exception in ``error``) already retried ``times`` times."""
    bad = status.isin(*statuses)
    if error is not None:
        bad = bad | error.isNotNull()
    if dont is not None:
        bad = bad & ~F.coalesce(dont, F.lit(False))
    return F.when(~F.coalesce(bad, F.lit(False)), "pass").when(F.coalesce(times, F.lit(0)) + 1 <= most, "retry").otherwise("give_up")


def retried(requests: DataFrame, adjust: int = -1) -> DataFrame:
    """Requests as they are queued again: unfiltered, one more try, lower priority."""
    return requests.withColumn("retry_times", F.coalesce("retry_times", F.lit(0)) + 1).withColumn("priority", F.col("priority") + adjust).withColumn("dont_filter", F.lit(True))


# --- redirects ---------------------------------------------------------------------------------------

_REDIRECTS = (301, 302, 303, 307, 308)


#: headers that describe a body and go with it
BODY_HEADERS = ("Content-Type", "Content-Length", "Content-Encoding", "Content-Language", "Content-Location")


def redirect(df: DataFrame, most: int = 20, adjust: int = 2) -> DataFrame:
    """The request a response redirects to: columns url, method, body, status, location, redirect_times, priority.

    If there, ``dont_redirect`` (boolean), ``handle_statuses`` (array: statuses the callback takes), ``redirect_ttl``, ``redirect_urls`` and
    ``redirect_reasons`` count as well. Adds ``target`` (null where the response is no redirect to follow), ``new_method``, ``new_body``,
    ``drop_headers`` (names not to be sent on), ``outcome`` (none, follow, unsupported or too_many) and the new values of the histories.
    """
    df = urls.resolve(df.withColumn("_loc", F.trim("location")), "url", "_loc", "_joined").drop("_loc")
    is_redirect = F.col("status").isin(*_REDIRECTS) & F.col("location").isNotNull() & (F.trim("location") != "")
    if "dont_redirect" in df.columns:
        is_redirect = is_redirect & ~F.coalesce("dont_redirect", F.lit(False))
    if "handle_statuses" in df.columns:
        is_redirect = is_redirect & ~F.coalesce(F.array_contains("handle_statuses", F.col("status")), F.lit(False))
    to_get = ((F.col("status") == 303) & ~F.upper("method").isin("GET", "HEAD")) | (F.col("status").isin(301, 302) & (F.upper("method") == "POST"))
    return _redirected(df, F.coalesce(is_redirect, F.lit(False)), to_get, F.col("status").cast("string"), most, adjust)


def _redirected(df: DataFrame, applies: Column, to_get: Column, reason: Column, most: int, adjust: int) -> DataFrame:
    """``redirect`` and ``meta_refreshed`` for rows that ``applies`` holds for, to the address ``_joined``."""
    here = df.columns
    df = df.withColumns({"_applies": applies, "_get": to_get})
    df = df.withColumn("_target", F.when(F.col("_joined").contains("#"), F.col("_joined")).otherwise(F.concat("_joined", F.regexp_extract("url", r"(#[\s\S]*)$", 1))))
    df = df.withColumns({"_ts": urls.scheme(F.col("_target")), "_th": urls.hostname(F.col("_target")), "_s": urls.scheme(F.col("url")), "_h": urls.hostname(F.col("url"))})
    times = F.coalesce("redirect_times", F.lit(0)) + 1
    ttl = F.coalesce("redirect_ttl", F.lit(most)) if "redirect_ttl" in here else F.lit(most)
    followable = F.col("_ts").isin("http", "https") | (F.col("_ts") == F.col("_s"))
    outcome = F.when(~F.col("_applies"), "none").when(~F.coalesce(followable, F.lit(False)), "unsupported").when((times > most) | (ttl <= 0), "too_many").otherwise("follow")
    cross_host = F.col("_th") != F.col("_h")
    weaker = ~F.col("_ts").isin("https") & (F.col("_ts") != F.col("_s"))
    port = lambda u: F.coalesce(F.nullif(urls.port(u), F.lit("")), urls.port_of(urls.scheme(u)))
    other_origin = cross_host | (F.col("_ts") != F.col("_s")) | (port(F.col("url")) != port(F.col("_target")))
    empty = F.array().cast("array<string>")
    names = lambda *n: F.array(*map(F.lit, n))
    drop = F.concat(
        names("Referer"), F.when(F.col("_get"), names(*BODY_HEADERS)).otherwise(empty), F.when(cross_host | weaker, names("Cookie")).otherwise(empty),
        F.when(other_origin, names("Authorization")).otherwise(empty),
    )
    follow = F.col("outcome") == "follow"
    history = lambda c, x: F.concat(F.coalesce(c, empty) if c in here else empty, F.array(x))
    return (
        df.withColumn("outcome", outcome)
        .withColumns(
            {
                "target": F.when(follow, F.col("_target")), "new_method": F.when(follow, F.when(F.col("_get"), "GET").otherwise(F.upper("method"))), "new_body": F.when(follow & ~F.col("_get"), F.col("body")),
                "drop_headers": F.when(follow, drop), "new_priority": F.when(follow, F.col("priority") + adjust), "new_redirect_times": F.when(follow, times), "new_redirect_ttl": F.when(follow, ttl - 1),
                "new_redirect_urls": F.when(follow, history("redirect_urls", F.col("url"))), "new_redirect_reasons": F.when(follow, history("redirect_reasons", reason)),
            }
        )
        .drop("_joined", "_target", "_ts", "_th", "_s", "_h", "_applies", "_get")
    )


def meta_refreshed(df: DataFrame, most: int = 20, adjust: int = 2, max_delay: float = 100.0, ignore: tuple = ("noscript",)) -> DataFrame:
    """The request a page's meta refresh leads to, in the columns of ``redirect``: columns url, method, body, html, priority, redirect_times.

    HTML answers (html is null for others) to other methods than HEAD count, with a delay under ``max_delay`` and an http(s) address; the
    request becomes a GET, its reason is 'meta refresh'.
    """
    df = df.withColumn("_m", meta_refresh(F.substring("html", 1, 4096), F.col("url"), ignore)).withColumn("_joined", F.col("_m.url"))
    ok = F.col("_m").isNotNull() & (F.col("_m.delay") < max_delay) & (F.upper("method") != "HEAD") & urls.scheme(F.col("url")).isin("http", "https") & urls.scheme(F.col("_joined")).isin("http", "https")
    if "dont_redirect" in df.columns:
        ok = ok & ~F.coalesce("dont_redirect", F.lit(False))
    return _redirected(df, F.coalesce(ok, F.lit(False)), F.lit(True), F.lit("meta refresh"), most, adjust).drop("_m")


def redirect_chains(edges: DataFrame, most: int = 20) -> DataFrame:
    """Where each address of ``edges`` (url, target) ends: url, final, hops. Cycles end after ``most`` hops with final null.

    Pointer jumping: each round doubles the length that every row knows, so chains of n hops need log2(n)
    joins on an equality key, and no row fans out (an address has one target).
    """
    from webloom.runtime import materialize

    state = edges.filter("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("final")).withColumn("hops", F.lit(1).cast("long"))
    known, span = materialize(state, "chains"), 1
    while span <= most:
        nxt = known.select(F.col("url").alias("final"), F.col("final").alias("_f"), F.col("hops").alias("_h"))
        known = materialize(known.join(nxt, "final", "left").select("url", F.coalesce("_f", "final").alias("final"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops")), "chains")
        span *= 2
        if known.join(state.select(F.col("url").alias("final")), "final", "left_semi").isEmpty():
            break
    return known.select("url", F.when(F.col("hops") <= most, F.col("final")).alias("final"), F.least("hops", F.lit(most + 1)).alias("hops"))


#: <meta http-equiv="refresh" content="5; url=...">
_REFRESH = r"""(?is)<meta\b(?=[^>]*http-equiv\s*=\s*["']?refresh)[^>]*content\s*=\s*(?:"\s*(\d+(?:\.\d+)?)\s*[;,]\s*(?:url\s*=\s*)?'?([^"']*)'?"|'\s*(\d+(?:\.\d+)?)\s*[;,]\s*(?:url\s*=\s*)?"?([^"']*)"?')"""


def meta_refresh(html: Column, base: Column, ignore: tuple = ("script", "noscript")) -> Column:
    """Struct (delay double, url string) of the first meta refresh outside comments and ignored elements; null without one."""
    t = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    for tag in ignore:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?(?:</{tag}\s*>|$)", "")
    g = lambda i: F.regexp_extract(t, _REFRESH, i)
    delay = F.coalesce(F.nullif(g(1), F.lit("")), F.nullif(g(3), F.lit("")))
    target = F.trim(F.concat(g(2), g(4)))
    return F.when(delay.isNotNull(), F.struct(delay.cast("double").alias("delay"), urls.join(base, target).alias("url")))


# --- referrer ---------------------------------------------------------------------------------------

REFERRER_POLICIES = (
    "no-referrer", "no-referrer-when-downgrade", "same-origin", "origin", "strict-origin", "origin-when-cross-origin",
    "strict-origin-when-cross-origin", "unsafe-url", "default",
)


def policy_of_header(header: Column) -> Column:
    """The last valid token of a Referrer-Policy header; null if there is none."""
    tokens = F.filter(F.transform(F.split(F.lower(header), ","), lambda t: F.trim(t)), lambda t: t.isin(*[p for p in REFERRER_POLICIES if p != "default"]))
    return F.get(tokens, F.size(tokens) - 1)


def referer(policy: Column, parent: Column, target: Column) -> Column:
    """Referer sent from ``parent`` to ``target``; null for none. ``policy`` null counts as 'default'."""
    p = F.coalesce(policy, F.lit("default"))
    local = ~F.coalesce(urls.scheme(parent).isin("http", "https", "ftp"), F.lit(False))
    full, root = urls.strip(parent), urls.strip(parent, origin_only=True)
    same = urls.origin(parent) == urls.origin(target)
    tls = urls.scheme(parent) == "https"
    secure_target = urls.scheme(target) == "https"
    downgrade = tls & ~secure_target
    return F.when(
        ~local,
        F.when(p == "no-referrer", None)
        .when(p == "unsafe-url", full)
        .when(p == "origin", root)
        .when(p == "same-origin", F.when(same, full))
        .when(p == "strict-origin", F.when(~downgrade, root))
        .when(p == "origin-when-cross-origin", F.when(same, full).otherwise(root))
        .when(p == "strict-origin-when-cross-origin", F.when(same, full).when(~downgrade, root))
        .otherwise(F.when(~downgrade, full)),
    )


# --- headers ------------------------------------------------------------------------------------------


def with_defaults(headers: Column, defaults: dict[str, str]) -> Column:
    """Map of headers (lower-case names) with the defaults set where a name is absent."""
    base = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k.lower()), F.array(F.lit(v).cast("binary")))])
    absent = F.map_filter(base, lambda k, _: ~F.map_contains_key(headers, k))
    return F.map_concat(headers, absent)


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.encode(F.concat(user, F.lit(":"), password), "ISO-8859-1")))


def with_request_defaults(requests: DataFrame, headers: dict[str, str] | None = None, user_agent: str | None = None, timeout: float | None = None, auth: tuple[str, str, str | None] | None = None) -> DataFrame:
    """``requests`` (url, headers map) with what is set where a request has none: headers, user agent, ``download_timeout``, Basic auth.

    ``auth``: user, password, domain (null: every host).
    """
    out = requests
    base = {**(headers or {}), **({"User-Agent": user_agent} if user_agent else {})}
    if base:
        out = out.withColumn("headers", with_defaults(F.col("headers"), base))
    if auth:
        user, password, domain = auth
        value = F.create_map(F.lit("authorization"), F.array(basic_auth(F.lit(user), F.lit(password)).cast("binary")))
        here = ~F.map_contains_key("headers", "authorization")
        if domain is not None:
            here = here & urls.matches_domain(urls.hostname(F.col("url")), [domain])
        out = out.withColumn("headers", F.when(here, F.map_concat("headers", value)).otherwise(F.col("headers")))
    if timeout is not None:
        own = F.coalesce("download_timeout", F.lit(float(timeout))) if "download_timeout" in requests.columns else F.lit(float(timeout))
        out = out.withColumn("download_timeout", own)
    return out


#: Schemes a proxy may have.
PROXY_SCHEMES = ("http", "https", "socks4", "socks4a", "socks5", "socks5h")


def proxy_parts(proxy: Column, scheme: Column) -> Column:
    """Struct (url, auth) of a proxy address: without credentials, and the value of Proxy-Authorization (null without).

    A host by itself gets the request's scheme. Null where it is no proxy: unknown scheme, no host, a path or query, credentials
    for a SOCKS4 proxy, a password without user.
    """
    p = F.when(proxy.contains("://"), proxy).otherwise(F.concat(F.coalesce(scheme, F.lit("http")), F.lit("://"), F.regexp_replace(proxy, "^//", "")))
    s, host, port = urls.scheme(p), urls.hostname(p), urls.port(p)
    cred = F.regexp_extract(urls.netloc(p), r"^([\s\S]*)@", 1)
    user, password = F.regexp_extract(cred, "^([^:]*)", 1), F.regexp_extract(cred, "^[^:]*:([\\s\\S]*)$", 1)
    shown = F.concat(s, F.lit("://"), F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)))
    plus = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    ok = s.isin(*PROXY_SCHEMES) & (host != "") & urls.path(p).isin("", "/") & ~F.regexp_extract(p, r"^[^?#]*([\s\S]*)$", 1).rlike(".") & ~((cred != "") & s.isin("socks4", "socks4a")) & ((user != "") | (password == ""))
    return F.when(ok, F.struct(shown.alias("url"), F.when(cred != "", basic_auth(plus(user), plus(password))).alias("auth")))


def proxied(requests: DataFrame, proxies: dict[str, str], bypass: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` (url, proxy, has_proxy boolean) with ``proxy`` and ``proxy_auth``.

    A request that names its proxy (``has_proxy``; null for none) keeps it; others get that of their scheme, or of 'all', unless their host
    is in a ``bypass`` domain ('*': every host).
    """
    s = urls.scheme(F.col("url"))
    of_scheme = F.lit(None).cast("string")
    for k, v in sorted(proxies.items(), key=lambda kv: kv[0] != "all"):  # the one of the scheme goes before that for all
        of_scheme = F.when(s.isin("http", "https") if k == "all" else s == k, F.lit(v)).otherwise(of_scheme)
    if bypass:
        around = F.lit("*" in bypass) | urls.matches_domain(urls.hostname(F.col("url")), [b.lstrip(".") for b in bypass if b != "*"])
        of_scheme = F.when(~around, of_scheme)
    own = F.coalesce("has_proxy", F.lit(False))
    got = F.when(own, proxy_parts(F.col("proxy"), F.lit("http"))).otherwise(proxy_parts(of_scheme, s))
    return requests.withColumn("_p", got).withColumns({"proxy": F.col("_p.url"), "proxy_auth": F.col("_p.auth")}).drop("_p")


def copied_keys(meta: Column, internal: list[str]) -> Column:
    """Internal keys a child request carries on from its parent."""
    return F.array_sort(F.array_intersect(F.map_keys(meta), F.array(*[F.lit(k) for k in internal])))


# --- cache -----------------------------------------------------------------------------------------------


def http_date(value: Column) -> Column:
    """Epoch seconds of an HTTP date: RFC 1123 with a named or numeric zone, RFC 850, or asctime; null otherwise."""
    v = F.regexp_replace(F.trim(value), r"\s+", " ")
    rest = F.regexp_replace(v, r"^[A-Za-z]+, ?", "")
    zone = F.regexp_replace(F.regexp_replace(rest, r" (GMT|UTC|UT|Z)$", " +0000"), r" -0000$", " +0000")
    # 2-digit days only: a one-digit day is padded
    padded = F.regexp_replace(zone, r"^(\d) ", "0$1 ")
    asc = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3} ", ""), r"^([A-Za-z]{3}) (\d) ", "$1 0$2 ")
    parsed = F.coalesce(
        F.expr("null").cast("timestamp"),
        F.try_to_timestamp(padded, F.lit("dd MMM yyyy HH:mm:ss Z")),
        # two-digit years: 69 to 99 are of the last century
        F.try_to_timestamp(F.regexp_replace(F.regexp_replace(padded, r"^(\d\d)-([A-Za-z]{3})-([7-9]\d|69) ", "$1 $2 19$3 "), r"^(\d\d)-([A-Za-z]{3})-(\d\d) ", "$1 $2 20$3 "), F.lit("dd MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.concat(asc, F.lit(" +0000")), F.lit("MMM dd HH:mm:ss yyyy Z")),
    )
    return F.when(value.isNotNull(), parsed.cast("double"))


def cache_control(value: Column) -> Column:
    """Map of the directives of a Cache-Control header, names in lower case, values without quotes."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.split(x, "=")[0])).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^[^=]*=([\s\S]*)$", 1), '"', "")).alias("v")))
    # the first of repeated directives counts
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def _seconds(cc: Column, name: str) -> Column:
    v = F.element_at(cc, name)
    return F.when(v.rlike(r"^\d{1,15}$"), v.cast("double"))


def dummy_cacheable(url: Column, status: Column, ignore_schemes: tuple = ("file",), ignore_statuses: tuple = ()) -> Column:
    """Whether the plain cache policy stores a response: all but those of some schemes and statuses; what it stores stays fresh."""
    return ~F.coalesce(urls.scheme(url).isin(*ignore_schemes), F.lit(False)) & (~status.isin(*ignore_statuses) if ignore_statuses else F.lit(True))


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    """Map of the headers that ask whether a cached response still holds."""
    empty = F.create_map().cast("map<string,string>")
    one = lambda name, v: F.when(v.isNotNull(), F.create_map(F.lit(name), v)).otherwise(empty)
    return F.map_concat(one("if-none-match", etag), one("if-modified-since", last_modified))


def cache_route(fresh: Column, cached: Column, answer_status: Column, answer_error: Column, valid: Column, storable: Column) -> Column:
    """What becomes of a request: hit, revalidate (answer valid), invalidate, errorrecovery, firsthand or uncacheable; null for a failed request without a cached answer."""
    return (
        F.when(cached & fresh, "hit")
        .when(cached & answer_error.isNotNull(), "errorrecovery")
        .when(cached & valid, "revalidate")
        .when(cached, "invalidate")
        .when(answer_status.isNull(), None)
        .when(storable, "firsthand")
        .otherwise("uncacheable")
    )


def freshness(df: DataFrame, now: float, always_store: bool = False, ignore_directives: tuple[str, ...] = ()) -> DataFrame:
    """Age and lifetime of cached responses with columns status, date, expires, last_modified, age, cache_control, request_cache_control, etag.

    Adds ``lifetime``, ``current_age``, ``fresh`` and ``storable``. ``ignore_directives`` of responses count for nothing; ``always_store``
    stores all that is not forbidden.
    """
    cc, rc = cache_control(F.col("cache_control")), cache_control(F.col("request_cache_control"))
    if ignore_directives:
        cc = F.map_filter(cc, lambda k, _: ~k.isin(*[x.lower() for x in ignore_directives]))
    date = F.coalesce(http_date(F.col("date")), F.lit(float(now)))
    expires, modified = http_date(F.col("expires")), http_date(F.col("last_modified"))
    lifetime = F.coalesce(
        _seconds(cc, "max-age"),
        F.when(F.col("expires").isNotNull(), F.greatest(F.coalesce(expires - date, F.lit(0.0)), F.lit(0.0))),
        F.when(modified.isNotNull() & (modified <= date), (date - modified) / 10),
        F.when(F.col("status").isin(300, 301, 308), F.lit(365.0 * 86400)),
        F.lit(0.0),
    )
    asked = _seconds(rc, "max-age")
    lifetime = F.when(asked.isNotNull(), F.least(lifetime, asked)).otherwise(lifetime)
    age = F.greatest(F.lit(float(now)) - date, F.coalesce(F.when(F.col("age").rlike(r"^\d+$"), F.col("age").cast("double")), F.lit(0.0)), F.lit(0.0))
    no_cache = F.map_contains_key(cc, "no-cache") | F.map_contains_key(rc, "no-cache")
    stale_ok = F.when(F.map_contains_key(rc, "max-stale"), F.coalesce(_seconds(rc, "max-stale"), F.lit(1e300)))
    within = (F.col("current_age") < F.col("lifetime")) | (
        stale_ok.isNotNull() & ~F.map_contains_key(cc, "must-revalidate") & (F.col("current_age") < F.col("lifetime") + stale_ok)
    )
    storable = (
        ~F.map_contains_key(cc, "no-store") & ~F.map_contains_key(rc, "no-store") & (F.col("status") != 304)
        & (F.lit(always_store) | F.map_contains_key(cc, "max-age") | F.col("expires").isNotNull() | F.col("status").isin(300, 301, 308) | (F.col("status").isin(200, 203, 401) & (F.col("last_modified").isNotNull() | F.col("etag").isNotNull())))
    )
    out = df.withColumn("lifetime", lifetime).withColumn("current_age", age)
    return out.withColumn("fresh", F.coalesce(~no_cache & within, F.lit(False))).withColumn("storable", F.coalesce(storable, F.lit(False)))


def revalidated(cached_cc: Column, status: Column) -> Column:
    """Whether the answer to a conditional request keeps the cached response valid."""
    return (status == 304) | ((status >= 500) & ~F.map_contains_key(cache_control(cached_cc), "must-revalidate"))


def latest_valid(cache: DataFrame, now: float, expire: float = 0.0) -> DataFrame:
    """The cached version in force at ``now`` of each fingerprint: the latest stored by then and not expired.

    Null ``stored_at`` was never valid. Ties go to the larger ``response_id``.
    """
    ok = cache.filter((F.col("stored_at") <= now) & (F.lit(expire <= 0) | (F.col("stored_at") + expire >= now)))
    return ok.groupBy("fingerprint").agg(F.max(F.struct("stored_at", "response_id")).alias("_b")).select("fingerprint", F.col("_b.stored_at").alias("stored_at"), F.col("_b.response_id").alias("response_id"))
