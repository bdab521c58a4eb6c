"""Cookie jars: Set-Cookie headers folded in order per jar, Cookie headers by domain and path."""

from __future__ import annotations

import re
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls

#: Suffixes under which anyone may register (a small part of the public list).
PUBLIC_SUFFIXES = frozenset(
    "com org net edu gov mil int info biz io dev app test example invalid de fr es pt ru jp uk co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp or.jp ne.jp com.br co.in github.io".split()
)
COOKIE = "name string, value string, domain string, path string, secure boolean, host_only boolean, expires double"


def parse_set_cookie(header: str, host: str, path: str, now: float) -> dict | None:
    """A cookie of a Set-Cookie value as received from host and path; None where it must be refused."""
    first, *rest = header.split(";")
    name, sep, value = first.partition("=")
    name = name.strip()
    if not sep or not name:
        return None
    host = host.lower().rstrip(".")
    c = {"name": name, "value": value.strip().strip('"'), "domain": host, "path": path[: path.rfind("/")] or "/", "secure": False, "host_only": True, "expires": None}
    max_age = None
    for attr in rest:
        k, _, v = attr.partition("=")
        k, v = k.strip().lower(), v.strip()
        if k == "domain" and v:
            d = v.lstrip(".").lower().rstrip(".")
            if d == host:
                c["host_only"] = d in PUBLIC_SUFFIXES
            elif d in PUBLIC_SUFFIXES or not host.endswith("." + d) or re.fullmatch(r"[\d.]+|.*:.*", host):
                return None
            else:
                c["domain"], c["host_only"] = d, False
        elif k == "path" and v.startswith("/"):
            c["path"] = v
        elif k == "secure":
            c["secure"] = True
        elif k == "max-age" and re.fullmatch(r"-?\d+", v):
            max_age = int(v)
        elif k == "expires" and c["expires"] is None:
            try:
                c["expires"] = parsedate_to_datetime(v.replace("-", " ")).timestamp()
            except (TypeError, ValueError):
                pass
    if max_age is not None:
        c["expires"] = now + max_age if max_age > 0 else 0.0
    return c


def jars(events: DataFrame, jar: str = "jar") -> DataFrame:
    """Cookies left in each jar after its Set-Cookie events (jar, ts double, seq, url, set_cookie) in order of ts, seq.

    The last cookie of a (domain, path, name) stays; one that is expired when set removes it. Expressed as
    a maximum per cookie, so no jar is folded in one task: only parsing runs in Python, row by row.
    """
    kind = events.schema[jar].dataType.simpleString()

    def parse(batches):
        for pdf in batches:
            out = []
            for j, ts, seq, host, path, header in zip(*(pdf[c] for c in ("jar", "ts", "seq", "host", "path", "set_cookie"))):
                c = parse_set_cookie(header, host, path, ts)
                if c:
                    out.append({"jar": j, "ts": ts, "seq": seq, **c})
            yield pd.DataFrame(out, columns=["jar", "ts", "seq", "name", "value", "domain", "path", "secure", "host_only", "expires"])

    rows = events.filter(F.col("set_cookie").isNotNull() & F.col("url").isNotNull()).select(
        F.col(jar).alias("jar"), F.coalesce(F.col("ts").cast("double"), F.lit(0.0)).alias("ts"), F.col("seq").cast("long").alias("seq"), urls.hostname(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), "set_cookie"
    )
    parsed = rows.mapInPandas(parse, f"jar {kind}, ts double, seq long, {COOKIE}")
    last = parsed.groupBy("jar", "domain", "path", "name").agg(F.max_by(F.struct("value", "secure", "host_only", "expires", "ts"), F.struct("ts", "seq")).alias("c"))
    kept = last.filter(F.col("c.expires").isNull() | (F.col("c.expires") > F.col("c.ts")))
    return kept.select("jar", "name", "c.value", "domain", "path", "c.secure", "c.host_only", "c.expires")


def cookie_matches(host: Column, path: Column, secure: Column, now: Column) -> Column:
    """Whether a cookie row (columns of ``jars``) is sent to host and path."""
    # a host of a bare name or address shares nothing; a cookie set without Domain still reaches subdomains here
    domain_ok = (host == F.col("domain")) | (host.endswith(F.concat(F.lit("."), F.col("domain"))) & ~host.rlike(r"^[\d.]+$"))
    path_ok = (path == F.col("cookie_path")) | (path.startswith(F.col("cookie_path")) & (F.col("cookie_path").endswith("/") | (F.substring(path, F.length("cookie_path") + 1, F.lit(1)) == "/")))
    return domain_ok & path_ok & (~F.col("secure") | secure) & (F.col("expires").isNull() | (F.col("expires") > now))


def cookie_headers(requests: DataFrame, cookies: DataFrame, jar: str = "jar") -> DataFrame:
    """``requests`` (id, jar, url, now double) with ``cookie``: its jar's matching cookies, longer paths first, then by name.

    The join is on (jar, domain suffix): every request asks for the suffixes of its host, so no request
    meets the cookies of other sites.
    """
    r = requests.select("id", F.col(jar).alias("jar"), urls.hostname(F.col("url")).alias("host"), F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url"))).alias("req_path"), (urls.scheme(F.col("url")) == "https").alias("tls"), F.col("now").cast("double").alias("now"))
    asked = r.withColumn("domain", F.explode(urls.host_suffixes(F.col("host"))))
    c = cookies.withColumnRenamed("path", "cookie_path")
    hit = asked.join(c, ["jar", "domain"]).filter(cookie_matches(F.col("host"), F.col("req_path"), F.col("tls"), F.col("now")))
    h = hit.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.length("cookie_path")).alias("o"), "name", "value"))).alias("cs"))
    header = F.array_join(F.transform("cs", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ")
    return requests.join(h.select("id", header.alias("cookie")), "id", "left")
