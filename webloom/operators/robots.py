"""robots.txt as relations: groups, longest-match rules, crawl delays, sitemaps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webloom.functions import urls


def product_token(agent: Column) -> Column:
    """Leading product token of a user agent, in lower case."""
    return F.lower(F.regexp_extract(agent, r"^[A-Za-z_-]*", 0))


def agent_token(agent: str) -> str:
    """``product_token`` of an agent given by name."""
    return re.match(r"[A-Za-z_-]*", agent)[0].lower()


def lines(robots: DataFrame) -> DataFrame:
    """``origin, line, name, value`` of every directive of ``robots`` (origin, body). A byte order mark and comments mean nothing."""
    text = F.regexp_replace(F.when(F.col("body").isNotNull(), F.decode(F.col("body").cast("binary"), "UTF-8")), "^\\ufeff", "")
    each = robots.filter("origin is not null and body is not null").select("origin", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    d = each.select("origin", "line", F.lower(F.trim(F.regexp_extract(clean, r"^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).alias("value"))
    return d.filter(F.col("name") != "")


def groups(robots: DataFrame) -> DataFrame:
    """Directives with ``grp`` (number of their group) and the agents of that group.

    A group begins where a user-agent line follows another directive. Windows run within one file, whose
    size is bounded by what crawlers read of a robots.txt (500 KiB), not by the number of hosts.
    """
    w = W.partitionBy("origin").orderBy("line")
    d = lines(robots).filter(F.col("name").isin("user-agent", "allow", "disallow", "crawl-delay"))
    is_agent = F.col("name") == "user-agent"
    starts = is_agent & F.coalesce(F.lag(is_agent).over(w) == F.lit(False), F.lit(True))
    g = d.withColumn("grp", F.sum(starts.cast("int")).over(w)).filter("grp > 0")
    agents = g.filter(is_agent).groupBy("origin", "grp").agg(F.collect_set(F.lower("value")).alias("agents"))
    return g.filter(~is_agent).join(agents, ["origin", "grp"])


def _agent_score(agents: Column, product: str) -> Column:
    """Length of the longest agent name the product starts with; 0 for *, null for none."""
    return F.aggregate(
        agents, F.lit(None).cast("int"), lambda best, a: F.greatest(best, F.when(a == "*", F.lit(0)).when((a != "") & F.lit(product).startswith(F.regexp_extract(a, r"^[a-z_-]*", 0)) & a.rlike("^[a-z_-]"), F.length(F.regexp_extract(a, r"^[a-z_-]*", 0))))
    )


def rules(robots: DataFrame, agent: str) -> DataFrame:
    """``origin, allow, pattern, regex`` of the group that fits the agent best."""
    g = groups(robots).withColumn("score", _agent_score(F.col("agents"), agent_token(agent))).filter("score is not null")
    best = g.groupBy("origin").agg(F.max("score").alias("score"))
    r = g.join(best, ["origin", "score"]).filter(F.col("name").isin("allow", "disallow") & (F.col("value") != ""))
    body = F.regexp_replace(F.col("value"), r"\$$", "")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(body, r"([\\.+?^${}()|\[\]])", r"\\$1"), r"\*", ".*"), F.when(F.col("value").endswith("$"), "$").otherwise(""))
    return r.select("origin", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"), regex.alias("regex"))


def check(requests: DataFrame, robots: DataFrame, agent: str, bypass: Column | None = None) -> DataFrame:
    """``requests`` (url, ...) with ``allowed``: the longest matching rule decides, allow wins ties.

    No file, no fitting group or no matching rule allow; so do addresses that are not http(s), and rows for which ``bypass``
    holds. The rules of an origin travel as one array (a file has at most 500 KiB), so a request joins one row whatever the
    number of rules; rules without wildcards are compared as prefixes, only the others as patterns.
    """
    r = rules(robots, agent)
    plain = ~F.col("pattern").rlike(r"\*|\$$")
    r = r.groupBy("origin").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", F.when(plain, F.col("pattern")).alias("prefix"), F.when(~plain, F.col("regex")).alias("regex"))).alias("_rules"))
    target = F.concat(F.when(urls.path(F.col("url")) == "", "/").otherwise(urls.path(F.col("url"))), F.regexp_extract(urls.clean(F.col("url")), r"(\?[^#]*)", 1))
    t = requests.withColumns({"_o": urls.origin(F.col("url")), "_t": target}).join(r.withColumnRenamed("origin", "_o"), "_o", "left")
    fits = lambda x: F.when(x["prefix"].isNotNull(), F.startswith(F.col("_t"), x["prefix"])).otherwise(F.rlike(F.col("_t"), x["regex"]))
    best = F.array_max(F.transform(F.filter("_rules", fits), lambda x: F.struct(x["n"].alias("n"), x["allow"].alias("allow"))))
    allowed = F.coalesce(best["allow"], F.lit(True))
    if bypass is not None:
        allowed = allowed | F.coalesce(bypass, F.lit(False))
    return t.withColumn("allowed", allowed).select(*requests.columns, "allowed")


def to_fetch(requests: DataFrame, known: DataFrame) -> DataFrame:
    """``origin, url`` of the robots files still to fetch: one per origin, however many requests wait for it. ``known``: origin."""
    return requests.select(urls.origin(F.col("url")).alias("origin")).filter(F.col("origin").rlike("^https?://.")).distinct().join(known.select("origin"), "origin", "left_anti").withColumn("url", F.concat("origin", F.lit("/robots.txt")))


def crawl_delays(robots: DataFrame, agent: str) -> DataFrame:
    """``origin, delay`` (seconds, not negative) of the group that fits the agent best."""
    g = groups(robots).withColumn("score", _agent_score(F.col("agents"), agent_token(agent))).filter("score is not null and name = 'crawl-delay'")
    v = F.when(F.col("value").rlike(r"^\d+(\.\d+)?$"), F.col("value").cast("double"))
    return g.withColumn("v", v).filter("v is not null").groupBy("origin").agg(F.max_by("v", F.struct("score", -F.col("line"))).alias("delay"))


def sitemaps(robots: DataFrame) -> DataFrame:
    """``origin, url`` of the sitemap lines, resolved against the origin."""
    return lines(robots).filter((F.col("name") == "sitemap") & (F.col("value") != "")).select("origin", urls.join(F.concat("origin", F.lit("/")), F.col("value")).alias("url")).distinct()
