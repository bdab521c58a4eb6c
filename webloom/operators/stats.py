"""Crawl statistics as aggregates over logs of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folded(log: DataFrame) -> DataFrame:
    """``key, value`` after a log of operations (seq, key, op, value): inc adds, max and min keep extremes, set overwrites.

    A key is used with one operation only, as counters are; mixed keys raise.
    """
    a = log.groupBy("key").agg(
        F.count_distinct("op").alias("_ops"), F.first("op").alias("_op"), F.sum("value").alias("_sum"), F.max("value").alias("_max"), F.min("value").alias("_min"), F.max_by("value", "seq").alias("_last")
    )
    v = F.when(F.col("_ops") > 1, F.raise_error(F.concat(F.lit("mixed operations on "), F.col("key"))).cast("double")).when(F.col("_op") == "inc", F.col("_sum")).when(F.col("_op") == "max", F.col("_max")).when(F.col("_op") == "min", F.col("_min")).otherwise(F.col("_last"))
    return a.select("key", v.alias("value"))


def _counters(df: DataFrame, count: str, size: str | None, by: dict[str, str], amount: str = "bytes") -> DataFrame:
    """``key, value``: rows under ``count``, the sum of ``amount`` under ``size``, and rows by each column under its prefix. One pass by grouping sets."""
    cols = list(by)
    sums = [F.sum(amount).alias("b")] if size else []
    g = df.groupingSets([[], *[[F.col(c)] for c in cols]], *[F.col(c) for c in cols]).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *sums)
    none = (1 << len(cols)) - 1
    out = g.filter(F.col("g") == none).select(F.lit(count).alias("key"), F.col("n").cast("long").alias("value"))
    if size:
        out = out.unionByName(g.filter(F.col("g") == none).select(F.lit(size).alias("key"), F.coalesce("b", F.lit(0)).cast("long").alias("value")))
    for k, c in enumerate(cols):
        mine = g.filter((F.col("g") == none - (1 << (len(cols) - 1 - k))) & F.col(c).isNotNull())
        out = out.unionByName(mine.select(F.concat(F.lit(by[c] + "/"), F.col(c).cast("string")).alias("key"), F.col("n").cast("long").alias("value")))
    return out


def downloader(responses: DataFrame, requests: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """``key, value`` counters of the downloader: responses (status, bytes), requests (method, bytes) and exceptions (type)."""
    out = _counters(responses, "downloader/response_count", "downloader/response_bytes", {"status": "downloader/response_status_count"})
    if requests is not None:
        out = out.unionByName(_counters(requests, "downloader/request_count", "downloader/request_bytes", {"method": "downloader/request_method_count"}))
    if exceptions is not None:
        e = _counters(exceptions, "downloader/exception_count", None, {"type": "downloader/exception_type_count"})
        out = out.unionByName(e.filter("value > 0"))
    return out


def policies(log: DataFrame) -> DataFrame:
    """``key, value`` counters of what policies decided: log rows with policy, outcome, reason and domain.

    offsite: rows filtered and the different domains; urllength and depth: rows filtered; httperror: responses ignored, by status;
    redirect: followed ones, by reason, and those over the limit; retry: the same; robotstxt: requests forbidden, files asked for and
    answers by status. Policies and outcomes without rows have no counter.
    """
    keys = {
        ("offsite", "filtered"): ("offsite/filtered", None), ("urllength", "filtered"): ("urllength/request_ignored_count", None), ("depth", "filtered"): ("depth/request_ignored_count", None),
        ("httperror", "ignored"): ("httperror/response_ignored_count", "httperror/response_ignored_status_count/"),
        ("redirect", "follow"): ("redirect/count", "redirect/reason_count/"), ("redirect", "too_many"): ("redirect/max_reached", None),
        ("retry", "retry"): ("retry/count", "retry/reason_count/"), ("retry", "give_up"): ("retry/max_reached", None),
        ("robotstxt", "forbidden"): ("robotstxt/forbidden", None), ("robotstxt", "request"): ("robotstxt/request_count", None),
        ("robotstxt", "response"): ("robotstxt/response_count", "robotstxt/response_status_count/"),
        ("dupefilter", "filtered"): ("dupefilter/filtered", None), ("item", "scraped"): ("item_scraped_count", None), ("item", "dropped"): ("item_dropped_count", "item_dropped_reasons_count/"),
    }
    n = log.groupBy("policy", "outcome", "reason").agg(F.count("*").alias("n"))
    total, prefix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (policy, outcome), (key, by) in keys.items():
        here = (F.col("policy") == policy) & (F.col("outcome") == outcome)
        total = F.when(here, key).otherwise(total)
        if by:
            prefix = F.when(here & F.col("reason").isNotNull(), F.concat(F.lit(by), "reason")).otherwise(prefix)
    each = n.select(F.explode(F.array_compact(F.array(total, prefix))).alias("key"), "n")
    domains = log.filter("policy = 'offsite' and outcome = 'filtered' and domain is not null").agg(F.count_distinct("domain").alias("n")).filter("n > 0").select(F.lit("offsite/domains").alias("key"), "n")
    return each.unionByName(domains).groupBy("key").agg(F.sum("n").cast("long").alias("value"))


def log_counts(log: DataFrame) -> DataFrame:
    """``key, value``: records by level of a log (level)."""
    return log.filter("level is not null").groupBy(F.concat(F.lit("log_count/"), F.upper("level")).alias("key")).agg(F.count("*").alias("value"))


def core(run: DataFrame) -> DataFrame:
    """``key, value`` (text) of a run of one row: start_time, finish_time, reason, items, pages; with the elapsed seconds and rates a minute."""
    seconds = F.col("finish_time").cast("timestamp").cast("double") - F.col("start_time").cast("timestamp").cast("double")
    rate = lambda c: F.when(seconds > 0, F.round(60.0 * F.col(c) / seconds, 6))
    pairs = {
        "start_time": F.col("start_time"), "finish_time": F.col("finish_time"), "finish_reason": F.col("reason"), "elapsed_time_seconds": seconds,
        "items_per_minute": rate("items"), "responses_per_minute": rate("pages"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return run.select(F.inline(rows)).filter("value is not null")


def signals(log: DataFrame) -> DataFrame:
    """``signal, sender, sent, first, last`` of a log of signals (signal, sender, ts): what an observer of them would have counted."""
    return log.groupBy("signal", "sender").agg(F.count("*").alias("sent"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, object]:
    """``df`` and an observation that holds the metrics (Columns of aggregates) once an action on ``df`` has run: no pass of its own."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in metrics.items()]), o


def depths(requests: DataFrame) -> DataFrame:
    """request_depth_max and request_depth_count/<d> of requests (depth)."""
    n = requests.filter("depth is not null").groupBy("depth").agg(F.count("*").alias("n"))
    top = n.agg(F.max("depth").cast("long").alias("value")).filter("value is not null").select(F.lit("request_depth_max").alias("key"), "value")
    return top.unionByName(n.select(F.concat(F.lit("request_depth_count/"), F.col("depth").cast("string")).alias("key"), F.col("n").cast("long").alias("value")))


def prefix_rollup(stats: DataFrame) -> DataFrame:
    """Sums of the counters by every prefix of their key's path."""
    parts = F.split("key", "/")
    each = stats.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("prefix"), "value")
    return each.groupBy("prefix").agg(F.sum("value").alias("value"))


def deltas(ticks: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """``tick, key, value, delta``: change of every key since its tick before (the value itself at the first).

    Only keys that hold one of ``include`` (if given) and none of ``exclude`` count.
    """
    for words, keep in ((include, True), (exclude, False)):
        if words:
            hit = F.exists(F.array(*map(F.lit, words)), lambda x: F.col("key").contains(x))
            ticks = ticks.filter(hit if keep else ~hit)
    w = W.partitionBy("key").orderBy("tick")
    return ticks.withColumn("delta", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0)))


def rates(log: DataFrame, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """Pages and items per tumbling window of a log with ``kind`` ('page' or 'item')."""
    g = log.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count_if(F.col("kind") == "page").alias("pages"), F.count_if(F.col("kind") == "item").alias("items"))
    return g.select(F.col("w.start").alias("start"), "pages", "items")


def no_item_streaks(log: DataFrame, key: str = "spider") -> DataFrame:
    """Longest run of pages without an item of each spider, in order of seq: gaps and islands over running item counts."""
    w = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    island = log.withColumn("_i", F.sum((F.col("kind") == "item").cast("int")).over(w))
    n = island.groupBy(key, "_i").agg(F.count_if(F.col("kind") == "page").alias("n"))
    return n.groupBy(key).agg(F.max("n").alias("longest"))


def close_reason(counts: DataFrame, items: int = 0, pages: int = 0, errors: int = 0, timeout: float = 0, timeout_no_item: float = 0, pages_no_item: int = 0) -> DataFrame:
    """The first close condition that the totals of ``counts`` meet; null for none.

    ``counts``: items, pages, errors, and for the conditions on time elapsed, since_item (seconds) and pages_since_item.
    """
    r = F.lit(None).cast("string")
    conditions = (
        ("pages_since_item", pages_no_item, "pagecount_no_item"), ("errors", errors, "errorcount"), ("pages", pages, "pagecount"), ("items", items, "itemcount"),
        ("since_item", timeout_no_item, "timeout_no_item"), ("elapsed", timeout, "timeout"),
    )
    for name, limit, word in conditions:
        if limit:
            r = F.when(F.col(name) >= limit, f"closespider_{word}").otherwise(r)
    return counts.withColumn("reason", r)
