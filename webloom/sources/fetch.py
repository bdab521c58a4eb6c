"""Fetching as joins: requests meet stored pages, files and data addresses by the scheme of their address."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.fingerprint import with_fingerprint
from webloom.sources import feeds

Handler = Callable[[DataFrame], DataFrame]
MAX_SIZE, WARN_SIZE = 1 << 30, 32 << 20


def from_pages(pages: DataFrame) -> Handler:
    """A handler for http and https over a page store (fingerprint, status, body, and if there latency, response_id): requests (fp or url, ...) join it on the fingerprint.

    Of several stored answers the one stored last (stored_at, response_id) counts; null times come first. A request without an answer
    has ``error`` 'not_found'. Nothing is read of the store but the answers' columns.
    """
    cols = [c for c in ("status", "body", "latency", "response_id") if c in pages.columns]
    order = F.struct(F.coalesce(F.col("stored_at"), F.lit(float("-inf"))) if "stored_at" in pages.columns else F.lit(0.0), F.col("response_id") if "response_id" in pages.columns else F.xxhash64("body"))
    # the key of the last answer is found without the bodies, which then join once
    if "response_id" in pages.columns:
        last = pages.filter("fingerprint is not null").groupBy("fingerprint").agg(F.max(order)["response_id"].alias("response_id"))
        store = pages.select("fingerprint", *cols).join(last.select("response_id"), "response_id", "left_semi")
    else:
        store = pages.filter("fingerprint is not null").groupBy("fingerprint").agg(F.max_by(F.struct(*cols), order).alias("_r")).select("fingerprint", "_r.*")

    def run(requests: DataFrame) -> DataFrame:
        r = requests if "fp" in requests.columns else with_fingerprint(requests)
        got = r.drop(*cols).join(store.withColumnRenamed("fingerprint", "fp"), "fp", "left")
        return got.withColumn("error", F.when(F.col("status").isNull(), "not_found"))

    return run


def from_files(root: str | None = None) -> Handler:
    """A handler for ``file`` addresses: the bytes of the files under ``root`` (or of those the requests name, at most 10,000 of them)."""

    def run(requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        path = F.try_url_decode(F.replace(urls.path(F.col("url")), F.lit("+"), F.lit("%2B")))
        r = requests.withColumn("_path", path)
        if root is None:
            named = [x["_path"] for x in r.select("_path").distinct().limit(10_001).collect()]
            if len(named) > 10_000:
                raise ValueError("more than 10,000 files: name the folder they stand in")
            jvm = spark.sparkContext._jvm
            fs = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            there = [p for p in named if p and fs(jvm.org.apache.hadoop.fs.Path("file://" + p)).exists(jvm.org.apache.hadoop.fs.Path("file://" + p))]
            if not there:
                return r.withColumns({"status": F.lit(None).cast("int"), "body": F.lit(None).cast("binary"), "error": F.lit("not_found")}).drop("_path")
            files = spark.read.format("binaryFile").load(["file://" + p for p in there])
        else:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        files = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("_path"), F.col("content").alias("body"), F.lit(200).alias("status"))
        return r.join(files, "_path", "left").withColumn("error", F.when(F.col("status").isNull(), "not_found")).drop("_path")

    return run


def from_data(requests: DataFrame) -> DataFrame:
    """The handler of ``data`` addresses."""
    d = feeds.data_url(F.col("url"))
    return requests.withColumns({"status": F.when(d.isNotNull(), 200), "body": d["body"], "error": F.when(d.isNull(), "bad_address")})


#: handlers by scheme; more may be registered
HANDLERS: dict[str, Handler] = {"data": from_data, "file": from_files()}


def register(scheme: str, handler: Handler) -> None:
    HANDLERS[scheme.lower()] = handler


def fetch(requests: DataFrame, handlers: dict[str, Handler | None] | None = None) -> DataFrame:
    """``requests`` with ``status, body, error`` by the handler of their scheme; 'not_supported' for schemes without one (or with None)."""
    by = {**HANDLERS, **(handlers or {})}
    by = {k: h for k, h in by.items() if h is not None}
    # handlers may serve several schemes: each runs once
    groups: dict[int, tuple[Handler, list[str]]] = {}
    for k, h in by.items():
        groups.setdefault(id(h), (h, []))[1].append(k)
    s = requests.withColumn("_scheme", urls.scheme(F.col("url")))
    keep = [*requests.columns, "status", "body", "error"]
    none = {"status": F.lit(None).cast("int"), "body": F.lit(None).cast("binary"), "error": F.lit("not_supported")}
    out = s.filter(~F.coalesce(F.col("_scheme").isin(*by), F.lit(False))).withColumns(none).select(*keep)
    for h, schemes in groups.values():
        out = out.unionByName(h(s.filter(F.col("_scheme").isin(*schemes)).drop("_scheme")).select(*keep))
    return out


def guarded(responses: DataFrame, max_size: int = MAX_SIZE, warn_size: int = WARN_SIZE, fail_on_loss: bool = True, declared: str | None = None) -> DataFrame:
    """Responses (body, error) with ``flags`` and ``error`` after the guards of a download.

    Bodies (or declared lengths) over ``max_size`` are an error 'too_large' and lose their body; those over ``warn_size`` have the flag
    'large'. A body shorter than ``declared`` (a column) was cut in transfer: an error 'dataloss', or with ``fail_on_loss`` off a flag. 0 switches a size off.
    """
    size = F.octet_length("body").cast("long")
    said = F.col(declared).cast("long") if declared else F.lit(None).cast("long")
    over = F.greatest(size, said) > max_size if max_size else F.lit(False)
    large = F.greatest(size, said) > warn_size if warn_size else F.lit(False)
    lost = F.coalesce(size < said, F.lit(False))
    error = F.coalesce("error", F.when(over, "too_large").when(lost & F.lit(fail_on_loss), "dataloss"))
    flags = F.array_compact(F.array(F.when(large, "large"), F.when(lost & ~F.lit(fail_on_loss) & ~F.coalesce(over, F.lit(False)), "dataloss")))
    return responses.withColumns({"flags": flags, "error": error}).withColumn("body", F.when(F.col("error").isNull() | ~F.col("error").isin("too_large", "dataloss"), F.col("body")))


def stopped_early(responses: DataFrame, most: int, when: Column | None = None) -> DataFrame:
    """Responses whose download ends after ``most`` bytes (where ``when`` holds): ``body`` up to there and ``download_stopped``."""
    stop = (F.octet_length("body") > most) & (F.coalesce(when, F.lit(False)) if when is not None else F.lit(True))
    stop = F.coalesce(stop, F.lit(False))
    return responses.withColumns({"body": F.when(stop, F.substring("body", 1, most)).otherwise(F.col("body")), "download_stopped": stop})


def sitemap_body(content_kind: Column, url: Column, body: Column, most: int = MAX_SIZE) -> Column:
    """The XML of a response that may be a sitemap: of XML answers the body, gzip unpacked (null beyond ``most`` bytes or if broken), else the body if the address says so; null for others."""

    @F.pandas_udf("binary")
    def unzipped(b: pd.Series) -> pd.Series:
        out = []
        for x in b:
            got, left, large = (b"", ["gzip"], False) if x is None else feeds._inflate(bytes(x), ["gzip"], most)
            out.append(None if left or large else got)
        return pd.Series(out, dtype=object)

    zipped = F.hex(F.substring(body, 1, 2)) == "1F8B"
    # the Python function sees packed bodies only
    return F.when(content_kind == "xml", body).when(zipped, unzipped(F.when(zipped & ~F.coalesce(content_kind == "xml", F.lit(False)), body))).when(F.regexp_replace(url, r"[?#][\s\S]*$", "").rlike(r"\.xml(\.gz)?$"), body)
