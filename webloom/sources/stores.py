"""Stores of a crawl as Parquet tables: the HTTP cache and the request queue of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = "url string, method string, body string, meta struct<depth:int>, callback string"


def requests(queue: DataFrame) -> DataFrame:
    """Persisted queue (request_id, sequence, priority text, is_start, payload JSON) as request rows in its own types.

    A priority is any integer text, with sign and blanks around it; beyond 38 digits, or no integer, it is
    null. A payload that is no JSON gives null fields.
    """
    p = F.col("_p")
    number = F.regexp_extract(F.coalesce("priority", F.lit("")), r"^\s*([+-]?\d+)\s*$", 1)
    return queue.withColumn("_p", F.from_json(F.col("payload").cast("string"), REQUEST)).select(
        "request_id", F.col("sequence").alias("seq"), F.when(number != "", number.try_cast("decimal(38,0)")).alias("priority"),
        (F.coalesce("is_start", F.lit(0)) != 0).alias("is_start"), p["url"].alias("url"), F.upper(p["method"]).alias("method"), p["body"].alias("body"), F.coalesce(p["meta"]["depth"], F.lit(0)).alias("depth"), p["callback"].alias("callback"),
    )


def header_map(headers: DataFrame) -> DataFrame:
    """``fingerprint, headers map<string, array<binary>>``: names in lower case, values in order of position; rows repeated as a whole count once."""
    one = headers.select("fingerprint", F.lower("name").alias("name"), "position", "value").filter("fingerprint is not null and name is not null").distinct()
    values = one.groupBy("fingerprint", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("values"))
    return values.groupBy("fingerprint").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("headers"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cache after storing ``new``: of each fingerprint the row stored last (ties: the larger response_id)."""
    both = old.unionByName(new)
    best = both.groupBy("fingerprint").agg(F.max_by(F.struct(*both.columns), F.struct(F.coalesce("stored_at", F.lit(float("-inf"))), "response_id")).alias("r"))
    return best.select("r.*")


def upsert_headers(old: DataFrame, new: DataFrame, stored: DataFrame) -> DataFrame:
    """Header rows after storing ``new``: those of the fingerprints in ``stored`` (fingerprint) are replaced as a whole, never mixed with old ones."""
    keys = stored.select("fingerprint").distinct()
    return old.join(keys, "fingerprint", "left_anti").unionByName(new.join(keys, "fingerprint", "left_semi"))


def probe(requests: DataFrame, cache: DataFrame, now: float, expire: float = 0.0) -> DataFrame:
    """``requests`` (fp, ...) with the cached response in force at ``now`` (null columns: a miss)."""
    from webloom.operators.policies import latest_valid

    return requests.join(latest_valid(cache, now, expire).withColumnRenamed("fingerprint", "fp"), "fp", "left")
