"""Request queue as relations: duplicate filter, seen set, scheduling order, persistence of a level.

Level-synchronous semantics: within a level all pushes come before all pops, ``seq`` is the order of
pushing. A hot fingerprint costs its partition one row per map task: first arrivals are found by an
aggregate with map-side combine, never by a window over the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.runtime import materialize


def keep_first(df: DataFrame, key: str, order: list[str], unique_order: bool = False) -> DataFrame:
    """First row of each key in the order of the columns; null keys are no keys and are left out.

    ``order`` must be total. With ``unique_order`` no two rows of the whole table share it: then only (key, order) is
    aggregated, by hash, and the rest of the row joins on the order. Otherwise the row travels through the aggregate as
    one struct. Either way a hot key is combined before the shuffle.
    """
    if unique_order and len(order) == 1:
        first = df.filter(F.col(key).isNotNull() & F.col(order[0]).isNotNull()).groupBy(key).agg(F.min(order[0]).alias(order[0]))
        return df.drop(key).join(first, order[0]).select(*df.columns)
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_r"))
    return best.select(*[F.col("_r")[c].alias(c) for c in df.columns])


def seen_flags(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with ``seen``: whether the key already occurred at a smaller ``order`` (null keys never)."""
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    flagged = first.select(F.col("_first").alias(order), F.lit(True).alias("_is_first"))
    # joined on the unique order, not on the key: a hot key can't skew it
    j = df.join(flagged, order, "left")
    return j.withColumn("seen", F.col(key).isNotNull() & F.col("_is_first").isNull()).drop("_is_first").select(*df.columns, "seen")


def filter_duplicates(requests: DataFrame, seen: DataFrame | None = None, key: str = "fp", order: str = "seq", bypass: Column | None = None, unique_order: bool = False) -> DataFrame:
    """Requests that pass the duplicate filter: the first of each fingerprint that is not in ``seen``.

    Rows for which ``bypass`` holds pass untested and are not remembered. ``unique_order``: see ``keep_first``.
    """
    tested = requests if bypass is None else requests.filter(~F.coalesce(bypass, F.lit(False)))
    first = keep_first(tested, key, [order], unique_order)
    if seen is not None:
        first = first.join(seen.select(key).distinct(), key, "left_anti")
    first = first.select(*requests.columns)
    return first if bypass is None else first.unionByName(requests.filter(F.coalesce(bypass, F.lit(False))))


def remember(seen: DataFrame, passed: DataFrame, key: str = "fp") -> DataFrame:
    """Seen set after a level."""
    return seen.select(key).union(passed.select(key)).filter(F.col(key).isNotNull()).distinct()


def order_keys(lifo: bool = False, start_fifo: bool = True, separate_start: bool = True, memory_first: bool = False) -> list[Column]:
    """Sort keys of the scheduler over priority, seq, is_start and (with ``memory_first``) persistent.

    Higher priority first. At equal priority the normal queue goes before the start queue, if that is
    separate; the normal queue is last in first out with ``lifo``, the start queue first in first out.
    Entries in memory go before entries on disk, whatever their priority.
    """
    start = F.coalesce(F.col("is_start").cast("boolean"), F.lit(False)) if separate_start else F.lit(False)
    normal_rank = -F.col("seq") if lifo else F.col("seq")
    start_rank = F.col("seq") if start_fifo else -F.col("seq")
    keys = [F.col("persistent").cast("int").asc()] if memory_first else []
    return [*keys, F.col("priority").desc(), start.cast("int").asc(), F.when(start, start_rank).otherwise(normal_rank).asc()]


def pop(queue: DataFrame, k: int | None = None, **how) -> DataFrame:
    """The queue in scheduling order, or its first ``k`` rows (a top-k, no full sort)."""
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    ordered = queue.orderBy(*order_keys(**how))
    return ordered if k is None else ordered.limit(k)


def ranked(queue: DataFrame, **how) -> DataFrame:
    """``queue`` with ``position``, its place in the scheduling order, without one task holding all rows.

    Rows are range partitioned on the sort keys; each partition numbers its own rows and adds the sizes of
    the partitions before it. Only those sizes meet in one task.
    """
    spark = queue.sparkSession
    keys = order_keys(**how)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = queue.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # written once: sampled ranges may fall elsewhere in a second run
    numbered = materialize(parts.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n")).collect()  # one row per partition
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r["_n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    return numbered.join(offsets, "_part").withColumn("position", (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_id", "_part", "_at", "_before")


def admit(queue: DataFrame, active: DataFrame | None = None, concurrency: int = 16, per_slot: int = 8, **how) -> DataFrame:
    """The requests of ``queue`` (slot, ...) to start now: first ``per_slot`` less the active ones of each slot, of these ``concurrency`` less all active ones, in scheduling order.

    ``active``: slot of each request under way. Ranks are cut per slot before the shuffle, so a hot slot costs a few rows per task.
    """
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("slot").orderBy(*order_keys(**how)))
    if active is None:
        return pop(queue.withColumn("_r", rank).filter(F.col("_r") <= per_slot).drop("_r"), concurrency, **how)
    busy = active.groupBy("slot").agg(F.count("*").alias("_busy"))
    free = queue.withColumn("_r", rank).filter(F.col("_r") <= per_slot).join(busy, "slot", "left").filter(F.col("_r") <= per_slot - F.coalesce("_busy", F.lit(0)))
    return pop(free.drop("_r", "_busy"), max(0, concurrency - active.count()), **how)
