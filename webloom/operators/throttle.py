"""Download slots: start times under a delay, and the delay AutoThrottle arrives at. Queues of hot slots are worked off in blocks of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def start_times(requests: DataFrame, delay: float, width: float = 86400.0, randomize: bool = False, slot: str = "slot", at: str = "ts", order: str = "seq") -> DataFrame:
    """``start`` of each request when every slot waits ``delay`` seconds between two starts, in the order of arrival.

    With d_i the delay before request i and D_i their running sum, start_i = D_i + max over j <= i of (arrival_j - D_j). The
    queue of a slot is cut into blocks of ``width`` seconds of arrival. Blocks are numbered by themselves; what a
    block needs of those before it is two numbers, the sum of their delays and their largest arrival_j - D_j, which fold over
    the blocks of a slot. ``randomize`` draws each delay from half to one and a half of ``delay`` by a hash of ``order``.
    """
    own = F.lit(delay)
    if randomize:
        own = own * (F.lit(0.5) + F.pmod(F.xxhash64(F.lit("delay"), order), F.lit(1 << 20)) / float(1 << 20))
    b = requests.withColumn("_b", F.floor(F.col(at) / width).cast("long")).withColumn("_d", own)
    w = W.partitionBy(slot, "_b").orderBy(at, order).rowsBetween(W.unboundedPreceding, 0)
    n = b.withColumn("_sum", F.sum("_d").over(w)).withColumn("_m", F.max(F.col(at) - F.col("_sum")).over(w))
    per = n.groupBy(slot, "_b").agg(F.max("_sum").alias("_all"), F.max("_m").alias("_top"))
    before = W.partitionBy(slot).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.withColumn("_off", F.coalesce(F.sum("_all").over(before), F.lit(0.0)))
    offsets = offsets.withColumn("_past", F.max(F.col("_top") - F.col("_off")).over(before)).select(slot, "_b", "_off", "_past")
    j = n.join(offsets, [slot, "_b"])
    mine = F.col("_m") - F.col("_off")
    return j.withColumn("start", F.col("_sum") + F.col("_off") + F.greatest(mine, F.coalesce("_past", mine))).drop("_b", "_d", "_sum", "_m", "_off", "_past")


def auto_throttle(events: DataFrame, start: float = 5.0, least: float = 0.0, most: float = 60.0, concurrency: float = 1.0, slot: str = "slot", width: float = 86400.0) -> DataFrame:
    """Per slot: the final delay and how often it rose, fell, stayed or was ignored.

    ``events``: slot, ts (seconds), seq, latency seconds, status, adjust boolean (false: leave the delay alone). Each
    step moves the delay half way to latency / concurrency, not under it, within the bounds; responses
    other than 200 cannot lower it. As a function of the delay before it, a step - and so any run of steps - has the form
    min(top, max(floor, a * delay + c)), so blocks of ``width`` seconds are folded each by itself into these four
    numbers, the blocks of a slot give the delay each of them starts with, and a second fold within the blocks counts. No
    task holds more than a block of a slot's history.
    """
    block = events.filter(F.col(slot).isNotNull()).select(slot, F.floor(F.col("ts") / width).cast("long").alias("_b"), F.struct("ts", "seq", "latency", "status", "adjust").alias("_e"))
    block = block.groupBy(slot, "_b").agg(F.array_sort(F.collect_list("_e")).alias("_e"))

    def target(x):
        return x["latency"] / F.lit(concurrency)

    def idle(x):
        return ~F.coalesce(x["adjust"], F.lit(True)) | x["latency"].isNull()

    def clip(v):
        return F.least(F.greatest(v, F.lit(float(least))), F.lit(float(most)))

    def new_delay(delay, x):
        return clip(F.greatest(target(x), (delay + target(x)) / 2))

    def compose(s, x):
        low = clip(target(x))
        held = x["status"] != 200  # may only rise: max(delay, clipped target)
        move = lambda v: F.when(held, F.greatest(v, low)).otherwise(new_delay(v, x))
        # the sloped part: halved towards the target, kept where the delay is held
        a = F.when(held, s["a"]).otherwise(s["a"] / 2)
        c = F.when(held, s["c"]).otherwise((s["c"] + target(x)) / 2)
        return F.struct(
            F.when(idle(x), s["top"]).otherwise(move(s["top"])).alias("top"), F.when(idle(x), s["floor"]).otherwise(F.greatest(move(s["floor"]), low)).alias("floor"),
            F.when(idle(x), s["a"]).otherwise(a).alias("a"), F.when(idle(x), s["c"]).otherwise(c).alias("c"),
        )

    same = F.struct(F.lit(float("inf")).alias("top"), F.lit(float("-inf")).alias("floor"), F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
    fs = block.select(slot, "_b", F.aggregate("_e", same, compose).alias("f")).groupBy(slot).agg(F.array_sort(F.collect_list(F.struct("_b", "f"))).alias("fs"))
    none = F.array().cast("array<struct<_b:bigint,d:double>>")
    run = F.aggregate(
        "fs", F.struct(F.lit(float(start)).alias("d"), none.alias("at")),
        lambda s, x: F.struct(
            F.least(x["f"]["top"], F.greatest(x["f"]["floor"], x["f"]["a"] * s["d"] + x["f"]["c"])).alias("d"),
            F.concat(s["at"], F.array(F.struct(x["_b"].alias("_b"), s["d"].alias("d")))).alias("at"),
        ),
    )
    starts = fs.select(slot, F.inline(run["at"]))

    def step(s, x):
        new = new_delay(s["delay"], x)
        skip = F.coalesce(idle(x) | ((x["status"] != 200) & (new <= s["delay"])), F.lit(True))
        count = lambda name, when: (s[name] + F.when(when, 1).otherwise(0)).alias(name)
        return F.struct(
            F.when(skip, s["delay"]).otherwise(new).alias("delay"), count("increased", ~skip & (new > s["delay"])), count("decreased", ~skip & (new < s["delay"])),
            count("unchanged", ~skip & (new == s["delay"])), count("ignored", skip),
        )

    zero = F.lit(0)
    first = F.struct(F.col("d").alias("delay"), zero.alias("increased"), zero.alias("decreased"), zero.alias("unchanged"), zero.alias("ignored"))
    done = block.join(starts, [slot, "_b"]).select(slot, "_b", F.aggregate("_e", first, step).alias("s"))
    return done.groupBy(slot).agg(F.max_by("s.delay", "_b").alias("delay"), *[F.sum(f"s.{c}").alias(c) for c in ("increased", "decreased", "unchanged", "ignored")])
