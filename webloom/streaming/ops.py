"""Unbounded crawls: the same operators over streams, with the state each needs and a bound for it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicate(stream: DataFrame, key: str = "fp", watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row of each key. Without a watermark the seen set grows without bound, as the crawl's own does;
    with one (column, delay) a key is forgotten after the delay and may pass again."""
    s = stream.filter(F.col(key).isNotNull())
    return s.dropDuplicates([key]) if watermark is None else s.withWatermark(*watermark).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str = "ts", seconds: int = 60, late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Counts per window (and key); late rows count until the watermark has passed."""
    keys = [F.window(ts, f"{seconds} seconds").alias("w"), *([F.col(by)] if by else [])]
    g = stream.withWatermark(ts, late).groupBy(*keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *([by] if by else []), "n")


def sliding(stream: DataFrame, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, ts: str = "ts", key: str = "slot", gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of activity of a key with pauses under ``gap``: what closes a spider for inactivity."""
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def throttle(stream: DataFrame, start: float = 5.0, least: float = 0.0, most: float = 60.0, concurrency: float = 1.0, idle: str | None = None) -> DataFrame:
    """AutoThrottle over a stream of (slot, ts, seq, latency, status, adjust): a row per slot and batch with its delay and counters.

    The state of a slot is five numbers; with ``idle`` slots without events for that time are dropped (such a
    query runs until it is stopped, as timeouts keep it busy). Rows of a slot within a batch
    are folded in order of ts, seq.
    """

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        delay, up, down, same, ignored = state.get if state.exists else (start, 0, 0, 0, 0)
        pdf = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for latency, status, adjust in zip(pdf["latency"], pdf["status"], pdf["adjust"]):
            new = None
            if adjust is not False and latency is not None and latency == latency:
                target = latency / concurrency
                new = min(max(target, (delay + target) / 2, least), most)
                if status != 200 and new <= delay:
                    new = None
            if new is None:
                ignored += 1
            else:
                up, down, same = up + (new > delay), down + (new < delay), same + (new == delay)
                delay = new
        state.update((float(delay), int(up), int(down), int(same), int(ignored)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], delay, up, down, same, ignored)], columns=["slot", "delay", "increased", "decreased", "unchanged", "ignored"])

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    kind = stream.schema["slot"].dataType.simpleString()
    return stream.filter("slot is not null").groupBy("slot").applyInPandasWithState(
        fold, f"slot {kind}, delay double, increased long, decreased long, unchanged long, ignored long", "delay double, increased long, decreased long, unchanged long, ignored long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, writes its rows to Parquet files under ``path`` and reads them back.

    With ``mode`` complete every micro-batch replaces what is there.
    """
    kind = stream.schema
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode(mode).format("parquet").start(path)
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(kind).parquet(path)
