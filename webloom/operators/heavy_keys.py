"""Per-key ordered results when a few keys hold most rows.

Rows are range partitioned on (key, order) with Spark's sampled quantiles. The order column is part
of the range key, so a key with a third of all rows is cut into as many ranges as its size asks for
and every task gets about the same number of rows. Each task folds its sorted rows into one partial
state per key it holds; a key that crosses a range border leaves one partial per range. Only those
partials are shuffled by key, where they are stitched in range order: sums add up, runs of equal
status that cross a border are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: host of an address: lower case, without user and port
_AUTHORITY = r"^\s*[a-z][a-z0-9+.\-]*:[/\\]{2}([^/?#\\]*)"

PARTIAL = (
    "k string, at long, n long, size long, st array<int>, cn array<long>, "
    "first_s int, last_s int, changes long, head_run long, tail_run long, best_run long"
)


def host_of(url: Column) -> Column:
    """Lower-case host of ``url`` without user and port; null for null, '' where there is no authority."""
    u = F.lower(F.translate(url, "\t\r\n", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(u, _AUTHORITY, 1), r"^.*@", ""), r"(:\d*|\s)+$", "")


def _partials(key: np.ndarray, at: np.ndarray, size: np.ndarray, status: np.ndarray) -> list[dict]:
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.concatenate((cut[1:], [len(key)]))
    out = []
    for a, b in zip(cut.tolist(), ends.tolist()):
        s = status[a:b]
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        runs = np.diff(np.concatenate((starts, [b - a])))
        vals, counts = np.unique(s, return_counts=True)
        out.append(
            {
                "k": key[a], "at": int(at[a]), "n": b - a, "size": int(size[a:b].sum()),
                "st": dict(zip(vals.tolist(), counts.tolist())), "first_s": int(s[0]), "last_s": int(s[-1]),
                "changes": len(starts) - 1, "head_run": int(runs[0]), "tail_run": int(runs[-1]), "best_run": int(runs.max()),
            }
        )
    return out


def _join_partials(a: dict, b: dict) -> dict:
    same = a["last_s"] == b["first_s"]
    st = dict(a["st"])
    for s, c in b["st"].items():
        st[s] = st.get(s, 0) + c
    return {
        "k": a["k"], "at": a["at"], "n": a["n"] + b["n"], "size": a["size"] + b["size"], "st": st,
        "first_s": a["first_s"], "last_s": b["last_s"], "changes": a["changes"] + b["changes"] + (not same),
        "head_run": a["n"] + b["head_run"] if same and a["changes"] == 0 else a["head_run"],
        "tail_run": b["n"] + a["tail_run"] if same and b["changes"] == 0 else b["tail_run"],
        "best_run": max(a["best_run"], b["best_run"], a["tail_run"] + b["head_run"] if same else 0),
    }


def _fold(batches):
    held = None
    names = ["k", "at", "n", "size", "st", "cn", "first_s", "last_s", "changes", "head_run", "tail_run", "best_run"]
    types = [pa.string(), *[pa.int64()] * 3, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int32(), *[pa.int64()] * 4]

    def rows(parts):
        parts = [p | {"st": [*p["st"]], "cn": [*p["st"].values()]} for p in parts]
        return pa.RecordBatch.from_arrays([pa.array([p[n] for p in parts], t) for n, t in zip(names, types)], names)

    for b in batches:
        if not b.num_rows:
            continue
        c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        parts = _partials(*c)
        if held is not None and held["k"] == parts[0]["k"]:
            parts[0] = _join_partials(held, parts[0])
        elif held is not None:
            parts.insert(0, held)
        held = parts.pop()
        if parts:
            yield rows(parts)
    if held is not None:
        yield rows([held])


def keyed_profile(df: DataFrame, key: Column, order: Column, size: Column, status: Column, partitions: int | None = None) -> DataFrame:
    """Per key: rows, total size, rows by status, changes of status in ``order`` and the longest run of one status.

    One row per non-null key. Null sizes count as 0, null statuses as status -1, null orders come first
    (as the smallest long); ties in the order are broken by status, so repeated rows give one defined
    result. An empty input gives an empty result. Further columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(
        key.cast("string").alias("k"),
        F.coalesce(order.cast("long"), F.lit(-(2**63))).alias("at"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        F.coalesce(status.cast("int"), F.lit(-1)).alias("status"),
    ).filter(F.col("k").isNotNull())
    parts = rows.repartitionByRange(n, "k", "at").sortWithinPartitions("k", "at", "status").mapInArrow(_fold, PARTIAL)
    # At most one partial per key and range: the lists are bounded by the number of partitions.
    got = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "n", "size", "first_s", "last_s", "changes", "head_run", "tail_run", "best_run", "st", "cn"))).alias("p"))
    stitched = F.expr(
        """aggregate(slice(p, 2, size(p)), element_at(p, 1), (a, b) -> named_struct(
            'at', a.at, 'n', a.n + b.n, 'size', a.size + b.size, 'first_s', a.first_s, 'last_s', b.last_s,
            'changes', a.changes + b.changes + if(a.last_s = b.first_s, 0L, 1L),
            'head_run', if(a.last_s = b.first_s and a.changes = 0, a.n + b.head_run, a.head_run),
            'tail_run', if(a.last_s = b.first_s and b.changes = 0, b.n + a.tail_run, b.tail_run),
            'best_run', greatest(a.best_run, b.best_run, if(a.last_s = b.first_s, a.tail_run + b.head_run, 0L)),
            'st', concat(a.st, b.st), 'cn', concat(a.cn, b.cn)))"""
    )
    by_status = F.expr(
        """transform(array_sort(array_distinct(s.st)), v -> named_struct('status', v, 'responses',
            aggregate(zip_with(s.st, s.cn, (x, c) -> if(x = v, c, 0L)), 0L, (x, y) -> x + y)))"""
    )
    return got.select("k", stitched.alias("s")).select(
        "k", F.col("s.n").alias("n"), F.col("s.size").alias("size"), by_status.alias("statuses"),
        F.col("s.changes").alias("changes"), F.col("s.best_run").alias("longest_run"),
    )


def host_profile(responses: DataFrame, with_bytes: bool = True) -> DataFrame:
    """Responses, bytes, statuses, status changes and longest status run (in ``response_id`` order) of each host.

    Rows with a null url have no host and are left out; an address without authority counts under ''.
    """
    size = F.octet_length("body") if with_bytes else F.lit(0)
    p = keyed_profile(responses, host_of(F.col("url")), F.col("response_id"), size, F.col("status"))
    return p.select(
        F.col("k").alias("host"), F.col("n").alias("responses"), F.col("size").alias("bytes"), "statuses",
        F.col("changes").alias("status_changes"), "longest_run",
    )


def heavy_hosts(responses: DataFrame, share: float = 0.04) -> DataFrame:
    """Hosts with at least ``share`` of all responses whose url is not null (column ``host``)."""
    p = host_profile(responses, with_bytes=False).select("host", "responses")
    # '' holds the rows with an address without host: they count in the total, but are no host
    total = p.agg(F.sum("responses").alias("total")).scalar()
    return p.filter((F.col("host") != "") & (F.col("responses") >= total * F.lit(share))).select("host")
