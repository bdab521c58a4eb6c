"""A bounded crawl as a fixed point: one level of requests after the other over a store of edges or pages.

Each level is a join, a policy and a duplicate filter; what it yields is written to the shared folder, so
the plan never grows and a lost executor costs one level. With ``resume`` a crawl goes on after the last
level that was committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.frontier import keep_first
from webloom.runtime import materialize


def expand(start: DataFrame, edges: DataFrame, limit: int = 0) -> DataFrame:
    """``node, depth`` of everything reachable from ``start`` (node) along ``edges`` (src, dst), at its least depth.

    ``limit`` bounds the depth (0: none). Null nodes are none.
    """
    e = edges.filter("src is not null and dst is not null").select("src", "dst")
    level = materialize(start.filter("node is not null").select("node").distinct().withColumn("depth", F.lit(0)), "level")
    seen = level
    d = 0
    while not limit or d < limit:
        d += 1
        nxt = level.join(e, level.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        level = materialize(nxt.withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


class Checkpoint:
    """Levels of a crawl under a folder: each is data plus a marker written last; levels without a marker are ignored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> int:
        """Number of levels that are whole."""
        n = 0
        while self.fs.exists(self._path(f"{self.path}/level={n}/_COMMITTED")):
            n += 1
        return n

    def write(self, level: int, frontier: DataFrame) -> DataFrame:
        where = f"{self.path}/level={level}"
        frontier.write.mode("overwrite").parquet(f"{where}/frontier")
        self.fs.create(self._path(f"{where}/_COMMITTED")).close()
        return self.read(level)

    def read(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level={level}/frontier")


def crawl(start: DataFrame, visit: Callable[[DataFrame], DataFrame], store: Checkpoint, limit: int = 0, most_levels: int = 1000, admit: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All requests of a crawl with their ``depth`` and ``level``, in keep-first order of seq within a level.

    ``start`` and what ``visit`` gives for a frontier have fp, seq, url and further columns of one schema;
    ``admit`` filters new requests (policies). The crawl resumes after the last committed level of ``store``.
    With requests left after ``most_levels`` levels it raises; a larger bound goes on from there.
    """
    done = store.committed()
    if not done:
        first = start if admit is None else admit(start)
        store.write(0, keep_first(first.withColumn("depth", F.lit(0)), "fp", ["seq"]))
        done = 1
    seen = store.read(0)
    for k in range(1, done):
        seen = seen.unionByName(store.read(k))
    level = done - 1
    while level + 1 < most_levels and not (limit and level >= limit):
        found = visit(store.read(level)).withColumn("depth", F.lit(level + 1))
        if admit is not None:
            found = admit(found)
        new = keep_first(found, "fp", ["seq"]).select(*seen.columns).join(seen.select("fp"), "fp", "left_anti").select(*seen.columns)
        nxt = store.write(level + 1, new)
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt)
        level += 1
    else:
        if not (limit and level >= limit) and not store.read(level).isEmpty():
            raise RuntimeError(f"requests are left after {most_levels} levels")
    return seen
