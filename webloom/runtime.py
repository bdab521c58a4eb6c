"""Session, scratch storage and sizing helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[int, str] = {}


def session(app: str = "webloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; the caller's cluster settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir`` or by ``SparkContext.setCheckpointDir``. Only a session on one machine
    (master local) gets a folder of its own, removed at exit; on a cluster without a shared folder this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    key = id(sc)
    if key not in _own_dirs:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share: intermediate tables are written there")
        _own_dirs[key] = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, _own_dirs[key], ignore_errors=True)
        sc.setCheckpointDir(_own_dirs[key])
    return "file://" + _own_dirs[key]


_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder, removed by ``intermediates`` or at exit."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove, 0)
    _written.append((spark, path))
    return path


def _remove(start: int) -> None:
    """Deletes the intermediate tables written since ``start`` through the session's file system."""
    todo = _written[start:]
    del _written[start:]
    for spark, path in todo:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session is gone, and its folder with it or left to the cluster's cleaner
            return


@contextlib.contextmanager
def intermediates():
    """Within it intermediate tables are written as ever; on leaving those written inside are deleted. Results must be stored by then."""
    start = len(_written)
    try:
        yield
    finally:
        _remove(start)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors,
    and lets later readers prune columns (unlike an RDD checkpoint)."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that is dear per row: a table of fewer splits than the cluster has cores is shared out over them.

    Larger tables, and what is more than a scan with filters and projections, stay as they are.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if not all(re.match(r"[\s:+|-]*(Project|Filter|Relation|LocalRelation|LogicalRDD)\b", x) for x in plan.strip().splitlines()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession, rows: int | None = None, rows_per_task: int = 200_000) -> int:
    """Number of partitions for an explicit repartition: the session's shuffle width, more if the rows ask for it."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(base, -(-rows // rows_per_task)) if rows else base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_to_null(c):
    return F.when(F.trim(c) == "", None).otherwise(c)
