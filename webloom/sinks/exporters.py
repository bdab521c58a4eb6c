"""Feed export: field projection, encodings of values, batches, templated addresses, and writers per format.

Every writer runs on the executors, one file per partition or per batch; the driver only names the folder.
Spark's own writers serve JSON lines, CSV and XML; a Python data source writes what they cannot: one JSON
array per file, Python and pickle and marshal dumps, lzma, files by batch. It writes through the file system the address names (local,
hdfs, s3, gs as far as pyarrow has them); an address of any other kind raises.
"""

from __future__ import annotations

import base64
import bz2
import csv
import datetime as dt
import decimal
import gzip
import io
import json
import lzma
import marshal
import pickle
import pprint
import re
import uuid
from dataclasses import dataclass
from xml.sax.saxutils import XMLGenerator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from webloom.runtime import materialize

# --- projection and values ---------------------------------------------------------------------------


def project(items: DataFrame, fields: list[str] | dict[str, str] | None = None, include_empty: bool = False, default: str | None = None, serializers: dict | None = None) -> DataFrame:
    """Fields in their order, renamed by a mapping; ``serializers`` map a field to a Column function.

    With ``include_empty`` fields the items lack are added as nulls (or ``default``).
    """
    names = fields if isinstance(fields, dict) else {f: f for f in (fields or items.columns)}
    cols = []
    for src, dst in names.items():
        if src in items.columns:
            c = F.col(f"`{src}`")
            if serializers and src in serializers:
                c = serializers[src](c)
            if include_empty and default is not None:
                c = F.coalesce(c, F.lit(default))
        elif include_empty:
            c = F.lit(default).cast("string")
        else:
            continue
        cols.append(c.alias(dst))
    return items.select(*cols)


def of_class(items: DataFrame, classes: list[str], column: str = "item_class") -> DataFrame:
    return items.filter(F.col(column).isin(*classes)) if classes else items


def text_value(c: Column, kind: str) -> Column:
    """Values as JSON holds them: bytes as UTF-8 text, times in ISO form, decimals as text."""
    if kind == "binary":
        return F.decode(c, "UTF-8")
    if kind in ("timestamp", "timestamp_ntz"):
        micros = F.date_format(c, "SSSSSS")
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind.startswith("decimal"):
        return c.cast("string")
    return c


def json_ready(items: DataFrame) -> DataFrame:
    return items.select(*[text_value(F.col(f"`{n}`"), t).alias(n) for n, t in items.dtypes])


def json_lines(items: DataFrame) -> DataFrame:
    """``value``: one JSON object per item; absent (null) fields are left out."""
    r = json_ready(items)
    return r.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in r.columns])).alias("value"))


def csv_cell(c: Column, kind: str, sep: str = ",") -> Column:
    """A field as a CSV cell: lists joined, null as ''."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(c.cast("array<string>"), sep), F.lit(""))
    return F.coalesce(text_value(c, kind).cast("string"), F.lit(""))


def csv_ready(items: DataFrame, sep: str = ",") -> DataFrame:
    return items.select(*[csv_cell(F.col(f"`{n}`"), t, sep).alias(n) for n, t in items.dtypes])


# --- batches and addresses ---------------------------------------------------------------------------


def batches(items: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``items`` with ``batch_id`` from 1, ``size`` rows each in the order of the columns.

    Numbered by ranges: a range partition sorts its rows, and only the sizes of the ranges meet on the driver.
    """
    if size <= 0:
        return items.withColumn("batch_id", F.lit(1).cast("long"))
    spark = items.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in order]
    # written once: sampled ranges may fall elsewhere in a second run
    p = materialize(items.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "batches")
    p = p.withColumn("_p", F.shiftright("_id", 33).cast("int")).withColumn("_a", F.col("_id").bitwiseAND((1 << 33) - 1))
    before, total = [], 0
    for r in sorted(p.groupBy("_p").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_p"]):
        before.append((r["_p"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "_p int, _before long"))  # a row per partition
    return p.join(offsets, "_p").withColumn("batch_id", (F.floor((F.col("_before") + F.col("_a")) / size) + 1).cast("long")).drop("_id", "_p", "_a", "_before")


_HOLDER = re.compile(r"%\((\w+)\)(0?\d*)([sd])")


def uri(template: str, params: dict) -> str:
    """printf-style address: ``%(name)s``, ``%(batch_id)03d``; a % that starts no known field stays."""
    return _HOLDER.sub(lambda m: f"%{m[2]}{m[3]}" % params[m[1]] if m[1] in params else m[0], template)


def needs_batch(template: str) -> bool:
    return bool(re.search(r"%\((?:batch_id|batch_time)\)", template))


# --- writers ---------------------------------------------------------------------------------------------


def _plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    if isinstance(v, (dt.datetime, dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return str(v)
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [_plain(x) for x in v]
    return v


class _Json:
    """One JSON array."""

    def __init__(self, f, o):
        self.f, self.n, self.indent, self.ascii = f, 0, int(o["indent"]) if o.get("indent") else None, o.get("ascii", "true") == "true"
        f.write(b"[")

    def add(self, row):
        line = b"\n" if self.indent is not None else b""
        self.f.write((b"," if self.n else b"") + line + json.dumps(_plain(row), ensure_ascii=self.ascii, indent=self.indent or None).encode())
        self.n += 1

    def end(self):
        self.f.write(b"\n]" if self.indent is not None and self.n else b"]")


class _JsonLines:
    def __init__(self, f, o):
        self.f, self.ascii = f, o.get("ascii", "true") == "true"

    def add(self, row):
        self.f.write(json.dumps(_plain(row), ensure_ascii=self.ascii).encode() + b"\n")

    def end(self):
        pass


class _Csv(_JsonLines):
    def __init__(self, f, o):
        self.text = io.TextIOWrapper(f, "utf-8", newline="", write_through=True)
        self.out = csv.writer(self.text, delimiter=o.get("delimiter", ","), lineterminator="\r\n")
        self.join, self.head = o.get("join", ","), o.get("header", "true") == "true"

    def add(self, row):
        d = row.asDict()
        if self.head:
            self.out.writerow(d)
            self.head = False
        self.out.writerow(self.join.join(map(str, _plain(v))) if isinstance(v, (list, tuple)) else "" if v is None else _plain(v) for v in d.values())

    def end(self):
        self.text.flush()
        self.text.detach()


class _Xml(_JsonLines):
    def __init__(self, f, o):
        self.g = XMLGenerator(f, "utf-8")
        self.root, self.row = o.get("root", "items"), o.get("row", "item")
        self.g.startDocument()
        self.g.startElement(self.root, {})

    def _field(self, name, v):
        self.g.startElement(name, {})
        if isinstance(v, dict):
            for k, x in v.items():
                self._field(k, x)
        elif isinstance(v, list):
            for x in v:
                self._field("value", x)
        elif v is not None:
            self.g.characters(v if isinstance(v, str) else str(v))
        self.g.endElement(name)

    def add(self, row):
        self._field(self.row, _plain(row))

    def end(self):
        self.g.endElement(self.root)
        self.g.endDocument()


class _Pickle(_JsonLines):
    def __init__(self, f, o):
        self.f = f

    def add(self, row):
        pickle.dump(row.asDict(recursive=True), self.f, protocol=4)


class _Marshal(_Pickle):
    def add(self, row):
        marshal.dump(_plain(row), self.f)


class _Pprint(_Pickle):
    def add(self, row):
        self.f.write((pprint.pformat(_plain(row)) + "\n").encode())


#: writers of one file by format, and the ends of their names; more may be registered
WRITERS = {"json": (_Json, "json"), "jsonlines": (_JsonLines, "jl"), "csv": (_Csv, "csv"), "xml": (_Xml, "xml"), "pickle": (_Pickle, "pickle"), "marshal": (_Marshal, "marshal"), "pprint": (_Pprint, "txt")}
_BUILT_IN = dict(WRITERS)
_OPEN = {"none": lambda f: f, "gzip": lambda f: gzip.GzipFile(fileobj=f, mode="wb"), "bz2": lambda f: bz2.BZ2File(f, "wb"), "lzma": lambda f: lzma.LZMAFile(f, "wb")}
_END = {"none": "", "gzip": ".gz", "bz2": ".bz2", "lzma": ".xz"}


def register_writer(name: str, writer: type, suffix: str) -> None:
    """A format of one's own: a class made with (file, options), with add(row) and end()."""
    WRITERS[name] = (writer, suffix)


def file_system(path: str):
    """(pyarrow file system, path in it) of an address or an absolute local path."""
    from pyarrow import fs

    where = re.sub("^s3a:", "s3:", path)
    if re.match("^file:/", where):
        where = re.sub("^file:/+", "/", where)
    if where.startswith("/"):
        return fs.LocalFileSystem(), where
    if "://" not in where:
        raise ValueError(f"neither an address nor an absolute path: {path}")
    return fs.FileSystem.from_uri(where)


@dataclass
class _Done(WriterCommitMessage):
    written: list


class _FileWriter(DataSourceWriter):
    """Each task writes hidden files, renamed when the whole write commits; what stood there before goes then, if it is to be overwritten."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite or options.get("replace") == "true"
        self.kind, self.codec, self.batch = options.get("kind", "json"), options.get("codec", "none"), options.get("batch")
        self.options = {str(k): str(v) for k, v in options.items()}
        own = self.options.pop("writer", None)  # registered in the process that asked for the feed
        if (own is None and self.kind not in WRITERS) or self.codec not in _OPEN:
            raise ValueError(f"unknown kind or codec: {self.kind}, {self.codec}")
        self.writer, suffix = WRITERS[self.kind] if own is None else cloudpickle.loads(base64.b64decode(own))
        self.end = f".{suffix}{_END[self.codec]}"
        file_system(self.path)

    def write(self, rows):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        done, open_, now = [], None, None

        def close():
            if open_:
                open_[0].end()
                for f in open_[1:]:
                    f.close()

        try:
            for r in rows:
                batch = r[self.batch] if self.batch else None
                if open_ is None or batch != now:
                    close()
                    name = f"part-{uuid.uuid4().hex}" if batch is None else uri(self.options.get("name", "batch-%(batch_id)05d"), {"batch_id": batch})
                    raw = fs.open_output_stream(f"{root}/.{name}{self.end}", compression=None)
                    out = _OPEN[self.codec](raw)
                    done.append((f"{root}/.{name}{self.end}", f"{root}/{name}{self.end}"))
                    open_, now = (self.writer(out, self.options), *([out] if out is not raw else []), raw), batch
                if self.batch:
                    from pyspark.sql import Row

                    r = Row(**{k: v for k, v in r.asDict().items() if k != self.batch})
                open_[0].add(r)
            if open_ is None and not self.batch:
                raw = fs.open_output_stream(f"{root}/.part-{uuid.uuid4().hex}{self.end}", compression=None)
                out = _OPEN[self.codec](raw)
                open_ = (self.writer(out, self.options), *([out] if out is not raw else []), raw)
        finally:
            close()
        return _Done(done)

    def commit(self, messages):
        fs, root = file_system(self.path)
        new = [pair for m in messages if m for pair in m.written]
        if self.overwrite:
            from pyarrow import fs as pafs

            hidden = {a for a, _ in new}
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.path not in hidden and not any(f.path.endswith(a) for a in hidden):
                    (fs.delete_dir if f.type == pafs.FileType.Directory else fs.delete_file)(f.path)
        for a, b in new:
            fs.move(a, b)

    def abort(self, messages):
        fs, _ = file_system(self.path)
        for m in messages:
            for a, _b in m.written if m else ():
                fs.delete_file(a)


class FeedFiles(DataSource):
    """``df.write.format('webloom_feed')`` with options path, kind (one of ``WRITERS``), codec (none, gzip, bz2, lzma), batch (column), name, indent, ascii and those of the kind.

    The path is a folder all executors share.
    """

    @classmethod
    def name(cls):
        return "webloom_feed"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedFiles)


def export(items: DataFrame, path: str, fmt: str = "jsonlines", mode: str = "append", codec: str = "none", store_empty: bool = True, batch: str | None = None, **options) -> bool:
    """Writes a feed; False where there was nothing to store and ``store_empty`` is off.

    ``mode`` is append or overwrite. With ``batch`` (a column, see ``batches``) there is a file per batch, named by option ``name``.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    if not store_empty and items.isEmpty():
        return False
    w_codec = {"none": "none", "gzip": "gzip", "bz2": "bzip2"}.get(codec)
    if batch is None and fmt == "jsonlines" and w_codec:
        json_lines(items).write.mode(mode).option("compression", w_codec).text(path)
    elif batch is None and fmt == "csv" and w_codec:
        csv_ready(items, options.get("join", ",")).write.mode(mode).options(header=options.get("header", True), sep=options.get("delimiter", ","), lineSep="\r\n", escape='"', emptyValue="", compression=w_codec).csv(path)
    elif batch is None and fmt == "xml" and w_codec:
        # lists as elements of their own inside the field's element
        lists = [F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.col(f"`{n}`").alias("value"))).alias(n) if t.startswith("array") else F.col(f"`{n}`") for n, t in items.dtypes]
        json_ready(items).select(*lists).write.mode(mode).options(rootTag=options.get("root", "items"), rowTag=options.get("row", "item"), arrayElementName="value", compression=w_codec).format("xml").save(path)
    elif fmt in WRITERS:
        register(items.sparkSession)
        if batch is not None:  # every batch in one task, in one run of its rows
            items = items.repartition(batch).sortWithinPartitions(batch)
            options = {**options, "batch": batch}
        replace = {"replace": "true"} if mode == "overwrite" else {}
        if WRITERS[fmt] is not _BUILT_IN.get(fmt):
            options = {**options, "writer": base64.b64encode(cloudpickle.dumps(WRITERS[fmt])).decode()}
        items.write.format("webloom_feed").mode("append").options(path=path, kind=fmt, codec=codec, **replace, **{k: v if isinstance(v, str) else str(v).lower() for k, v in options.items()}).save()
    else:
        raise ValueError(f"no writer for {fmt} with {codec}")
    return True
