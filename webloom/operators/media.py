"""Media of items: paths, one download per address, results back in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.fingerprint import with_fingerprint


def file_path(url: Column) -> Column:
    """full/<sha1 of the address><extension>; an extension that is no plain one is left out."""
    ext = F.regexp_extract(urls.path(url), r"(\.[A-Za-z0-9]{1,8})$", 1)
    return F.concat(F.lit("full/"), F.sha1(url.cast("binary")), ext)


def image_path(url: Column) -> Column:
    return F.concat(F.lit("full/"), F.sha1(url.cast("binary")), F.lit(".jpg"))


def thumb_path(url: Column, size: str) -> Column:
    return F.concat(F.lit(f"thumbs/{size}/"), F.sha1(url.cast("binary")), F.lit(".jpg"))


def up_to_date(stored_at: Column, now: float, days: int = 90) -> Column:
    return F.coalesce((F.lit(float(now)) - stored_at) / 86400 <= days, F.lit(False))


def downloads(items: DataFrame, field: str = "file_urls") -> DataFrame:
    """``fp, url, path`` of every medium to fetch, once per fingerprint whatever the number of items that want it."""
    each = with_fingerprint(items.select(F.explode(field).alias("url")).filter("url is not null")).filter("fp is not null")
    return each.groupBy("fp").agg(F.min("url").alias("url")).withColumn("path", file_path(F.col("url")))


def completed(items: DataFrame, fetched: DataFrame, item_id: str = "item_id", field: str = "file_urls", result: str = "files") -> DataFrame:
    """``items`` with ``result``: structs of url, path, checksum and status of the fetched media, in the order wanted.

    ``fetched``: fp, path, checksum, status. Media that failed (no row) are left out, as are null addresses.
    """
    each = with_fingerprint(items.select(item_id, F.posexplode(field).alias("pos", "url")).filter("url is not null"))
    got = each.join(fetched.select("fp", "path", "checksum", "status"), "fp")
    back = got.groupBy(item_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url", "path", "checksum", "status"))), lambda x: F.struct(x["url"].alias("url"), x["path"].alias("path"), x["checksum"].alias("checksum"), x["status"].alias("status"))).alias(result))
    empty = F.array().cast(back.schema[result].dataType)
    return items.join(back, item_id, "left").withColumn(result, F.coalesce(result, empty))


def valid_path(path: Column) -> Column:
    """Whether a medium may be stored under the path: relative, without empty, current or parent folders."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", "..")), F.lit(False))


def store(media: DataFrame, folder: str, now: float) -> DataFrame:
    """Adds media (path, body) to the store at ``folder`` and gives what is stored of them: ``path, checksum, size, stored_at``.

    The store is a Parquet table in any file system Spark writes to; a write commits as a whole or not at all. Of repeated paths within
    one call the largest content counts, so a second run stores the same. Unsafe paths raise; null bodies are not stored.
    """
    bad = F.raise_error(F.concat(F.lit("not a path of the store: "), F.coalesce("path", F.lit("null")))).cast("string")
    rows = media.filter("body is not null").select(F.when(valid_path(F.col("path")), F.col("path")).otherwise(bad).alias("path"), F.col("body").cast("binary").alias("body"))
    one = rows.groupBy("path").agg(F.max("body").alias("body"))
    one.select("path", F.md5("body").alias("checksum"), F.octet_length("body").cast("long").alias("size"), F.lit(float(now)).alias("stored_at"), "body").write.mode("append").parquet(folder)
    return stat(media.sparkSession, folder).join(rows.select("path").distinct(), "path", "left_semi")


def stat(spark: SparkSession, folder: str) -> DataFrame:
    """``path, checksum, size, stored_at`` of every medium of the store: of a path stored again the last content."""
    s = spark.read.schema("path string, checksum string, size long, stored_at double, body binary").parquet(folder)
    last = s.groupBy("path").agg(F.max(F.struct("stored_at", "checksum", "size")).alias("s"))
    return last.select("path", "s.checksum", "s.size", "s.stored_at")


def to_download(wanted: DataFrame, stored: DataFrame, now: float, days: int = 90) -> DataFrame:
    """``wanted`` (path, ...) with ``status``: 'uptodate' where the store has it and it is not too old, else 'download'; and the stored ``checksum``."""
    s = stored.select("path", "checksum", "stored_at")
    return wanted.join(s, "path", "left").withColumn("status", F.when(up_to_date(F.col("stored_at"), now, days), "uptodate").otherwise("download")).drop("stored_at")


def images(media: DataFrame, min_width: int = 0, min_height: int = 0, thumbs: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Media (path, body) as JPEG images: ``path, kind, body, width, height``, 'image' and one row per thumbnail size.

    Turned as their EXIF says, in RGB, those under the least width or height left out. Needs Pillow on the executors; without it this raises.
    """
    names = ["path", "kind", "body", "width", "height"]

    def run(batches):
        import io

        from PIL import Image, ImageOps

        for b in batches:
            rows = []
            for path, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                im = ImageOps.exif_transpose(Image.open(io.BytesIO(body)))
                if im.width < min_width or im.height < min_height:
                    continue
                if im.mode != "RGB":
                    flat = Image.new("RGB", im.size, (255, 255, 255))
                    rgba = im.convert("RGBA")
                    flat.paste(rgba, rgba)
                    im = flat
                sizes = [("image", None), *(thumbs or {}).items()]
                for kind, size in sizes:
                    one = im.copy()
                    if size:
                        one.thumbnail(size, Image.Resampling.LANCZOS)
                    out = io.BytesIO()
                    one.save(out, "JPEG")
                    rows.append((path, kind, out.getvalue(), one.width, one.height))
            types = [pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return media.filter("body is not null").select("path", "body").mapInArrow(run, "path string, kind string, body binary, width int, height int")
