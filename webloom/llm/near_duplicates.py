"""Near-duplicate pages by MinHash banding, verified on whole n-gram sets.

1. Every body becomes its set of word triples, hashed to 32 bits (in a set of 500 a wrong match has odds
   of 1 : 10,000 and moves the similarity by 1/500), written once. Equal sets form a class; only one
   representative of a class goes on, so a page stored again many times costs one row per step.
2. Document frequencies of all triples are counted in one hashed table (all documents, all triples), whose
   size follows from the mean number of triples, not of documents. Triples in more than ``common_share`` of the
   documents - menus and notices of big sites - are *common*.
3. Signatures. Family 0 takes minima over the rare triples only, so pages that merely share a site's
   boilerplate do not meet, however large the site. Documents whose rare share is under ``rare_share``
   also join family 1, over all triples with longer bands. Any pair at the limit in which one side has
   that rare share keeps a rare-set similarity of (limit - c) / (1 - c) with c = 1 - rare_share; any
   other pair meets in family 1 at its full similarity. The bands of both families are chosen for the
   target recall at those similarities. Band keys have 40 bits: a wrong meeting costs a candidate, no result.
4. Band hashes of one document only are dropped before the join. Those of more than ``hot`` documents are cut into
   blocks of about ``hot`` documents by a hash of the id; every two blocks meet in a task key of their own, so no task
   holds a whole hot band. Pairs are made distinct, dropped if 256 one-bit minima (a fixed 32 bytes a document)
   put them far below the limit, and verified on the whole triple sets.
5. Verified pairs of representatives and the members of the classes give the result: every pair if asked
   for, or one row per document with its class and its number of links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.runtime import materialize, shuffle_width, spread

_MARKUP = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[/!?a-zA-Z][^>]*>", re.S | re.I)
_BLANKS = re.compile(r"[ \t\r\n]+")
_TABLE_BITS = (22, 25)  # bounds of the counters of the frequency table
_SLICES = 64
_SKETCH = 256

SETS = "id long, c1 long, c2 long, size int, grams array<int>"


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` rows that find a pair of the given similarity with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def families(similarity: float, recall: float, rare_share: float, rare_rows: int, full_rows: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(bands, rows) over the rare and over all triples; each finds its weakest pairs at the limit with the target recall."""
    c = 1 - rare_share
    return (bands_for((similarity - c) / (1 - c), rare_rows, recall), rare_rows), (bands_for(similarity, full_rows, recall), full_rows)


def words_of_page(body: bytes) -> list[str]:
    """Words of a page without scripts, styles, comments and tags, in lower case."""
    t = _MARKUP.sub(" ", body.decode("utf-8", "replace")).lower()
    return [w for w in _BLANKS.split(t) if w]


def _grams(words: list[str], size: int, known: dict[str, int]) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    ids = []
    for w in words:
        x = known.get(w)
        if x is None:
            if len(known) > 200_000:
                known.clear()
            x = known[w] = h(w)
        ids.append(x)
    a = np.array(ids, np.uint64)
    n = len(a) - size + 1
    g = np.zeros(n, np.uint64)
    for k in range(size):
        g = (g ^ a[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return np.unique(g)


def _sets(size: int, is_page: bool):
    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            cols = [[], [], [], [], []]
            sizes = [0]
            for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of_page(body) if is_page else body.lower().split()
                g = _grams(words, size, known)
                if not len(g):
                    continue
                raw = xxhash.xxh3_128_intdigest(g.tobytes())
                signed = np.array([raw & (2**64 - 1), raw >> 64], np.uint64).view(np.int64)
                short = np.unique((g >> np.uint64(32)).astype(np.uint32))
                sizes.append(sizes[-1] + len(short))
                for c, v in zip(cols, (i, int(signed[0]), int(signed[1]), len(short), short.view(np.int32))):
                    c.append(v)
            flat = np.concatenate(cols[4]) if cols[4] else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32()), lists], ["id", "c1", "c2", "size", "grams"])

    return run


def table_bits(triples: float) -> int:
    """Bits of the frequency table for documents of so many triples on average: chance gives a counter at most about 1 / 8,000 of the documents."""
    low, high = _TABLE_BITS
    return min(high, max(low, math.ceil(math.log2(max(1.0, 8000 * triples)))))


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint32(32 - bits)).astype(np.int64)


def _count_table(bits: int):
    """Counts of hashed triples in this partition, cut into slices."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int32)
        for b in batches:
            g = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            np.add.at(counts, _slot(g, bits), 1)
        width = (1 << bits) // _SLICES
        for s in range(_SLICES):
            part = counts[s * width : (s + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([part[at]], pa.list_(pa.int32()))], ["slice", "at", "n"]
                )

    return run


def _sum_slices(limit: float, bits: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 << bits) // _SLICES, np.int64)
        for b in batches:
            for at, n in zip(b.column("at"), b.column("n")):
                counts[at.values.to_numpy()] += n.values.to_numpy()
        over = np.packbits(counts > limit, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([over.tobytes()], pa.binary())], ["slice", "bits"])

    return run


def common_grams(sets: DataFrame, limit: float, bits: int) -> bytes:
    """Bit table (2**bits bits: 512 KB to 4 MB, whatever the corpus) of the hashed triples in more than ``limit`` documents."""
    got = sets.select("grams").mapInArrow(_count_table(bits), "slice int, at array<int>, n array<int>").groupBy("slice").applyInArrow(_sum_slices(limit, bits), "slice int, bits binary").collect()
    width = (1 << bits) // _SLICES // 8
    by = {r["slice"]: bytes(r["bits"]) for r in got}
    return b"".join(by.get(s, bytes(width)) for s in range(_SLICES))


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


def _minima(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.uint32)
    for s in range(0, len(a), 64):
        h = (grams[None, :] ^ b[s : s + 64, None]) * a[s : s + 64, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[s : s + 64] = h.min(axis=1)
    return out


def _band_keys(minima: np.ndarray, rows: int, family: int) -> np.ndarray:
    m = minima.reshape(-1, rows).astype(np.uint64)
    k = np.arange(len(m), dtype=np.uint64) * np.uint64(2) + np.uint64(family + 1)
    for j in range(rows):
        k = (k ^ m[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(31)
    return (k >> np.uint64(24)).view(np.int64)


def _signatures(table, rare_share: float, rare: tuple[int, int], full: tuple[int, int]):
    def run(batches):
        common = np.unpackbits(np.frombuffer(table.value, np.uint8), bitorder="little").astype(bool)
        bits = len(common).bit_length() - 1
        ra, rb = _coefficients(rare[0] * rare[1], 11)
        fa, fb = _coefficients(full[0] * full[1], 13)
        sa, sb = _coefficients(_SKETCH, 17)
        for b in batches:
            out = [[], [], []]
            for i, g in zip(b.column("id").to_pylist(), b.column("grams")):
                g = g.values.to_numpy(zero_copy_only=False).view(np.uint32)
                few = g[~common[_slot(g, bits)]]
                keys = [_band_keys(_minima(few, ra, rb), rare[1], 0)] if len(few) else []
                if len(few) < rare_share * len(g):
                    keys.append(_band_keys(_minima(g, fa, fb), full[1], 1))
                sketch = np.packbits((_minima(g, sa, sb) & 1).astype(np.uint8)).tobytes()
                for c, v in zip(out, (i, np.concatenate(keys), sketch)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary())], ["id", "bands", "sketch"])

    return run


def _far(limit: float):
    """Drops pairs whose one-bit minima put them far (five standard deviations) below the limit."""
    slack = 5 * math.sqrt(1 - limit**2) / math.sqrt(_SKETCH)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, _SKETCH // 8) for k in ("sa", "sb"))
                same = _SKETCH - np.bitwise_count(x ^ y).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(2 * same / _SKETCH - 1 >= limit - slack))

    return run


def _verify(limit: float):
    def run(batches):
        for t in batches:
            keep, sims = [], []
            for n, (x, y) in enumerate(zip(t.column("ga"), t.column("gb"))):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                s = both / (len(x) + len(y) - both)
                if s >= limit:
                    keep.append(n)
                    sims.append(s)
            yield pa.RecordBatch.from_arrays([t.column("a").take(pa.array(keep, pa.int64())), t.column("b").take(pa.array(keep, pa.int64())), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return run


def _meetings(bands: DataFrame, hot: int) -> DataFrame:
    """Distinct pairs ``a < b`` of documents (id, band) that share a band."""
    bands = bands.repartition(shuffle_width(bands.sparkSession), "band")
    shared = bands.withColumn("k", F.count("*").over(W.partitionBy("band"))).filter("k > 1")
    shared = materialize(shared, "bands")  # a small part of the bands, used by both sides of each join
    few = shared.filter(F.col("k") <= hot)
    cold = few.select("band", F.col("id").alias("a")).join(few.select("band", F.col("id").alias("b")), "band").filter("a < b").select("a", "b")
    # blocks i <= j of a hot band meet under the key (band, i, j)
    block = shared.filter(F.col("k") > hot).withColumn("last", F.floor((F.col("k") - 1) / hot).cast("int"))
    block = block.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("last") + 1).cast("int"))
    left = block.select("band", F.col("id").alias("x"), F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"))
    right = block.select("band", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    across = left.join(right, ["band", "i", "j"]).filter((F.col("x") < F.col("y")) | (F.col("i") < F.col("j")))
    return cold.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).filter("a < b").distinct()


class NearDuplicates:
    """Classes of equal n-gram sets (``members``: id, rep) and verified pairs of their representatives (``links``: a < b, similarity)."""

    def __init__(
        self, texts: DataFrame, similarity: float, gram: int, is_page: bool,
        recall: float = 0.999, common_share: float = 0.001, rare_share: float = 0.8, rare_rows: int = 4, full_rows: int = 5,
        hot: int = 512,
    ):
        """``texts``: id long, text (binary for pages, string otherwise); rows with null id or text or fewer words than a gram have no partner.

        ``hot``: documents of one band that meet in one task."""
        spark = texts.sparkSession
        self.sets = sets = materialize(spread(texts.filter("id is not null and text is not null")).mapInArrow(_sets(gram, is_page), SETS), "ngrams")
        rep = sets.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
        # a class can hold a third of all rows: the side with the representatives is unique, so a hot class is one probe key
        self.members = materialize(sets.select("id", "c1", "c2").join(rep, ["c1", "c2"]).select("id", "rep"), "classes")
        # written by itself: with few copies its known size makes the next joins broadcasts, with many they shuffle
        copies = materialize(self.members.filter("id <> rep").select("id"), "copies")
        own = sets.join(copies, "id", "left_anti").select("id", "grams")
        docs, triples = sets.join(copies, "id", "left_anti").agg(F.count("*"), F.sum("size")).first()
        bits = table_bits((triples or 0) / max(1, docs))
        by_chance = (triples or 0) / (1 << bits)
        table = spark.sparkContext.broadcast(common_grams(own, max(8.0, common_share * docs, 3 * by_chance), bits))
        rare, full = families(similarity, recall, rare_share, rare_rows, full_rows)
        signed = materialize(own.mapInArrow(_signatures(table, rare_share, rare, full), "id long, bands array<long>, sketch binary"), "signatures")
        meet = _meetings(signed.select("id", F.explode("bands").alias("band")), hot)
        sketch = signed.select("id", "sketch")
        near = (
            meet.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_far(similarity), "a long, b long")
        )
        near = materialize(near, "candidates")
        # whole sets travel only for documents that are left with a candidate
        left = own.join(near.select(F.col("a").alias("id")).distinct(), "id", "left_semi").toDF("a", "ga")
        right = own.join(near.select(F.col("b").alias("id")).distinct(), "id", "left_semi").toDF("b", "gb")
        self.links = materialize(near.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(_verify(similarity), "a long, b long, similarity double"), "links")

    def pairs(self) -> DataFrame:
        """Every pair of documents at or above the limit, smaller id first (as many rows as there are pairs)."""
        m = self.members
        same = m.toDF("x", "rep").join(m.toDF("y", "rep"), "rep").filter("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
        other = self.links.join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return same.unionByName(other)

    def memberships(self) -> DataFrame:
        """One row per document with n-grams: id, class_id (smallest id with the same set), copies in its class, links to other classes."""
        ends = self.links.select(F.col("a").alias("rep")).unionAll(self.links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
        size = self.members.groupBy("rep").agg(F.count("*").alias("copies"))
        return self.members.join(size, "rep").join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def near_duplicate_pages(responses: DataFrame, similarity: float = 0.6, min_bytes: int = 1700, **how) -> NearDuplicates:
    """Near duplicates among the bodies of at least ``min_bytes`` bytes, on triples of words.

    Null and shorter bodies, null ids and bodies under three words have no partner. Rows that repeat an id
    count once per distinct body pair of ids; extra columns are ignored; an empty table gives no pairs.
    """
    big = responses.filter(F.octet_length("body") >= min_bytes).select(F.col("response_id").cast("long").alias("id"), F.col("body").alias("text"))
    return NearDuplicates(big, similarity, 3, True, **how)
