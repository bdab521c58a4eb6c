"""Has this key been seen before? Exactly-sized Elias-Fano filters over hash partitions.

A key is hashed to ``hash_bits`` bits. The top bits name a hash partition, the rest is a number in the
partition's universe; the sorted numbers of a partition are held Elias-Fano coded. Arrivals are cut
into batches by their sequence number; one task walks through a partition batch by batch: probe the
batch's keys by successor search, report the first arrival of every key that is new, merge the new keys
into the code. A task holds the code, while merging the next one, and at most a quarter as many keys of
the batch under way as numbers (or ``_HELD``): about 12 bytes a key. Partitions and batches follow from
the number of rows, so no task grows with the table.

Before the shuffle every Arrow batch is reduced to the first arrival of each (key, batch), so one
polled address with a third of all rows costs its partition a row per Arrow batch, not its rows.

Only first arrivals leave the filter; "seen before" is everything else, taken by an anti join on the
unique sequence numbers, which no hot key can skew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.elias_fano import EliasFano
from webloom.runtime import shuffle_width

_KEY = r"^\s*([0-9A-Fa-f]{40})\s*$"


def key_bytes(fingerprint: Column) -> Column:
    """The 20 bytes a fingerprint names, null where it names none."""
    hex_ = F.regexp_extract(fingerprint, _KEY, 1)
    return F.when(hex_ != "", F.unhex(hex_))


def key_hash(fingerprint: Column, hash_bits: int) -> Column:
    """``hash_bits``-bit hash of the key (1..63), null where the fingerprint is not 40 hex digits."""
    b = key_bytes(fingerprint)
    return F.when(b.isNotNull(), F.shiftrightunsigned(F.xxhash64(b), 64 - hash_bits))


def _reduce(batches):
    """First arrival of each (hash, batch) within an Arrow batch."""
    for b in batches:
        if b.num_rows:
            h, g, s = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            o = np.lexsort((s, h, g))
            first = np.concatenate(([True], (h[o][1:] != h[o][:-1]) | (g[o][1:] != g[o][:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(x[o][first]) for x in (h, g, s)], ["h", "g", "seq"])


_HELD = 1 << 20  # rows of a batch held at least before they are merged


class _Partition:
    """The filters of one hash partition, one for each width of the hash; the first decides on arrivals."""

    def __init__(self, part: int, part_bits: int, widths: tuple[int, ...]):
        self.part, self.widths = part, widths
        self.masks = [np.uint64((1 << (w - part_bits)) - 1) for w in widths]
        self.codes = [EliasFano(np.zeros(0, np.uint64), w - part_bits) for w in widths]
        self.found = [0] * len(widths)

    def pass_(self, h: np.ndarray, s: np.ndarray, counts: bool) -> tuple[np.ndarray, np.ndarray]:
        """Probes and merges keys sorted by hash, then sequence; gives the first arrivals of the new ones."""
        out = h[:0], s[:0]
        for k, (width, mask) in enumerate(zip(self.widths, self.masks)):
            x = h >> (self.widths[0] - width)
            first = np.concatenate(([True], x[1:] != x[:-1]))
            u = x[first].astype(np.uint64) & mask
            new = ~self.codes[k].contains(u)
            self.codes[k] = self.codes[k].merge(u[new])
            if counts:
                self.found[k] += int(new.sum())
            if k == 0:
                out = h[first][new], s[first][new]
        return out


def _walk(part_bits: int, widths: tuple[int, ...], emit: str):
    """``emit``: 'first' arrivals, 'counts' of them by width, or the 'codes'."""

    def run(batches):
        here, group, held, rows = None, None, [], 0

        def flush():
            nonlocal held, rows
            h, s = (np.concatenate(x) for x in zip(*held))
            held, rows = [], 0
            h, s = here.pass_(h, s, group >= 0)
            if emit == "first" and group >= 0 and len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s)], ["h", "seq"])

        def done():
            if here is not None and emit == "codes":
                c = here.codes[0]
                yield pa.RecordBatch.from_arrays([pa.array([here.part], pa.int32()), pa.array([c.n]), pa.array([c.nbytes]), pa.array([c.to_bytes()], pa.binary())], ["part", "n", "bytes", "code"])
            elif here is not None and emit == "counts":
                yield pa.RecordBatch.from_arrays([pa.array(widths, pa.int32()), pa.array(here.found, pa.int64())], ["hash_bits", "found"])

        for b in batches:
            if not b.num_rows:
                continue
            p, h, g, s = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cut = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (g[1:] != g[:-1]))))
            for a, e in zip(cut, np.concatenate((cut[1:], [len(p)]))):
                if here is None or (p[a], g[a]) != (here.part, group):
                    if held:
                        yield from flush()
                    if here is None or p[a] != here.part:
                        yield from done()
                        here = _Partition(int(p[a]), part_bits, widths)
                    group = int(g[a])
                elif rows > max(_HELD, here.codes[0].n // 4) and h[a] != held[-1][0][-1]:
                    yield from flush()  # a batch comes sorted by key, so its first part is a batch of its own
                held.append((h[a:e], s[a:e]))
                rows += e - a
        if held:
            yield from flush()
        yield from done()

    return run


_KEYS_PER_PARTITION = 1 << 21
_ROWS_PER_BATCH = 1 << 18


def _rows(arrivals: DataFrame, seen: DataFrame | None, hash_bits: int, part_bits: int | None, batches: int | None, narrowest: int) -> tuple[DataFrame, int]:
    """Rows (h, g, seq) of both tables, those of ``seen`` with g -1, and the bits of the partition number."""
    n = arrivals.count() + (seen.count() if seen is not None else 0)
    if part_bits is None:
        at_least = shuffle_width(arrivals.sparkSession).bit_length() + 1  # work for every task of the shuffle
        part_bits = min(max(at_least, (n // _KEYS_PER_PARTITION).bit_length()), narrowest - 4)
    if batches is None:
        batches = max(2, -(-(n >> part_bits) // _ROWS_PER_BATCH))
    a = arrivals.select(key_hash(F.col("fingerprint"), hash_bits).alias("h"), F.col("seq").cast("long").alias("seq"))
    a = a.filter("h is not null and seq is not null")
    lo, hi = arrivals.agg(F.min("seq"), F.max("seq")).first()
    lo, hi = lo or 0, hi or 0
    width = max(1, -(-(hi - lo + 1) // batches))
    rows = a.select("h", F.expr(f"cast((seq - {lo}L) div {width}L as int)").alias("g"), "seq")
    if seen is not None:
        old = seen.select(key_hash(F.col("fingerprint"), hash_bits).alias("h"), F.lit(-1).alias("g"), F.lit(-1).cast("long").alias("seq"))
        rows = rows.unionByName(old.filter("h is not null"))
    return _partitioned(rows, n, hash_bits, part_bits), part_bits


def _partitioned(rows: DataFrame, n: int, hash_bits: int, part_bits: int) -> DataFrame:
    few = rows.mapInArrow(_reduce, "h long, g int, seq long")
    few = few.select(F.shiftright("h", hash_bits - part_bits).cast("int").alias("part"), "h", "g", "seq")
    width = min(1 << part_bits, shuffle_width(rows.sparkSession, n, _KEYS_PER_PARTITION))
    return few.repartition(width, "part").sortWithinPartitions("part", "g", "h", "seq")


def first_arrivals(arrivals: DataFrame, seen: DataFrame | None, hash_bits: int = 63, part_bits: int | None = None, batches: int | None = None) -> DataFrame:
    """``(h, seq)`` of each arrival whose key is in neither ``seen`` nor an arrival of smaller ``seq``.

    ``arrivals``: seq long, fingerprint string; ``seen``: fingerprint string, earlier than any arrival.
    Letter case and surrounding blanks of a fingerprint mean nothing; nulls and broken digests are no
    keys and never reported; rows with a null ``seq`` have no place in the order and are left out;
    repeated rows with one ``seq`` are both first. Extra columns are ignored, empty tables allowed.
    ``part_bits`` and ``batches`` follow from the number of rows unless given.

    A hash collision can only hide a first arrival. Expected rate: keys held / 2**hash_bits.
    """
    rows, part_bits = _rows(arrivals, seen, hash_bits, part_bits, batches, hash_bits)
    return rows.mapInArrow(_walk(part_bits, (hash_bits,), "first"), "h long, seq long")


def filter_codes(keys: DataFrame, hash_bits: int = 63, part_bits: int | None = None) -> DataFrame:
    """The filter itself as a table: one Elias-Fano code per hash partition, ready to be written and restored."""
    rows, part_bits = _rows(keys.select("fingerprint", F.lit(0).cast("long").alias("seq")), None, hash_bits, part_bits, 1, hash_bits)
    return rows.mapInArrow(_walk(part_bits, (hash_bits,), "codes"), "part int, n long, bytes long, code binary")


def seen_before(arrivals: DataFrame, seen: DataFrame | None, **how) -> DataFrame:
    """``seq`` of each arrival whose key occurred before (see ``first_arrivals`` for the cases)."""
    bits = how.get("hash_bits", 63)
    first = first_arrivals(arrivals, seen, **how)
    valid = arrivals.select(F.col("seq").cast("long").alias("seq"), key_hash(F.col("fingerprint"), bits).alias("h")).filter("h is not null and seq is not null")
    return valid.join(first, ["seq", "h"], "left_anti").select("seq").distinct()


def exact_first(arrivals: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Exact counterpart over the whole keys, for measuring the filter: key and first ``seq``."""
    k = arrivals.select(key_bytes(F.col("fingerprint")).alias("key"), F.col("seq").cast("long").alias("seq")).filter("key is not null and seq is not null")
    first = k.groupBy("key").agg(F.min("seq").alias("seq"))
    if seen is not None:
        first = first.join(seen.select(key_bytes(F.col("fingerprint")).alias("key")).filter("key is not null"), "key", "left_anti")
    return first


def error_rates(arrivals: DataFrame, seen: DataFrame | None, hash_bits: tuple[int, ...] = (24, 32, 40, 63)) -> DataFrame:
    """Measured and expected rate of wrong answers for several hash widths, against the exact answer.

    A wrong answer is a key called seen that is new. One row per width: distinct new keys, first
    arrivals found, wrong answers, their rate among the new keys and the rate expected by chance. One walk
    carries a filter for every width: the narrower hashes are the leading bits of the widest.
    """
    widths = tuple(sorted(set(hash_bits), reverse=True))
    rows, part_bits = _rows(arrivals, seen, widths[0], None, None, widths[-1])
    found = rows.mapInArrow(_walk(part_bits, widths, "counts"), "hash_bits int, found long")
    zero = F.lit(0).cast("long")
    every = F.explode(F.array(*map(F.lit, widths))).alias("hash_bits")
    exact = exact_first(arrivals, seen).agg(F.count("*").alias("new_keys")).select(every, "new_keys", zero.alias("found"))
    c = exact.unionByName(found.select("hash_bits", zero.alias("new_keys"), "found")).groupBy("hash_bits").agg(F.sum("new_keys").alias("new_keys"), F.sum("found").alias("found"))
    wrong = F.col("new_keys") - F.col("found")
    return c.select(
        "hash_bits", "new_keys", "found", wrong.alias("wrong"), (wrong / F.greatest(F.col("new_keys"), F.lit(1))).alias("wrong_rate"),
        (F.col("new_keys") / F.lit(2.0) / F.pow(F.lit(2.0), F.col("hash_bits"))).alias("expected_rate"),
    )
