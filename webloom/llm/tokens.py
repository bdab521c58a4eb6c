"""Encoding a corpus with a public byte-level BPE through a table of distinct words.

The tokenizer's own split pattern cuts a text into words that are merged independently, so the ids of a
text are the ids of its words side by side. One pass splits the texts where they are stored: it cuts them
into chunks of about a megabyte and writes, for each chunk, its distinct words and each text as positions
in that vocabulary. Every distinct word of the corpus is merged once, its ids are joined back to the chunks
that use the word, and each chunk puts the ids in the places of its words. The running text is neither
shuffled nor split twice: what is shuffled is the positions, four bytes a word before compression, and a
chunk's vocabulary, so a word that makes up a third of the corpus costs one row per chunk.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from webloom.runtime import materialize, shuffle_width, spread

TOKENIZER_DIR = "/opt/tokenizers"

#: The split pattern published with the byte-level rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BYTE_LEVEL = ("byte_bpe_50k", "byte_bpe_multi_50k")

_loaded: dict[str, object] = {}


def rank_file(name: str, folder: str) -> str:
    if name not in BYTE_LEVEL:
        raise ValueError(f"{name}: only the byte-level tokenizers split into independent words: {', '.join(BYTE_LEVEL)}")
    return os.path.join(folder, f"{name}.tiktoken")


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(path: str):
    if path not in _loaded:
        import tiktoken

        _loaded[path] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _loaded[path]


_split = regex.compile(SPLIT_PATTERN).findall


class _Positions(dict):
    """Word to its position in the vocabulary of a chunk."""

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        return i


def _split_texts(kept: int, chunk_bytes: int, types: list[pa.DataType]):
    """Texts (the last column) as positions in the vocabulary of their chunk, and the vocabularies."""
    names = ["chunk", "pos", "word", *(f"c{k}" for k in range(kept)), "at"]
    fields = [pa.int64(), pa.int32(), pa.string(), *types, pa.list_(pa.int32())]

    def batch(size: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[n].cast(t) if n in cols else pa.nulls(size, t) for n, t in zip(names, fields)], names)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        known, at, sizes, held, size = _Positions(), [], [0], [], 0

        def close():
            rows = len(sizes) - 1
            cols = {f"c{k}": pa.concat_arrays([h[k] for h in held]) for k in range(kept)}
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(at, pa.int32()))
            yield batch(rows, chunk=pa.array(np.full(rows, chunk)), at=lists, **cols)
            n = len(known)
            if n:
                yield batch(n, chunk=pa.array(np.full(n, chunk)), pos=pa.array(np.arange(n, dtype=np.int32)), word=pa.array(list(known), pa.string()))

        for b in batches:
            start = 0
            for row, text in enumerate(b.column(kept).to_pylist()):
                if text:
                    at += map(known.__getitem__, _split(text))
                    size += len(text)
                sizes.append(len(at))
                if size >= chunk_bytes:
                    held.append([b.column(k).slice(start, row + 1 - start) for k in range(kept)])
                    yield from close()
                    chunk, start = chunk + 1, row + 1
                    known, at, sizes, held, size = _Positions(), [], [0], [], 0
            if start < b.num_rows:
                held.append([b.column(k).slice(start) for k in range(kept)])
        if len(sizes) > 1:
            yield from close()

    return run


def _merge_words(path: str):
    def run(batches):
        enc = _encoder(path)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _replace(kept: int, count_only: bool):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        order = np.argsort(words.column("pos").to_numpy())
        ids = words.column("ids").combine_chunks().take(pa.array(order))
        lengths = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts, flat = np.cumsum(lengths) - lengths, ids.flatten().to_numpy(zero_copy_only=False)
        at = docs.column("at").combine_chunks()
        per_text = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = at.flatten().to_numpy(zero_copy_only=False)
        per_word = lengths[at]
        ends = np.concatenate(([0], np.cumsum(per_word)))
        bounds = ends[np.concatenate(([0], np.cumsum(per_text)))]  # of the ids of each text
        keep = docs.select([f"c{k}" for k in range(kept)])
        if count_only:
            return keep.append_column("tokens", pa.array(np.diff(bounds)))
        values = flat[np.repeat(starts[at] - ends[:-1], per_word) + np.arange(ends[-1])].astype(np.int32)
        return keep.append_column("ids", pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values)))

    return run


def _encode(docs: DataFrame, columns: list[str], tokenizer: str, folder: str, chunk_bytes: int, count_only: bool) -> DataFrame:
    path = rank_file(tokenizer, folder)
    kept = [docs.schema[c].dataType for c in columns]
    fields = ", ".join(f"c{k} {t.simpleString()}" for k, t in enumerate(kept))
    texts = spread(docs.select(*columns, F.col("text").cast("string").alias("text")))
    split = texts.mapInArrow(_split_texts(len(kept), chunk_bytes, [to_arrow_type(t) for t in kept]), f"chunk long, pos int, word string, {fields}, at array<int>")
    split = materialize(split, "split")
    used = split.filter("word is not null").select("chunk", "pos", "word")
    known = used.select("word").distinct().mapInArrow(_merge_words(path), "word string, ids array<int>")
    back = used.join(known, "word").select("chunk", "pos", "ids")
    places = split.filter("at is not null").select(F.col("chunk").alias("of"), *(f"c{k}" for k in range(len(kept))), "at")
    done = places.groupBy("of").cogroup(back.groupBy("chunk")).applyInArrow(_replace(len(kept), count_only), fields + (", tokens long" if count_only else ", ids array<int>"))
    return done.withColumnsRenamed({f"c{k}": c for k, c in enumerate(columns)})


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, chunk_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (doc_id, text), without special tokens.

    Null and empty texts get an empty list; blank texts the ids of their blanks. Repeated rows and
    repeated or null ids each keep their row. Strings of special tokens inside a text are ordinary text.
    Extra columns are ignored; an empty table gives an empty result. ``chunk_bytes``: characters after which a chunk is closed.
    """
    return _encode(docs, ["doc_id"], tokenizer, folder, chunk_bytes, False)


def token_counts(docs: DataFrame, columns: list[str], tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The given columns of ``docs`` and ``tokens``, the size of the text; 0 for null and empty texts."""
    return _encode(docs, columns, tokenizer, folder, chunk_bytes, True)


def pieces(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Id-to-piece table (id, piece); as many rows as the vocabulary, whatever the corpus."""
    r = ranks(rank_file(tokenizer, folder))
    return spark.createDataFrame(pa.table({"id": pa.array(list(r.values()), pa.int32()), "piece": pa.array(list(r), pa.binary())}))


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids`` through a join with the id-to-piece table.

    The table is bounded by the vocabulary (about 50,000 rows, under 2 MB), so it is broadcast. Ids are
    put back in order within a row key made before exploding, so repeated ``doc_id`` stay apart and no
    shuffle follows the explode. Empty and null lists give an empty text; an unknown id raises.
    """
    # written once, so that a recomputed task finds the same row keys
    keyed = materialize(encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")), "ids")
    keyed = keyed.repartition(shuffle_width(encoded.sparkSession), "row")
    each = keyed.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    table = pieces(encoded.sparkSession, tokenizer, folder).withColumnRenamed("id", "pid")
    known = each.join(F.broadcast(table), each.id == table.pid, "left")
    piece = F.when(F.col("id").isNull(), F.lit(b"")).when(F.col("piece").isNull(), F.raise_error(F.concat(F.lit("no piece has id "), F.col("id").cast("string")))).otherwise(F.col("piece"))
    whole = known.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("p"))
    return whole.select("doc_id", F.expr("decode(unhex(array_join(transform(p, x -> hex(x.piece)), '')), 'UTF-8')").alias("text"))


def canonical_source(source: Column) -> Column:
    """One spelling of a source: lower case, underscores, no blanks around it."""
    return F.translate(F.lower(F.trim(source)), "-", "_")


# --- mixing sources to target weights ------------------------------------------------------------

_LEVEL_BITS = 12
_TOP = 60  # bits of the document hash that are looked at


def _targets(targets: DataFrame, most: int = 10_000) -> list[dict]:
    rows = targets.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources in the target table")
    return [r.asDict() for r in rows if r["source"] is not None]


def thresholds(sized: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[list[dict], int]:
    """For each target source: whole copies of every text, and the hash below which a text is used once more.

    ``sized``: source, h (60-bit hash), tokens. Histograms of tokens by source and leading hash bits give
    the bucket in which the budget ends; only that bucket is cut finer, 12 bits at a time, until single
    texts remain. What reaches the driver is sources x 4,096 sums, whatever the number of documents.
    """
    want = _targets(targets)
    spark = sized.sparkSession
    if not want:
        return [], 0
    have = {r["source"]: (r["tokens"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    for w in want:
        w["tokens"], w["docs"] = have.get(w["source"], (0, 0))
        w["cap"] = max(0, w["cap"] or 0)
        w["share"] = w["share"] or 0.0
    bound = [w["tokens"] * w["cap"] / w["share"] for w in want if w["share"] > 0 and w["tokens"] * w["cap"] > 0]
    full = int(min(bound, default=0))
    total = full if total is None else min(total, full)
    for w in want:
        budget = round(total * w["share"]) if w["tokens"] else 0
        w["copies"] = min(w["cap"], budget // w["tokens"]) if w["tokens"] else 0
        w["rest"] = budget - w["copies"] * w["tokens"] if w["copies"] < w["cap"] else 0
        w["prefix"], w["below"], w["open"] = 0, 0, w["rest"] > 0
    level = 0
    while any(w["open"] for w in want) and (level + 1) * _LEVEL_BITS <= _TOP:
        shift = _TOP - (level + 1) * _LEVEL_BITS
        edge = spark.createDataFrame([(w["source"], w["prefix"]) for w in want if w["open"]], "source string, prefix long")
        part = sized.join(F.broadcast(edge), "source")  # as many rows as target sources
        if level:
            part = part.filter(F.shiftright("h", shift + _LEVEL_BITS) == F.col("prefix"))
        sums: dict[str, list] = {}
        for r in part.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect():
            sums.setdefault(r["source"], []).append((r["bucket"], r["tokens"], r["docs"]))
        for w in want:
            if not w["open"]:
                continue
            at = w["prefix"] << _LEVEL_BITS
            w["open"] = False
            w["below"] = (at + (1 << _LEVEL_BITS)) << shift
            for bucket, tokens, docs in sorted(sums.get(w["source"], [])):
                if tokens <= w["rest"]:
                    w["rest"] -= tokens
                    continue
                w["prefix"], w["below"], w["open"] = bucket, bucket << shift, docs > 1
                if docs == 1 and 2 * w["rest"] > tokens:  # the text on the border: in if that is nearer
                    w["below"] = (bucket + 1) << shift
                break
        level += 1
    return want, total


def sized_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, source, h, tokens`` of every document, written once and read by each pass."""
    counts = token_counts(docs.select("doc_id", "source", "text"), ["doc_id", "source"], tokenizer, folder)
    return materialize(
        counts.select("doc_id", canonical_source(F.col("source")).alias("source"), F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 64 - _TOP).alias("h"), "tokens"), "sized"
    )


def _plan(spark: SparkSession, want: list[dict]) -> DataFrame:
    return spark.createDataFrame(
        [(w["source"], float(w["share"]), int(w["cap"]), int(w["copies"]), int(w["below"])) for w in want],
        "source string, target_share double, max_repeats int, full_copies int, below long",
    )


def _used():
    return F.col("full_copies") + (F.col("h") < F.col("below")).cast("int")


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, source, tokens, copies``: the documents of the mixture and how often each is used.

    The total is the largest at which every source with texts can reach its share within its repeats
    (or ``total``, if smaller). Spellings of a source are one source; documents with a null source or one
    without target are not used; null and empty texts have no tokens and follow their source; a target
    without texts stays at 0 and does not bind the total. Copies are nested: a larger total only adds
    uses. Repeated rows have one hash and go in or out together.
    """
    sized = sized_documents(docs, tokenizer, folder)
    want, _ = thresholds(sized, targets, total)
    plan = _plan(docs.sparkSession, want)  # one row per target source
    return sized.join(F.broadcast(plan), "source").select("doc_id", "source", "tokens", _used().alias("copies")).filter("copies > 0")


def mixture_shares(docs: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row per target source: what it has, its target share, and the share its used tokens reach."""
    sized = sized_documents(docs, tokenizer, folder)
    want, _ = thresholds(sized, targets, total)
    plan = _plan(docs.sparkSession, want)
    got = (
        sized.join(F.broadcast(plan.select("source", "full_copies", "below")), "source")
        .groupBy("source")
        .agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * _used()).alias("used_tokens"), F.max(_used()).alias("most_copies"), F.sum((_used() > 0).cast("int")).alias("used_docs"))
    )
    whole = got.agg(F.sum("used_tokens").alias("all")).scalar()
    zero = F.lit(0).cast("long")
    return plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce("used_docs", zero).alias("used_docs"), F.coalesce("used_tokens", zero).alias("used_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("used_tokens") / whole, F.lit(0.0)).alias("reached_share"),
    )
