"""Texts cut off by field limits or mid-transfer.

Hidden limits: the length of every text is recomputed as characters, UTF-8 bytes and UTF-16 units, raw
and after entity escaping, JSON escaping and newline conversion. Texts are counted by source, measure and
length; a length that far more different texts have than its neighbours, most of them without an end, is
a limit. Where several measures explain the same texts, the strongest keeps them.

Endings: over the whole corpus, every place between two words is counted, by source and the last one or two
words (numbers and names by shape), as the end of an open line (one without a full stop) or not. A text
without an end whose last words hardly ever close such lines was cut; so was one that stops in a word seen
nowhere else, in an open code block, or exactly at a limit of its source. A mark put after a cut ("...") is taken
off first; where words often end with such a mark inside texts, it was put on purpose.

The texts are read once: one pass writes how each ends, its hash and its lengths, and the counts of places. All
that follows works on these. What an ending is worth is decided once per different ending, not per text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from webloom.runtime import materialize, spread


def canonical_source(source: Column) -> Column:
    """One spelling of a source: lower case, underscores, no blanks around it."""
    return F.translate(F.lower(F.trim(source)), "-", "_")


# --- lengths and limits -----------------------------------------------------------------------------

#: ways a store may have held a text, times the units it may have counted in
MEASURES = tuple(f"{way}_{unit}" for way in ("raw", "crlf", "lf", "entities", "entities_quotes", "json") for unit in ("chars", "utf8", "utf16"))


def lengths(text: str) -> list[int]:
    """Length of the text under each of ``MEASURES``."""
    count = text.count
    chars = len(text)
    utf8, utf16 = (chars, chars) if text.isascii() else (len(text.encode("utf-8", "surrogatepass")), len(text.encode("utf-16-le", "surrogatepass")) // 2)
    returns, lines, quotes = count("\r\n"), count("\n"), count('"')
    entities = 4 * count("&") + 3 * (count("<") + count(">"))
    extra = (0, lines - returns, -returns, entities, entities + 5 * quotes, quotes + count("\\") + lines + count("\r") + count("\t"))
    return [n + x for x in extra for n in (chars, utf8, utf16)]


def _code(measure: Column, length: Column) -> Column:
    """Measure and length in one number."""
    return F.shiftleft(measure.cast("long"), 32) + length


def _codes() -> Column:
    return F.transform("lens", lambda x, i: _code(i, x))


def _limits(texts: DataFrame, least: int, times: float, around: int, short: int) -> DataFrame:
    """Limits of different texts (source, open, last, lens): ``source, m, length, texts``."""
    each = texts.select("source", "open", "last", F.posexplode("lens").alias("m", "length"))
    last = F.when(F.col("length") <= short, F.col("last")).otherwise(-1)
    by = each.groupBy("source", "m", "length", last.alias("last")).agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("open"))
    by = materialize(by.groupBy("source", "m", "length").agg(F.sum("n").alias("n"), F.sum("open").alias("open"), F.max("n").alias("same")), "lengths")
    few = by.filter((F.col("n") >= least) & (F.col("open") * 2 > F.col("n")))
    # neighbours without a window: a candidate asks for the lengths around it
    near = few.select("source", "m", F.col("length").alias("at"), F.explode(F.sequence(F.col("length") - around, F.col("length") + around)).alias("length"))
    near = near.join(by.select("source", "m", "length", F.col("n").alias("k")), ["source", "m", "length"])
    beside = F.when(F.abs(F.col("length") - F.col("at")).between(1, 2), F.col("k"))
    near = near.groupBy("source", "m", F.col("at").alias("length")).agg(F.sum("k").alias("all"), F.coalesce(F.max(beside), F.lit(0)).alias("beside"))
    peak = few.join(near, ["source", "m", "length"])
    peak = peak.filter((F.col("length") > short) | ((F.col("n") >= 3 * F.col("beside")) & (F.col("same") * 2 <= F.col("n"))))
    peak = peak.filter(F.col("n") >= times * ((F.col("all") - F.col("n")) / (2 * around) + 0.5))
    name = F.element_at(F.array(*map(F.lit, MEASURES)), F.col("m") + 1)
    rank = F.struct("n", name.startswith("raw_").alias("raw"), name.endswith("_chars").alias("chars"), name.alias("measure"), "length", "m", _code(F.col("m"), F.col("length")).alias("code"))
    peaks = materialize(peak.groupBy("source").agg(F.collect_list(rank).alias("peaks")), "peaks")  # a row per source that has some
    mine = texts.join(peaks, "source").select("source", F.array_max(F.filter("peaks", lambda p: F.array_contains(_codes(), p["code"]))).alias("best"))
    kept = mine.filter("best is not null").groupBy("source", F.col("best.m").alias("m"), F.col("best.length").alias("length")).agg(F.count("*").alias("texts"))
    return kept.filter(F.col("texts") >= least)


def storage_limits(docs: DataFrame, least: int = 6, times: float = 5.0, around: int = 12, short: int = 100) -> DataFrame:
    """``source, measure, length, texts``: lengths at which a source's texts pile up without an end.

    A limit has at least ``least`` different texts, ``times`` the mean of the ``around`` lengths on either
    side, and no proper end in more than half of them. Short texts crowd at a few lengths by themselves, and those
    of one form have one length; so a limit of at most ``short`` also has three times the texts of each of the two lengths on
    either side, and most of its texts stop at different places of their last words: no length of the last word has more than half of them.
    ``docs``: source (canonical), text, ended. Repeated texts are one piece of evidence; null and empty ones are none.
    """

    def measure(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            cols = [b.column("source"), _signed([_hash(t) for t in texts]), pa.array([not e for e in b.column("ended").to_pylist()], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([_last(t) for t in texts], pa.int32()), pa.array([lengths(t) for t in texts], pa.list_(pa.int32()))], ["source", "h", "open", "last", "lens"])

    texts = docs.filter(F.length("text") > 0).select("source", "text", "ended").mapInArrow(measure, "source string, h long, open boolean, last int, lens array<int>").distinct()
    found = _limits(materialize(texts, "measured"), least, times, around, short)
    return found.select("source", F.element_at(F.array(*map(F.lit, MEASURES)), F.col("m") + 1).alias("measure"), "length", "texts")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def _last(text: str) -> int:
    """Length of the last word."""
    t = text.rstrip()
    return len(t.rsplit(None, 1)[-1]) if t else 0


# --- endings ----------------------------------------------------------------------------------------

_CLOSING = "”\"»“’')]›）」』*_"
_END = ".!?。！？"
_MARKS = ("...", "…", "[...]", "(...)", "[…]", "(…)")
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")
_EAST = re.compile(r"[぀-ヿ一-鿿]")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")


def _bare(word: str) -> str:
    return word.strip("“”\"'„«»()[]<>*_`‘’‚,;:.!?…¿¡")


def _shape(word: str) -> str:
    """A word as it is counted: numbers, names, addresses and East Asian runs by their kind, others as they are."""
    w = _bare(word)
    if not w:
        return word
    if _DIGITS.fullmatch(w):
        return "0"
    if "://" in w:
        return "URL"
    if _EAST.search(w):
        return "J" if len(w) > 1 else w
    if w[:1].isupper():
        return "X"
    return _DIGITS.sub("0", w)


_KINDS = ("0", "URL", "J", "X")


def _closes(token: str) -> bool:
    t = token.rstrip(_CLOSING)
    return t[-1:] in _END or t[-1:] == "…"


def _mark(token: str) -> str:
    return next((m for m in _MARKS if token.endswith(m)), "")


def _units(line: str) -> list[str]:
    """Words of a line; East Asian runs by character."""
    out = []
    for w in line.split():
        out += list(w) if _EAST.search(w) else [w]
    return out


def _before(lines: list[str], tokens: list[str]) -> str:
    """The raw word before the last one, across the line break where the last line has one word."""
    if len(tokens) > 1:
        return _DIGITS.sub("0", tokens[-2])
    return "\n" + (_DIGITS.sub("0", lines[-2].split()[-1]) if len(lines) > 1 else "")


class _Words(dict):
    """Word to its number in the tables of shapes and raw forms."""

    def __init__(self):
        super().__init__()
        self.shape_ids, self.raw_ids = {"^": 0}, {"": 0}
        self.shape, self.raw, self.closes, self.marked, self.kind = [], [], [], [], []

    def __missing__(self, word: str) -> int:
        shape = _shape(word)
        i = self[word] = len(self.shape)
        self.shape.append(self.shape_ids.setdefault(shape, len(self.shape_ids)))
        self.raw.append(self.raw_ids.setdefault(_DIGITS.sub("0", word), len(self.raw_ids)))
        self.closes.append(_closes(word))
        self.marked.append(_mark(word) != "")
        self.kind.append(shape in _KINDS)
        return i


PLACES = ("kind", "before", "word", "n", "ends")


class _Places:
    """Counts of the places after each word of the texts but their last, and of those that end a line without a full stop.

    Kinds: 2 by the last two words (of one line, none of them the end of a sentence), r by the raw word before a name or
    number (across the line break, if need be), m by a word with a mark of omission.
    """

    def __init__(self):
        self.words, self.sources = _Words(), {}
        self.clear()

    def clear(self) -> None:
        self.flat: list[str] = []
        self.line_sizes: list[int] = []
        self.text_lines: list[int] = []
        self.text_sources: list[int] = []

    def add(self, lines: list[list[str]], source: str) -> None:
        for units in lines:
            self.flat += units
            self.line_sizes.append(len(units))
        self.text_lines.append(len(lines))
        self.text_sources.append(self.sources.setdefault(source, len(self.sources)))

    def counted(self) -> tuple[list[pa.Array], int]:
        """Columns source and ``PLACES`` of what was added since the last time."""
        w = self.words
        ids = np.fromiter(map(w.__getitem__, self.flat), np.int64, len(self.flat))
        tables = [np.array(x) for x in (w.shape, w.raw, w.closes, w.marked, w.kind)] if len(ids) else [np.zeros(0, int)] * 5
        shape, raw, closes, marked, kind = (t[ids] for t in tables)
        closes, marked, kind = closes.astype(bool), marked.astype(bool), kind.astype(bool)
        sizes, per_text = np.array(self.line_sizes, np.int64), np.array(self.text_lines, np.int64)
        line_ends = np.cumsum(sizes)
        first, last, text_first, text_last = (np.zeros(len(ids), bool) for _ in range(4))
        last[line_ends - 1] = True
        first[line_ends - sizes] = True
        lines_before = np.cumsum(per_text)
        text_last[line_ends[lines_before - 1] - 1] = True
        text_first[(line_ends - sizes)[lines_before - per_text]] = True
        source = np.repeat(np.repeat(np.array(self.text_sources, np.int64), per_text), sizes)
        prev = lambda x: np.concatenate((x[:1], x[:-1]))
        before = np.where(first | prev(closes), 0, prev(shape))
        raw_before = np.where(text_first, 1, 2 * prev(raw) + first)  # odd: across a line break
        end = last & ~closes
        out: list[list] = [[], [], [], [], [], []]
        shapes, raws = pa.array(list(w.shape_ids), pa.string()), pa.array(list(w.raw_ids), pa.string())
        names = pa.array(list(self.sources), pa.string())
        rows = 0
        for what, keep, left, many in (("2", ~text_last, before, len(shapes)), ("r", ~text_last & kind, raw_before, 2 * len(raws)), ("m", ~text_last & marked, np.zeros_like(before), 1)):
            key, group = np.unique((source[keep] * many + left[keep]) * len(shapes) + shape[keep], return_inverse=True)
            n, ends = np.bincount(group, minlength=len(key)), np.bincount(group, end[keep], minlength=len(key))
            two, word = np.divmod(key, len(shapes))
            src, lft = np.divmod(two, many)
            if what == "2":
                words_before = shapes.take(pa.array(lft))
            elif what == "r":
                words_before = pc.binary_join_element_wise(pa.array(["", "\n"]).take(pa.array(lft & 1)), raws.take(pa.array(lft >> 1)), "")
            else:
                words_before = pa.array([""] * len(key), pa.string())
            for c, v in zip(out, (names.take(pa.array(src)), pa.array([what] * len(key), pa.string()), words_before, shapes.take(pa.array(word)), pa.array(n.astype(np.int64)), pa.array(ends.astype(np.int64)))):
                c.append(v)
            rows += len(key)
        self.clear()
        if len(w) > 200_000:
            self.words = _Words()
        return [pa.concat_arrays(c) for c in out], rows


_ENDING = ("state", "mark", "in_code", "before", "word", "raw_before", "final")
_NONE = ("none", "", False, "", "", "", "")


def ending(text: str) -> tuple:
    """How a text ends, by the fields of ``_ENDING``; state is 'end', 'open' or 'none' (nothing to judge)."""
    return _ending(text if text.isascii() else _INVISIBLE.sub("", text))


def _ending(text: str) -> tuple:
    t = text.rstrip()
    mark = _mark(t)
    if mark:
        t = t[: len(t) - len(mark)].rstrip()
    if not t:
        return _NONE
    in_code = "```" in t and t.count("```") % 2 == 1
    if not mark and not in_code and t.rstrip(_CLOSING)[-1:] in _END:
        return ("end", *_NONE[1:])
    lines = [x for x in t.rsplit("\n", 2) if x.strip()]  # the last two lines, or more than two if some are blank
    if len(lines) < 2:
        lines = [x for x in t.split("\n") if x.strip()]
    units, tokens = _units(lines[-1]), lines[-1].split()
    before = "^" if len(units) < 2 or _closes(units[-2]) else _shape(units[-2])
    return "open", mark, in_code, before, _shape(units[-1]), _before(lines, tokens), _shape(tokens[-1]) + mark


_DOC = ("row", "source", "h", *_ENDING, "last", "lens")
#: units (words) after which the places counted so far are handed on
_UNITS = 400_000


def _read(row_type: pa.DataType):
    """One pass over the texts: a row for each text, and rows with ``kind`` for the places."""
    doc_types = [row_type, pa.string(), pa.int64(), *(pa.bool_() if n == "in_code" else pa.string() for n in _ENDING), pa.int32(), pa.list_(pa.int32())]
    names = ["kind", *_DOC, "n", "ends"]
    types = [pa.string(), *doc_types, pa.int64(), pa.int64()]

    def batch(cols: dict, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[n] if n in cols else pa.nulls(size, t) for n, t in zip(names, types)], names)

    def of_places(places: _Places) -> pa.RecordBatch:
        cols, size = places.counted()
        return batch(dict(zip(("source", *PLACES), cols)), size)

    def run(batches):
        places = _Places()
        for b in batches:
            sources, hashes, ends, lasts, lens = b.column("source"), [], [], [], []
            for source, text in zip(sources.to_pylist(), b.column("text").to_pylist()):
                seen = text if text.isascii() else _INVISIBLE.sub("", text)
                lines = [_units(x) for x in seen.split("\n") if x and not x.isspace()]
                if lines:
                    places.add(lines, source)
                hashes.append(_hash(text))
                ends.append(_ending(seen))
                lasts.append(_last(text))
                lens.append(lengths(text))
                if len(places.flat) > _UNITS:
                    yield of_places(places)
            cols = {"row": b.column("row"), "source": sources, "h": _signed(hashes), "last": pa.array(lasts, pa.int32()), "lens": pa.array(lens, pa.list_(pa.int32()))}
            cols |= {n: pa.array([e[i] for e in ends], pa.bool_() if n == "in_code" else pa.string()) for i, n in enumerate(_ENDING)}
            yield batch(cols, b.num_rows)
        if places.flat:
            yield of_places(places)

    return run


def _read_once(named: DataFrame) -> DataFrame:
    row = named.schema["row"].dataType
    out = ", ".join(["kind string", f"row {row.simpleString()}", "source string", "h long", *(f"{n} {'boolean' if n == 'in_code' else 'string'}" for n in _ENDING), "last int", "lens array<int>", "n long", "ends long"])
    return materialize(spread(named.select("row", "source", "text")).mapInArrow(_read(to_arrow_type(row)), out), "endings")


def _with_null(by_source: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """A statistic (source, keys, n, ends) in which the texts without a source have that of all sources together, for the keys they want."""
    every = by_source.join(wanted.filter("source = ''").select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    return by_source.filter("source <> ''").unionByName(every.withColumn("source", F.lit("")))


def _no_source_too(by_source: DataFrame) -> DataFrame:
    """What holds for some source also holds for the texts without one."""
    return by_source.filter("source <> ''").unionByName(by_source.withColumn("source", F.lit("")))


_KEY = ("source", "before", "word", "raw_before", "final", "mark")


def _reasons(endings: DataFrame, places: DataFrame, size: DataFrame, least_lift: float, seen: int, custom: float) -> DataFrame:
    """``k, reason`` of the endings that show a cut. ``endings``: ``_KEY``, k (their hash) and finals, the different texts (not at a limit) with it."""
    two = materialize(places.filter("kind = '2'").groupBy("source", "before", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "places")
    one = materialize(two.groupBy("source", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "words")
    named = places.filter("kind = 'r'").groupBy("source", F.col("before").alias("raw_before"), F.col("word").alias("final")).agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    marks = places.filter("kind = 'm'").groupBy("source", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    anywhere = one.groupBy("word").agg(F.sum("n").alias("na"), F.sum("ends").alias("ea"))
    whole = one.groupBy("source").agg(F.sum("n").alias("places"), F.sum("ends").alias("open_lines"))
    all_ = one.agg(F.sum("n").alias("places"), F.sum("ends").alias("open_lines")).withColumn("source", F.lit(""))
    whole = whole.filter("source <> ''").unionByName(all_)

    def part(stat, n, e):
        return stat.withColumnsRenamed({"n": n, "ends": e})

    j = (
        endings.join(part(_with_null(two, endings, "before", "word"), "n2", "e2"), ["source", "before", "word"], "left")
        .join(part(_with_null(one, endings, "word"), "n1", "e1"), ["source", "word"], "left")
        .join(part(_with_null(marks, endings, "word"), "nm", "em"), ["source", "word"], "left")
        .join(part(_with_null(named, endings, "raw_before", "final"), "nr", "er"), ["source", "raw_before", "final"], "left")
        .join(anywhere, "word", "left")
        .join(whole, "source", "left")
        .join(size, "source", "left")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    # a word seen nowhere else, without a mark, may be one half: only a strong custom counts
    of_kind = F.col("final").isin(*_KINDS)
    times = F.when(F.col("n1").isNotNull() | (F.col("mark") != "") | of_kind, 1).otherwise(10)
    goes_on = F.when(of_kind, n("nr") - n("er")).otherwise(n("n2") - n("e2"))
    # how much likelier an open line of the source ends after these words than any place of it is after them
    rate = F.coalesce(F.col("open_lines") / F.col("places"), F.lit(0.0))
    lift = lambda e, k: (n(e) + rate / 2) / (F.col(k) + 0.5) / F.greatest(rate, F.lit(1e-9))
    share = F.when(rate == 0, F.when(n("n1") + n("na") > 0, 0.0)).when(n("n2") >= seen, lift("e2", "n2")).when(n("n1") >= seen, lift("e1", "n1")).when(n("na") > 0, F.when(n("ea") > 0, 1.0).otherwise(0.0))
    reason = F.when(F.col("mark") != "", F.when(n("nm") < 2, "mark")).when(share.isNull(), "word").when(share < least_lift, "ending")
    usual = (F.col("finals") >= F.greatest(F.lit(4), n("size") * custom * times)) & (F.col("finals") * 2 >= goes_on)
    j = materialize(j.select(*_KEY, "k", usual.alias("usual"), reason.alias("reason")), "reasons")
    customs = _no_source_too(j.filter("usual").select("source", "raw_before", "final")).distinct()
    return j.filter("reason is not null").join(customs, ["source", "raw_before", "final"], "left_anti").select("k", "reason")


def truncated(docs: DataFrame, id_column: str = "doc_id", least_lift: float = 0.25, seen: int = 6, custom: float = 0.0005) -> DataFrame:
    """``doc_id, source, reason`` of the texts that were cut, one row per row of ``docs``.

    ``docs``: id, text, source. Spellings of a source are one source; a null source is one of its own, judged by what all sources together show.
    Null, empty and blank texts are complete. Repeated texts and ids each count. Extra columns are ignored.
    ``reason``: 'limit' (no end, at a storage limit), 'code' (open code block), 'mark' (a mark of omission after
    words that carry none inside texts), 'word' (stops in a word seen nowhere else) or 'ending' (stops after words
    that hardly ever end an open line of the source: their share of such line ends is under ``least_lift`` of their
    share of all places). What at least ``custom`` of a source's different texts end with, and hardly ever go on
    after, is the custom of the source. Texts and endings are named by 64-bit hashes.
    """
    named = docs.select(F.col(id_column).alias("row"), F.coalesce(canonical_source(F.col("source")), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    read = _read_once(named.filter("text is not null and trim(text) <> ''"))
    places = read.filter("kind is not null").select("source", *PLACES)
    each = read.filter("kind is null").withColumn("k", F.xxhash64(*_KEY))
    texts = each.select("source", "h", "state", *_KEY[1:], "k", "last", "lens", (F.col("state") != "end").alias("open")).distinct()
    texts = materialize(texts, "texts")
    limits = _limits(texts, 6, 5.0, 12, 100).select("source", _code(F.col("m"), F.col("length")).alias("code"))
    limits = materialize(_no_source_too(limits).groupBy("source").agg(F.collect_set("code").alias("limits")), "limits")
    limited = F.coalesce(F.arrays_overlap(_codes(), F.col("limits")), F.lit(False))
    # texts at a limit are cut, whatever they end with
    finals = F.count_if(~limited).alias("finals")
    endings = materialize(texts.filter("state = 'open'").join(limits, "source", "left").groupBy(*_KEY, "k").agg(finals), "finals")
    size = each.groupBy("source").agg(F.count("*").alias("size"))
    reasons = _reasons(endings, places, size, least_lift, seen, custom)
    last = each.filter("state = 'open'").select("row", "source", "k", "in_code", "lens").join(limits, "source", "left").join(reasons, "k", "left")
    reason = F.when(limited, "limit").when(F.col("in_code"), "code").otherwise(F.col("reason"))
    out = last.select(F.col("row").alias(id_column), F.when(F.col("source") != "", F.col("source")).alias("source"), reason.alias("reason"))
    return out.filter("reason is not null")


def truncation_shares(docs: DataFrame) -> DataFrame:
    """Per source: documents, truncated documents and their share (null and blank texts count as complete)."""
    cut = truncated(docs).groupBy("source").agg(F.count("*").alias("truncated"))
    every = docs.select(canonical_source(F.col("source")).alias("source")).groupBy("source").agg(F.count("*").alias("docs"))
    n = F.coalesce("truncated", F.lit(0).cast("long"))
    return every.join(cut, every.source.eqNullSafe(cut.source), "left").select(every.source, "docs", n.alias("truncated"), (n / F.col("docs")).alias("share"))
