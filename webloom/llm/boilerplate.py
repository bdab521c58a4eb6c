"""The main body of a page: a linear-chain conditional random field over its DOM leaf blocks.

A page is a sequence of leaf blocks; each has features of its markup (element, ancestors, container, share
of link text, rules before it) and of its text (length, marks, leading words, whether it repeats the
title). The field is trained on pages whose markup declares the article (an article element, or a class
that names the post); inside it, blocks whose class or leading words declare them as bylines, share lines,
advertisements and the like are labelled as not main. Each training page is used in four forms - whole,
without anything that names a part of the page, the same with other elements for headings, items and
paragraphs, and as plain text - so that the field also decides on pages that declare nothing. Decoding is Viterbi, many pages side by side. A line belongs to the main body
if a block of it that has text there does.

Pages found to be template residue or error pages have no main body; both models are fitted from one scan
over the sampled rows, or given ready.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import residue
from webloom.llm.linear import ChainCRF, feature_id
from webloom.llm.page import Block, Page, parse
from webloom.runtime import spread

BITS = 18
#: class names that declare the body of a post
_BODY = frozenset(("post", "entry-content", "article-body", "post-content", "post-body", "entry", "story-body"))
_ASIDE = frozenset(("byline", "meta", "post-meta", "entry-meta", "share", "related", "breadcrumb", "crumbs", "advert", "comments", "replies", "reply", "consent", "cookie-bar", "newsletter"))
#: How lines that aren't part of the text begin, by language.
_NOT_MAIN = re.compile(
    r"(?:share this|share on|teilen|partager|compartir|compartilhar|compartilhe|поделиться|シェア|共有)\s*[:：]"
    r"|(?:read also|see also|related|lesen sie auch|à lire aussi|lea también|lee también|leia também|читайте также|あわせて読みたい|関連記事)\s*[:：]"
    r"|(?:advertisement|anzeige|publicité|publicidad|publicidade|реклама|広告|sponsored)\s*$"
    r"|(?:story|article) continues below|(?:der|dieser) artikel geht .{0,20}weiter|la suite (?:de l.article )?ci-dessous|sigue leyendo|continua após"
    r"|(?:by|von|par|por|автор\s*:|文\s*[:：])\s*\S[^.!?]{0,60}(?:\||\d+\s*\S*\s*(?:ago|ministes|минут|分前|minuten|minutes|minutos))"
    r"|文：.{0,20}前$",
    re.I,
)
_MARK = re.compile(r"^(?:[-*•‣·]|\d+[.)])\s")
_NAMED = re.compile(r"^[^\s:：]{2,24}(?: [^\s:：]{2,24})?[:：]\s")
_DIGIT = re.compile(r"\d+")
_EAST = re.compile("[぀-ヿ一-鿿]")
_STOP = re.compile(r"[.!?。！？](?:\s|$|[”\"»“’)])")
_CRUMB = re.compile(r" / | > ")
_PARTS_OF_TITLE = re.compile(r" [-|–—·] ")


def _bucket(n: int) -> int:
    return n if n < 4 else 4 if n < 6 else 5 if n < 9 else 6 if n < 14 else 7 if n < 22 else 8 if n < 40 else 9


class _Group(dict):
    """Key of a group of features to what is wanted of it, worked out once while it is kept."""

    def __init__(self, names, value):
        super().__init__()
        self.names, self.value = names, value

    def __missing__(self, key: tuple):
        if len(self) > 50_000:
            self.clear()
        got = self[key] = self.value(self.names(*key))
        return got


class _Features(dict):
    """Groups of features by key, and by text what a block says by itself: (features, size, leading mark, is a crumb trail, feature words).

    ``value`` makes of names what is wanted: their ids, or the sum of their weights. Blocks of menus and notices come
    again on many pages and are looked into once.
    """

    def __init__(self, value):
        super().__init__()
        self.text, self.place, self.position, self.parts, self.words, self.before, self.lead = (
            _Group(names, value) for names in (_of_text, _of_place, _of_position, _of_parts, _of_words, _of_words_before, _of_lead)
        )

    def __missing__(self, text: str) -> tuple:
        n = text.count(" ") + 1
        east = _EAST.search(text) is not None
        if east:
            n = max(n, len(text) // 3)
        size = _bucket(n)
        last = text[-1]
        end = last if last in ".?!:;,…。！？”\"»)|" else "0" if last.isdigit() else "A" if last.isupper() else "a"
        crumb = _CRUMB.search(text) is not None
        sep = ("|" in text) + 2 * ("·" in text) + 4 * crumb + 8 * ("©" in text)
        lead = "m" if _MARK.match(text) else "n" if _NAMED.match(text) else "d" if text[0].isdigit() else "q" if text[0] in "“\"«„「" else "u" if text[0].isupper() else "l"
        f = self.text[size, end, min(len(_STOP.findall(text)), 4), sep, lead]
        low = text.lower()
        cut = low.find(":", 0, 30)
        if cut < 0:
            cut = low.find("：", 0, 30)
        if n <= 14:
            words = tuple(_DIGIT.sub("0", low).split())
            first, second, final = words[0], words[1] if len(words) > 1 else "", words[-1]
            f = f + self.words[words]
        else:
            words = ()
            first, second = (low.split(None, 2) + [""])[:2]
            first, second, final = (_DIGIT.sub("0", x) for x in (first, second, low.rsplit(None, 1)[-1]))
        if east:  # runs without blanks: what they begin and end with
            first, second, final = first[:12], second[:12], final[-12:]
        f = f + self.lead[first, second, final, _DIGIT.sub("0", low[:cut] if cut > 0 else low[:6])]
        got = f, size, lead, crumb, words
        if len(text) < 120:
            if len(self) > 100_000:
                self.clear()
            self[text] = got
        return got


def _ids(names: list[str]) -> list[int]:
    return [feature_id(n, BITS) for n in names]


def _sums(w: np.ndarray):
    return lambda names: float(w[_ids(names)].sum()) if names else 0.0


def _of_text(size, end, stops, sep, lead):
    return ["bias", f"s{size}", f"e{end}", f"s{size}e{end}", f"st{stops}", f"sep{sep}", f"ld{lead}s{size}"]


def _of_place(tag, inline, link, size, lead, code, flat, same, crumb, where, hold, before, gap, rules):
    out = [
        f"l{link}s{size}", f"c{code:d}", f"fl{flat}s{size}ld{lead}", f"sm{same}{crumb:d}w{where}", f"w{where}s{size}", f"t{tag}", f"t{tag}l{link}s{size}",
        f"h{hold}", f"h{hold}w{where}", f"bt{before}>{tag}", f"g{gap:d}", f"in{inline}", f"in{inline}t{tag}s{size}",
    ]
    return [*out, f"r{rules}"] if rules >= 0 else out


def _of_position(decile, from_start, from_end):
    return [f"p{decile}", f"e:p{from_start}" if from_start >= 0 else f"e:q{from_end}" if from_end >= 0 else "e:m"]


def _of_parts(around, tag):
    return [*(f"a:{a}" for a in around), *(["ac:" + tag.split(".", 1)[1]] if "." in tag else [])]


def _of_words(*words):
    return ["x:" + w for w in words]


def _of_words_before(*words):
    return ["px:" + w for w in words]


def _of_lead(first, second, last, head):
    return [f"f:{first} {second}", f"f1:{first}", f"z1:{last}", f"pc:{head}"]


def _features(kind: str, title: str, blocks: list[Block], named: bool, known: _Features) -> list:
    """Features of each block as ``known`` gives them; without ``named``, nothing that names a part of the page is used."""
    place, position, parts, after = known.place, known.position, known.parts, known.before
    weight: dict[int, int] = {}
    for x in blocks:
        if x.linked < 0.5:
            weight[x.holder] = weight.get(x.holder, 0) + len(x.text)
    most = max(weight.values(), default=1)
    heads: dict[str, set] = {}  # what a headline may begin with, by its beginning
    for h in (title, *_PARTS_OF_TITLE.split(title)):
        if len(h) >= 12:
            heads.setdefault(h[:12], set()).add(h)
    out = []
    n_blocks = len(blocks)
    flat = int(kind != "html")
    before, headline, last_line = "^", 0, 0
    words_before: tuple = ()
    for k, (at, text, _, tag, inline, around, holder, linked, code, rules) in enumerate(blocks):
        f, size, lead, crumb, mine = known[text]
        link = 0 if linked == 0 else 1 if linked < 0.5 else 2 if linked < 0.95 else 3
        same = 0
        if heads:
            for h in heads.get(text[:12], ()):
                if text.startswith(h) or h.startswith(text):
                    same = 1
                    break
        if crumb:
            tail = _CRUMB.split(text)[-1].strip()
            if len(tail) >= 12:
                like = heads.setdefault(tail[:12], set())
                same = same or int(any(h.startswith(tail) for h in like))
                like.add(tail)
        elif same and not headline:
            headline = k + 1
        where = 0 if not headline else 1 if headline == k + 1 else 2 if k + 1 - headline < 3 else 3
        share = weight.get(holder, 0) / most
        hold = 0 if flat else 4 if share > 0.999 else 3 if share > 0.5 else 2 if share > 0.1 else 1
        if named:
            f = f + parts[around, tag]
        elif flat:
            tag, rules = "flat", -1
        else:
            tag = tag.split(".")[0]
        f = f + place[tag, inline, link, size, lead, code, flat, same, crumb, where, hold, before, at[0] > last_line + 1, rules if rules < 3 else 3]
        f = f + position[10 * k // n_blocks, k if k < 4 else -1, n_blocks - k if n_blocks - k < 5 else -1]
        if words_before and len(words_before) <= 4:
            f = f + after[words_before]
        words_before = mine
        before, last_line = tag, at[-1]
        out.append(f)
    return out


_known_ids = _Features(_ids)


def teacher(page: Page) -> list[int] | None:
    """Labels of a page whose markup declares its article; None where it declares none."""
    labels, any_main = [], False
    for x in page.blocks:
        inside = "article" in x.around or not _BODY.isdisjoint(x.around)
        main = inside and _ASIDE.isdisjoint(x.around) and x.tag.split(".")[-1] not in _ASIDE and not _NOT_MAIN.match(x.text)
        any_main |= main
        labels.append(int(main))
    return labels if any_main else None


def _as_plain(page: Page, labels: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The page as a text taken from it: menus joined into one line or not, marks before list items, no markup."""
    sep = rng.choice((" | ", " > ", " · ", " ", None))
    mark, related = rng.choice(("* ", "- ", "• ", "")), rng.choice(("- ", "* ", ""))
    blocks, out, menu = [], [], []

    def add(text, label, code=False):
        blocks.append(Block((len(blocks) + 1,), text, text, "text", "", (), 0, 0.0, code, 0))
        out.append(label)

    def flush():
        if menu:
            for t in [sep.join(menu)] if sep else menu:
                add(t, 0)
            menu.clear()

    for x, y in zip(page.blocks, labels):
        texts = [t for t in map(str.strip, x.text.split("\n")) if t]
        if not y and x.linked > 0.9 and all(len(t.split()) <= 4 for t in texts):
            menu += texts
            continue
        flush()
        if "noscript" in x.around and rng.random() < 0.5:
            continue
        lead = mark if y and x.tag.split(".")[0] == "li" else related if not y and x.linked > 0.9 else ""
        for t in texts:
            add(lead + t, y, x.code)
            lead = ""
    flush()
    return blocks, out


def _reworked(blocks: list[Block], rng: random.Random) -> list[Block]:
    """The page as one that has no elements for headings and items."""
    heading, heading_inline = rng.choice((("p", "b"), ("div", ""), ("", "font"), ("", "b"), ("p", "font")))
    item, mark = rng.choice(("p", "div", "")), rng.choice(("- ", "* ", "• ", ""))
    paragraph = rng.choice(("p", "p", "div", ""))
    out = []
    for x in blocks:
        tag = x.tag.split(".")[0]
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            x = x._replace(tag=heading, inline=heading_inline or x.inline)
        elif tag in ("li", "dd", "dt"):
            x = x._replace(tag=item, text=x.text if x.linked > 0.5 else mark + x.text)
        elif tag == "p":
            x = x._replace(tag=paragraph)
        out.append(x)
    return out


#: rows that teach both models: those of ``residue.SAMPLE``, and with kinds from 2 the forms of a page that declares its article
SAMPLE = residue.SAMPLE + ", labels array<byte>"


def _forms(page: Page, key: int) -> Iterator[tuple]:
    labels = teacher(page) if page.kind == "html" else None
    if labels is None:
        return
    rng = random.Random(key ^ len(page.blocks))
    plain, plain_labels = _as_plain(page, labels, rng)
    for kind, feats, y in (
        (2, _features("html", page.title, page.blocks, True, _known_ids), labels),
        (3, _features("html", page.title, page.blocks, False, _known_ids), labels),
        (4, _features("text", "", plain, False, _known_ids), plain_labels),
        (5, _features("html", page.title, _reworked(page.blocks, rng), False, _known_ids), labels),
    ):
        yield kind, key, 0, np.concatenate([np.array(x, np.int32) for x in feats]), [], [len(x) for x in feats], np.array(y, np.int8)


def _training(for_field: int, for_residue: bool):
    """Sampled pages as rows of ``SAMPLE``; those with a rank below ``for_field`` teach the field."""

    def run(batches):
        phrases = residue.Phrases.without()
        none = np.zeros(0, np.int8)
        for b in batches:
            rows = []
            for key, rank, status, body in zip(*(b.column(c).to_pylist() for c in ("host_key", "rank", "status", "body"))):
                page = parse(body.decode("utf-8", "replace"))
                if for_residue:
                    rows += [(*r, none) for r in residue.training_rows(page, key, status, phrases)]
                if rank < for_field:
                    rows += _forms(page, key)
            t = residue.as_batch(rows)
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array([r[6] for r in rows], pa.list_(pa.int8()))], [*t.schema.names, "labels"])

    return run


def _stack(t: pa.Table):
    flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    lengths = np.array([len(x) for x in t.column("labels").combine_chunks()], np.int64) if len(t) else np.zeros(0, np.int64)
    return flat("ids").astype(np.int64), np.concatenate(([0], np.cumsum(flat("run_lengths").astype(np.int64)))), lengths, flat("labels").astype(float)


def _sampled(responses: DataFrame, pages: int, residue_rows: int) -> pa.Table:
    """One scan for both models: about ``residue_rows`` sampled rows, of which about ``pages`` teach the field."""
    s, step = residue.sample_pages(responses, max(pages, residue_rows))
    return spread(s).mapInArrow(_training(max(1, int(pages * step)), residue_rows > 0), SAMPLE).toArrow()


def _field(t: pa.Table, held_out: int = 0) -> ChainCRF | None:
    forms = pa.array((t.column("host_key").to_numpy() % 5 >= held_out) & (t.column("kind").to_numpy() >= 2))
    t = t.filter(forms)
    return ChainCRF(BITS).fit(*_stack(t)) if len(t) else None


class MainBodyModel:
    """A fitted field (None where nothing declared an article) and the classifiers of residue pages."""

    def __init__(self, crf: ChainCRF | None, residue_model: residue.ResidueModel):
        self.crf, self.residue = crf, residue_model

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as two tables of one row in the session's file system."""
        if self.crf is None:
            raise ValueError("no page declared its article: there is nothing to store")
        row = (self.crf.w.astype(np.float32).tobytes(), float(self.crf.start), self.crf.trans.ravel().tolist())
        spark.createDataFrame([row], "w binary, start double, trans array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/field")
        self.residue.save(spark, f"{path}/residue")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MainBodyModel:
        r = spark.read.parquet(f"{path}/field").first()
        crf = ChainCRF(BITS)
        crf.w, crf.start, crf.trans = np.frombuffer(r.w, np.float32), r.start, np.array(r.trans).reshape(2, 2)
        return cls(crf, residue.ResidueModel.load(spark, f"{path}/residue"))


def fit(responses: DataFrame, most: int = 2_000, residue_rows: int = 20_000) -> MainBodyModel:
    """Both models from one scan: the field from about ``most`` sampled rows (those that declare their article, four forms each)."""
    t = _sampled(responses, most, residue_rows)
    crf = _field(t)
    if crf is not None:
        crf.w = crf.w.astype(np.float32)
    return MainBodyModel(crf, residue.ResidueModel.fitted(t))


def label_pages(crf: ChainCRF, pages: list[Page], known: _Features) -> list[np.ndarray]:
    """Labels of the blocks of each page. ``known`` keeps the weights of feature groups between calls."""
    lengths = np.array([len(p.blocks) for p in pages], np.int64)
    e = np.array([v for p in pages for v in _features(p.kind, p.title, p.blocks, p.kind == "html", known)])
    return np.split(crf.viterbi(e, lengths), np.cumsum(lengths)[:-1])


def _decode(shared):
    def run(batches):
        model = shared.value
        known = None if model.crf is None else _Features(_sums(model.crf.w))
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                ids, pages = [], []
                for i, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    p = parse(body.decode("utf-8", "replace"))
                    if p.blocks and not model.residue.is_residue(p):
                        ids.append(i)
                        pages.append(p)
                if pages and known is None:
                    raise ValueError("no sampled page declares its article (an article element, or a class that names the post): give a model fitted elsewhere")
                rid, line = [], []
                for i, p, y in zip(ids, pages, label_pages(model.crf, pages, known)) if pages else ():
                    at = sorted({n for x, v in zip(p.blocks, y) if v for n in x.at})
                    rid += [i] * len(at)
                    line += at
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(line, pa.int32())], ["response_id", "line_no"])

    return run


def main_lines(responses: DataFrame, most: int = 2_000, residue_rows: int = 20_000, model: MainBodyModel | None = None) -> DataFrame:
    """``response_id, line_no`` of every line (from 1, split at line feeds) of the main body of each page.

    A stored ``model`` saves the fit. Null, empty and blank bodies and residue pages have none. Rows that repeat an id
    repeat its lines. Extra columns are ignored; an empty table gives an empty result. Where there are pages to decide on
    and none of the sample taught the field, the query raises.
    """
    shared = responses.sparkSession.sparkContext.broadcast(model or fit(responses, most, residue_rows))  # three weight vectors of 2**18 floats, 3 MB
    rows = spread(responses.filter(F.octet_length("body") > 0).select(F.col("response_id").cast("long"), "body"))
    return rows.mapInArrow(_decode(shared), "response_id long, line_no int")


def validation(responses: DataFrame, most: int = 2_000) -> DataFrame:
    """Agreement with the declared labels on unseen hosts, by form of the page."""
    t = _sampled(responses, most, 0)
    crf = _field(t, held_out=1) or ChainCRF(BITS)
    rows = []
    for kind, name in ((2, "declared"), (3, "undeclared"), (4, "plain"), (5, "reworked")):
        part = t.filter(pa.array((t.column("host_key").to_numpy() % 5 == 0) & (t.column("kind").to_numpy() == kind)))
        index, offsets, lengths, y = _stack(part)
        got = crf.viterbi(crf.emissions(index, offsets), lengths) if len(lengths) else np.zeros(0)
        tp = int(((got == 1) & (y == 1)).sum())
        rows.append((name, len(lengths), len(y), tp / max(1, int((got == 1).sum())), tp / max(1, int((y == 1).sum()))))
    return responses.sparkSession.createDataFrame(rows, "form string, pages long, blocks long, precision double, recall double")
