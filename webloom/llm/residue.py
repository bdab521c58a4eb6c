"""Template residue and error-page text: regularized linear classifiers over hashed n-grams, length and title.

Two models, both fitted on a bounded sample of weakly labelled rows:

* pages - words and word pairs of the text outside links, words of the title, length. Weak labels: texts
  dense with phrases of error pages, filler and script demands are positive, as are short texts stored
  under an error status if a model fitted without them agrees (sound pages come under such statuses, too;
  the others are left out); the rest is negative. A phrase in a long article is no label, so articles
  that speak of errors teach the model that such words alone mean little.
* expressions - runs like ``{{name}}`` or ``[Insert price here]``, described by the n-grams of their shape.
  Weak labels: the syntax of common template languages.

Whether a host is held out is decided by its hash, so ``validation`` measures on hosts never seen; it also
leaves out a part of the phrases, and of the template languages, from labelling, and measures on what only they name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.linear import feature_id, fit_logistic
from webloom.llm.page import Page, parse
from webloom.runtime import spread

BITS = 18

#: Phrases of error pages and of demands for scripts, by language.
_ERRORS = (
    "not found", "access denied", "forbidden", "bad gateway", "service unavailable", "internal server error", "gateway timeout", "fatal error", r"traceback \(most recent",
    r"uncaught \w*error", "mysql_", "database connection", "session expired", "has timed out", "no longer exists", "too many requests", "something went wrong",
    "region blocked", "not available in your country", "item is gone", "has been removed by", "can't find that", "page not found", r"error code \d", "server took too long",
    "seite nicht gefunden", "zugriff verweigert", "interner fehler", "ein fehler aufgetreten", "nicht verfügbar", "wartungsarbeiten",
    "page introuvable", "accès refusé", "erreur interne", "une erreur est survenue", "service indisponible",
    "página no encontrada", "acceso denegado", "error interno", "ha producido un error", "servicio no disponible",
    "página não encontrada", "acesso negado", "erro interno", "ocorreu um erro", "serviço indisponível",
    "страница не найдена", "доступ запрещ[её]н", "внутренняя ошибка", "произошла ошибка", "сервис недоступен", "не найдена",
    "ページが見つかりません", "アクセスが拒否", "エラーが発生", "サーバーエラー", "メンテナンス",
    "check your browser", "verify you are human", "javascript", "scripting switched", "scripts must", "needs scripts", "allow scripts", "turn it on and reload",
    "skripte", "exécution de scripts", "activez", "habilite", "active os scripts", "ative o", "нужны скрипты", "включите", "スクリプト",
)
#: Words and phrases of filler text.
_FILLER = (
    "lorem ipsum", "dolor sit amet", "blindtext", "texto de ejemplo", "texto de exemplo", "faux texte", "texte d.exemple", "texte de démonstration", "asdf", "blah blah", "sample paragraph", "sample text", "headline here",
    "short tagline", "short description of the product", "this is your first post", "edit this block", "write copy for", "text goes here", "test test", "テキストを入力", "ダミー", "здесь будет текст", "образец абзаца",
    "consectetur", "adipiscing", "excepteur", "cupidatat", "reprehenderit", "exercitation", "ullamco", "commodo", "aliquip",
)
#: Notices that a page works better with scripts, which stand beside content.
_SOFT = re.compile(r"some features of this site work better[^.]*\.|einige funktionen[^.]*\.|certaines fonctions[^.]*\.|algunas funciones[^.]*\.|algumas funções[^.]*\.|некоторые функции[^.]*\.|一部の機能[^。]*。")


class Phrases(NamedTuple):
    """What labels a text. ``errors`` count in short texts only."""

    filler: re.Pattern
    errors: re.Pattern
    left_out: re.Pattern | None  # phrases that label nothing, to measure on

    @classmethod
    def without(cls, share: int = 0) -> Phrases:
        """All phrases, or all but those whose hash is in the ``share`` first fifths."""
        out = lambda p: xxhash.xxh3_64_intdigest(p) % 5 < share
        kept = [re.compile("|".join(p for p in ps if not out(p))) for ps in (_FILLER, _ERRORS)]
        gone = [p for p in (*_FILLER, *_ERRORS) if out(p)]
        return cls(*kept, re.compile("|".join(gone)) if gone else None)


#: what may be an expression of a template, in any syntax
_EXPRESSION = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^\n]+?%\}|[$#]\{[^{}\n]+\}|\{[^{}\n]+\}|<%[^\n]+?%>|<[^<>\n]{2,}>|\[\[?[^\[\]\n]+\]?\]"
    r"|%\([^()\n]+\)[a-z]|%[^\s%]{2,}%|@@[^@\n]+@@|\*\|[^|\n]+\|\*|__[^\W_](?:[^\s]*[^\W_])?__|\$[A-Za-z][\w.]*\$"
)
#: The syntax of common template languages, and of text that stands in for a value.
_SYNTAX = (
    r"\{\{\s*[\w.| ]+\}\}", r"\{%\s*\w[^\n]*%\}", r"[$#]\{[\w.]+\}", r"\{\$?[A-Za-z_][\w.]*\}", r"<%=?[^\n]+%>", r"\[\[[\w. ]+\]\]", r"\[(?:insert|your|enter|add)\b[^\]]*\]", r"\[[^\]]*goes here\]",
    r"<(?:your|insert|enter)\b[^>]*>", r"%\([\w ]+\)[sdf]", r"%[A-Z][A-Z_]*%", r"@@\w+@@", r"\*\|\w+\|\*", r"__[A-Z][A-Z_]*__", r"\$[A-Z]\w*\$",
)
_IS_SYNTAX = re.compile("|".join(_SYNTAX), re.I)
#: languages left out of labelling when ``validation`` measures on unseen ones
_UNSEEN_SYNTAX = re.compile(r"@@\w+@@|\[[^\]]*goes here\]|%\([\w ]+\)[sdf]", re.I)

_WORD = re.compile(r"\w+", re.U)
_DIGIT = re.compile(r"\d+")
_EAST = re.compile("[぀-ヿ一-鿿]")


def expressions(page: Page) -> list[str]:
    """Candidate expressions outside code."""
    out = []
    for x in page.blocks:
        t = x.bare
        if "{" in t or "[" in t or "<" in t or "%" in t or "@@" in t or "*|" in t or "__" in t or "$" in t:
            out += _EXPRESSION.findall(t)
    return out


def expression_features(e: str) -> list[int]:
    """N-grams of the shape, and the words of longer expressions."""
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[^\x00-\x7f]", "u", _DIGIT.sub("0", e))))
    s = f"^{shape}$"
    grams = {s[i : i + n] for n in (2, 3, 4, 5) for i in range(len(s) - n + 1)}
    grams |= {"w:" + w for w in re.findall(r"[a-z]+", e.lower()) if w in ("insert", "here", "goes", "your", "enter", "block")}
    grams.add(f"shape:{shape}")
    return [feature_id("x:" + g, BITS) for g in grams]


def _tokens(text: str) -> list[str]:
    if _EAST.search(text):
        out = []
        for w in _WORD.findall(text):
            if _EAST.search(w):
                out += [w[i : i + 2] for i in range(0, max(1, len(w) - 1))]
            else:
                out.append(w)
        return out
    return _WORD.findall(text)


def page_text(page: Page) -> list[str]:
    """Blocks outside links and code. What stands in a footer, menu or side block stays: short pages are mostly that."""
    return [x.bare for x in page.blocks if x.linked < 0.6 and x.bare and "noscript" not in x.around]


class _WordIds(dict):
    """Blank-separated run to the feature ids of its words, looked into once while it is kept."""

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = tuple(xxhash.xxh3_64_intdigest("u:" + w) & ((1 << BITS) - 1) for w in _tokens(_DIGIT.sub("0", run)))
        if len(run) < 40 and not _EAST.search(run):
            if len(self) > 200_000:
                self.clear()
            self[run] = ids
        return ids


_word_ids = _WordIds()


def _words_and_pairs(text: str) -> tuple[np.ndarray, np.ndarray]:
    uni = np.array(list(chain.from_iterable(map(_word_ids.__getitem__, text.lower().split()))), np.int64)
    pair = (uni[:-1] * 1_000_003 + uni[1:] * 31 + 7) & ((1 << BITS) - 1)
    return uni, pair


def _extra(page: Page, n: int) -> tuple[list[int], list[int], float]:
    """Features of the title and of the length, and the weight of a word or pair.

    The square root keeps a few telling words visible in a page of some sixty, but not in an article of five hundred.
    """
    title = [feature_id("t:" + w, BITS) for w in _tokens(_DIGIT.sub("0", page.title.lower()))]
    size = [feature_id(f"n:{min(int(np.log2(n + 1) * 2), 24)}", BITS), feature_id("kind:" + page.kind, BITS)]
    return title, size, 1.0 / np.sqrt(max(n, 1))


def page_features(page: Page) -> tuple[np.ndarray, list[float], list[int], int, str]:
    """(feature ids, run values, run lengths, words, text): words and pairs share their weight by the length of the text, the title has its own share."""
    text = "\n".join(page_text(page))
    uni, pair = _words_and_pairs(text)
    title, size, share = _extra(page, len(uni))
    ids = np.concatenate((uni, pair, np.array(title + size, np.int64)))
    return ids, [share, 1.0 / max(4, len(title)), 1.0], [len(uni) + len(pair), len(title), len(size)], len(uni), text


def weak_label(status: int | None, words: int, text: str, phrases: Phrases) -> int:
    """1, 0, 2 for rows of which only the status speaks, 3 for those of which only phrases left out of labelling do."""
    low = text.lower()
    sure = _SOFT.sub(" ", low) if words < 160 else ""
    hits = len(phrases.filler.findall(low)) + len(phrases.errors.findall(sure))
    if hits and hits * 80 >= words:
        return 1
    if phrases.left_out is not None and (unseen := len(phrases.left_out.findall(sure or low))) and unseen * 80 >= words:
        return 3
    if status is not None and status >= 400 and words < 60 and not hits:
        return 2
    return 0


SAMPLE = "kind int, host_key long, y int, ids array<int>, run_values array<float>, run_lengths array<int>"


def training_rows(page: Page, key: int, status: int | None, phrases: Phrases) -> Iterator[tuple]:
    """Rows of ``SAMPLE``: kind 0 the page, kind 1 its expressions."""
    ids, values, lengths, n, text = page_features(page)
    if not n:
        return
    y = weak_label(status, n, text, phrases)
    if y or n < 150 or key % 6 == 0:
        yield 0, key, y, ids, values, lengths
    for e in expressions(page):
        f = expression_features(e)
        y = 3 if phrases.left_out is not None and _UNSEEN_SYNTAX.fullmatch(e) else int(_IS_SYNTAX.fullmatch(e) is not None)
        yield 1, key, y, np.array(f), [1.0 / np.sqrt(len(f))], [len(f)]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.int32()))
    cols = [[r[k] for r in rows] for k in range(len(kinds))]
    cols[3] = [x.astype(np.int32) for x in cols[3]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["kind", "host_key", "y", "ids", "run_values", "run_lengths"])


def _sample(phrases: Phrases):
    def run(batches):
        for b in batches:
            keyed = zip(b.column("host_key").to_pylist(), b.column("status").to_pylist(), b.column("body").to_pylist())
            yield as_batch([r for key, status, body in keyed for r in training_rows(parse(body.decode("utf-8", "replace")), key, status, phrases)])

    return run


def sample_pages(responses: DataFrame, most: int) -> tuple[DataFrame, float]:
    """About ``most`` rows with a body, chosen by the hash of their id: the same rows every time, whatever the partitions.

    Also gives the step of ``rank``: the rows with a rank below n * step are about n rows of all.
    """
    n = max(1, responses.count())
    step = (1 << 40) / max(n, 1)
    rank = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "response_id"), 24)
    rows = responses.filter(F.octet_length("body") > 0).withColumn("rank", rank).filter(F.col("rank") < int(most * step))
    host = F.regexp_extract(F.lower("url"), r"^\s*[a-z]+://(?:[^/@]*@)?([^/:?#\s]*)", 1)
    return rows.select("response_id", "status", "body", "rank", F.shiftrightunsigned(F.xxhash64(F.coalesce(host, F.lit(""))), 1).alias("host_key")), step


def _rows_of(t: pa.Table, keep: np.ndarray):
    t = t.filter(pa.array(keep))
    flat = lambda c, kind: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    lengths = np.array([len(x) for x in t.column("ids").combine_chunks()], np.int64)
    return flat("ids", np.int64), np.repeat(flat("run_values", float), flat("run_lengths", np.int64)), np.concatenate(([0], np.cumsum(lengths))), t.column("y").to_numpy().astype(float)


def _part(ids, vals, offsets, y, keep: np.ndarray):
    sizes = np.diff(offsets)
    inside = np.repeat(keep, sizes)
    return ids[inside], vals[inside], np.concatenate(([0], np.cumsum(sizes[keep]))), y[keep]


def settled(ids, vals, offsets, y):
    """The rows with the labels 2 settled: positive where a model fitted on the other half of them (as positives) and on all labelled rows agrees, else left out."""
    unsure = np.flatnonzero(y == 2)
    if not len(unsure):
        return ids, vals, offsets, y
    sums = np.add.reduceat(ids, offsets[:-1])
    # rows of one wording are neighbours in this order, so each half can learn from the other
    unsure = unsure[np.lexsort((sums[unsure], np.diff(offsets)[unsure]))]
    label = np.where(y == 2, -1.0, y)
    for mine in (unsure[::2], unsure[1::2]):
        use = np.ones(len(y), bool)
        use[mine] = False
        w, bias = fit_logistic(*_part(ids, vals, offsets, np.minimum(y, 1), use), bits=BITS)
        z = np.add.reduceat(w[ids] * vals, offsets[:-1]) + bias
        label[mine[z[mine] > 0]] = 1
    return _part(ids, vals, offsets, label, label >= 0)


class ResidueModel:
    """Weights of the two classifiers."""

    def __init__(self, pages, page_bias, expr, expr_bias):
        self.pages, self.page_bias, self.expr, self.expr_bias = pages, page_bias, expr, expr_bias
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def page_score(self, page: Page) -> float:
        uni, pair = _words_and_pairs("\n".join(page_text(page)))
        if not len(uni):
            return -1.0
        title, size, share = _extra(page, len(uni))
        w = self.pages
        score = (float(w[uni].sum()) + float(w[pair].sum())) * share + float(w[size].sum()) + self.page_bias
        return score + float(w[title].sum()) / max(4, len(title)) if title else score

    def expression_score(self, e: str) -> float:
        got = self._known.get(e)
        if got is None:
            if len(self._known) > 100_000:
                self._known.clear()
            f = expression_features(e)
            got = self._known[e] = float(self.expr[f].sum() / np.sqrt(len(f)) + self.expr_bias)
        return got

    def is_residue(self, page: Page) -> bool:
        return self.page_score(page) > 0 or any(self.expression_score(e) > 0 for e in expressions(page))

    @classmethod
    def fitted(cls, t: pa.Table, held_out: int = 0) -> ResidueModel:
        """From rows of ``SAMPLE``; hosts with key % 5 < ``held_out`` and labels 3 teach nothing."""
        kind, host, y = (t.column(c).to_numpy() for c in ("kind", "host_key", "y"))
        train = (host % 5 >= held_out) & (y < 3)
        # float32 weights: a megabyte each on their way to the workers
        pw, pb = fit_logistic(*settled(*_rows_of(t, train & (kind == 0))), bits=BITS)
        ew, eb = fit_logistic(*_rows_of(t, train & (kind == 1)), bits=BITS)
        if not (train & (kind == 0)).any():
            pb = -1.0
        if not (train & (kind == 1)).any():
            eb = -1.0
        return cls(pw.astype(np.float32), pb, ew.astype(np.float32), eb)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as a table of one row in the session's file system."""
        row = (self.pages.tobytes(), float(self.page_bias), self.expr.tobytes(), float(self.expr_bias))
        spark.createDataFrame([row], "pages binary, page_bias double, expr binary, expr_bias double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ResidueModel:
        r = spark.read.parquet(path).first()
        return cls(np.frombuffer(r.pages, np.float32), r.page_bias, np.frombuffer(r.expr, np.float32), r.expr_bias)


def fit(responses: DataFrame, most: int = 20_000, held_out: int = 0, phrases: Phrases | None = None) -> tuple[ResidueModel, pa.Table]:
    """Fits both classifiers on at most about ``most`` sampled rows; hosts with key % 5 < ``held_out`` are left out.

    What reaches the driver is the sample's labelled feature lists: about 12 MB at the default bound, whatever the table.
    Without a body in the sample nothing is residue.
    """
    t = spread(sample_pages(responses, most)[0]).mapInArrow(_sample(phrases or Phrases.without()), SAMPLE).toArrow()
    return ResidueModel.fitted(t, held_out), t


def _find(model):
    def run(batches):
        m = model.value
        for b in batches:
            ids = [i for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if m.is_residue(parse(body.decode("utf-8", "replace")))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["response_id"])

    return run


def residue_pages(responses: DataFrame, most: int = 20_000, model: ResidueModel | None = None) -> DataFrame:
    """``response_id`` of responses that hold template residue, filler, error text or a demand for scripts.

    A stored ``model`` saves the fit. Null, empty and blank bodies are none. Statuses and urls may be null. Repeated rows come as often as they
    stand in the table; extra columns are ignored; an empty table gives an empty result.
    """
    model = model or fit(responses, most)[0]
    shared = responses.sparkSession.sparkContext.broadcast(model)  # two weight vectors of 2**18 floats, 2 MB
    return spread(responses.filter(F.octet_length("body") > 0).select(F.col("response_id").cast("long"), "body")).mapInArrow(_find(shared), "response_id long")


def validation(responses: DataFrame, most: int = 20_000) -> DataFrame:
    """Agreement with the weak labels on unseen hosts (a fifth of them), one row per classifier and kind of label.

    The model is fitted without a fifth of the phrases and without the languages ``_UNSEEN_SYNTAX``; rows with 'unseen' in
    their name count as positives what only those name, among the same negatives.
    """
    model, t = fit(responses, most, held_out=1, phrases=Phrases.without(1))
    kind, host, label = (t.column(c).to_numpy() for c in ("kind", "host_key", "y"))
    rows = []
    for k, name, w, bias in ((0, "pages", model.pages, model.page_bias), (1, "expressions", model.expr, model.expr_bias)):
        for what, yes in ((name, 1), (name + " unseen", 3)):
            keep = (kind == k) & (host % 5 == 0) & ((label == 0) | (label == yes))
            ids, vals, offsets, y = _rows_of(t, keep)
            z = np.bincount(np.repeat(np.arange(len(y)), np.diff(offsets)), w[ids] * vals, len(y)) + bias
            hit = z > 0
            tp = int((hit & (y == yes)).sum())
            rows.append((what, len(y), int((y == yes).sum()), tp / max(1, int(hit.sum())), tp / max(1, int((y == yes).sum()))))
    return responses.sparkSession.createDataFrame(rows, "classifier string, held_out_rows long, positives long, precision double, recall double")
