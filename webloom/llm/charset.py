"""Text decoded with the wrong charset: find it and win the original back.

Every token with characters outside ASCII (or with character references) is the start of a best-first
search over texts. A step encodes the token in one charset and decodes the bytes in another, or
resolves character references; texts already reached are known by their hash. A cost of implausible
characters orders the search and judges its end: control characters, symbols inside words, mixed
scripts, odd capitals, rare letters and rare East Asian characters cost, so the cheapest reachable text is
the likeliest original. A token is garbled if a text clearly cheaper than itself can be reached, or if it
holds replacement characters, whose original is lost. Charsets of Western, Central European, Turkish,
Cyrillic, Greek, Chinese, Japanese and Korean texts are steps of the search; a search follows at most four
misreadings one upon the other and expands at most ``limit`` texts (None: as many as there are).

Tokens repeat, so each worker keeps what it found by token.
"""

from __future__ import annotations

import heapq
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.runtime import spread

#: Russian letters by their frequency in per cent (public counts, ё by its spoken share).
_RUSSIAN = {
    "о": 10.97, "е": 8.45, "а": 8.01, "и": 7.35, "н": 6.70, "т": 6.26, "с": 5.47, "р": 4.73, "в": 4.54, "л": 4.40, "к": 3.49,
    "м": 3.21, "д": 2.98, "п": 2.81, "у": 2.62, "я": 2.01, "ы": 1.90, "ь": 1.74, "г": 1.70, "з": 1.65, "б": 1.59, "ч": 1.44,
    "й": 1.21, "х": 0.97, "ж": 0.94, "ш": 0.73, "ю": 0.64, "ц": 0.48, "щ": 0.36, "э": 0.32, "ф": 0.26, "ъ": 0.04, "ё": 0.50,
}

#: Greek letters by their frequency in per cent (public counts, rounded).
_GREEK = {
    "α": 9.9, "ο": 9.1, "ι": 8.8, "ε": 8.0, "τ": 7.9, "ν": 6.0, "η": 5.6, "σ": 4.9, "υ": 4.3, "ρ": 4.3, "π": 4.0, "κ": 4.0, "μ": 3.3, "ς": 3.1, "λ": 2.9, "ί": 2.0, "ά": 1.9,
    "ό": 1.9, "ω": 1.9, "γ": 1.7, "δ": 1.7, "έ": 1.7, "ή": 1.4, "χ": 1.2, "θ": 1.2, "φ": 0.9, "ώ": 0.9, "β": 0.7, "ύ": 0.7, "ξ": 0.5, "ζ": 0.4, "ψ": 0.15,
}

#: charsets in which UTF-8 bytes may have been read
_WIDE = ("cp1252", "latin-1", "cp1251", "mac-roman", "cp437", "koi8-r", "cp850", "cp866", "iso8859-5", "mac-cyrillic", "cp1250", "cp1253", "cp1254")
#: charsets of two bytes a character in which UTF-8 bytes may have been read
_EASTERN = ("gb18030", "cp932", "big5", "cp949", "euc_jp")
#: pairs (read as, was) of single-byte charsets
_NARROW = [
    (a, b)
    for a, b in (
        ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
        ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp1252", "mac-roman"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"),
        ("cp1252", "cp1253"), ("cp1253", "cp1252"),
    )
]


def _byte_of(charset: str) -> dict[int, int]:
    """Code point to byte for the upper half; bytes the charset leaves undefined stand for their C1 controls."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


_BYTES = {c: _byte_of(c) for c in {*_WIDE, *(x for p in _NARROW for x in p)}}
_CHARS = {c: {b: chr(p) for p, b in t.items()} for c, t in _BYTES.items()}
_SWAPS = [{p: _CHARS[was][b] for p, b in _BYTES[read].items()} for read, was in _NARROW]

_HIGH = re.compile(r"[^\x00-\x7f]+")
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")


def _kept_blanks() -> str:
    """Pattern of U+00A0 and U+0085 where they stand for a continuation byte of a misread UTF-8 sequence; as a lead byte (Mac) they make no text."""
    ways = []
    for charset in _WIDE:
        chars = lambda lo, hi: "".join(re.escape(_CHARS[charset][b]) for b in range(lo, hi))
        c = f"[{chars(0x80, 0xC0)}]"
        blanks = "".join(x for x in "\x85\xa0" if 0x80 <= _BYTES[charset].get(ord(x), 0) < 0xC0 and _CHARS[charset][_BYTES[charset][ord(x)]] == x)
        if blanks:
            for lead, size in ((f"[{chars(0xC2, 0xE0)}]", 1), (f"[{chars(0xE0, 0xF0)}]", 2), (f"[{chars(0xF0, 0xF5)}]", 3)):
                ways += [f"(?<={lead}{c * n})[{blanks}](?={c * (size - n - 1)})" for n in range(size)]
    return "|".join(ways)


#: tokens: runs without blanks and marks of markup; a blank that is a byte of a misread character is none
_PLAIN = re.compile(r"[^\s<>\"\x1c-\x1f]+")
_TOKEN = re.compile(rf"(?:{_PLAIN.pattern}|{_kept_blanks()})+")
#: tokens of ASCII that stand for more
_REFERRING = re.compile(r"&(?:#\d|#[xX]|[A-Za-z]{2,8};[^\s<>\"]*&[A-Za-z#])")


def _common_eastern() -> str:
    """The characters the national standards put first as those in common use: Chinese (GB 2312, Big5), Japanese (JIS level 1), Korean syllables (KS X 1001)."""
    out = set()
    for charset, leads in (("gb2312", range(0xB0, 0xD8)), ("big5", range(0xA4, 0xC7)), ("shift_jis", range(0x88, 0x99)), ("euc_kr", range(0xB0, 0xC9))):
        raw = b"".join(bytes((lead, trail)) + b"\n" for lead in leads for trail in range(0x40, 0xFF) if trail != 0x7F)
        out.update(c for line in raw.split(b"\n") if len(line) == 2 for c in line.decode(charset, "ignore") if "\u4e00" <= c < "\ua000" or "\uac00" <= c < "\ud7a4")
    return "".join(sorted(out))


_COMMON = frozenset(_common_eastern())
#: East Asian text of common characters with its own and ASCII marks: nothing a wrong charset is likely to have made
_EAST = re.compile(rf"[\x00-\x7f\u2010-\u2026\u3000-\u30ff\uff00-\uff60{''.join(sorted(_COMMON))}]*")
_HAS_EAST = re.compile(r"[\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef]")
_CODE = re.compile(r"<code\b.*?(?:</code\s*>|\Z)", re.S | re.I)
_INDENTED = re.compile(r"^ {4}.*$", re.M)


def _kind(p: int) -> str:
    """Class of a code point: l/u Latin, c/C Cyrillic, g/G Greek, j East Asian, d digit, p ordinary punctuation, s symbol, x never in text."""
    if p < 0x80:
        ch = chr(p)
        return "l" if "a" <= ch <= "z" else "u" if "A" <= ch <= "Z" else "d" if ch.isdigit() else "p"
    if p < 0xA0 or p == 0xFFFD or 0xE000 <= p < 0xF900:
        return "x"
    ch = chr(p)
    if p in (0xA0, 0xAB, 0xBB, 0x2010, 0x2011, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2026, 0x2022, 0xB7, 0x20AC, 0xA3, 0xA7, 0xA9, 0xA1, 0xBF, 0xB0, 0xBD, 0xD7, 0xAE, 0x2122, 0xBA, 0xAA, 0xBC, 0xBE, 0xB1, 0x2192, 0x2212):
        return "p"
    if p == 0xB5 or 0xA0 <= p < 0xC0 or p == 0xF7:
        return "s"
    if p < 0x250:
        return "l" if ch.islower() else "u"
    if 0x370 <= p < 0x400 and ch.isalpha():
        return "g" if ch.islower() else "G"
    if 0x400 <= p < 0x460:
        return "c" if ch.islower() else "C"
    if 0x3000 <= p < 0x3100 or 0x4E00 <= p < 0xA000 or 0xAC00 <= p < 0xD7A4 or 0xFF00 <= p < 0xFFF0:
        return "j"
    if 0x2500 <= p < 0x2600:
        return "x"
    return "s" if not ch.isalpha() else "o"


_kinds: dict[str, str] = {}
_LETTERS = frozenset("lucCgGjo")
_SCRIPT = {"l": 1, "u": 1, "c": 2, "C": 2, "g": 3, "G": 3, "j": 4, "o": 5}
#: cost of a lone character; Latin letters beyond ASCII are ordinary, capitals of them less so
_RARE = {k: 0.3 * max(0.0, math.log2(6 / f)) for k, f in (_RUSSIAN | _GREEK).items()}
_VOWELS = frozenset("аеёиоуыэюяАЕЁИОУЫЭЮЯ")
_INSIDE = frozenset("’‘·-'‐‑")  # may stand between letters
_ALONE = frozenset("ÂÃÐÑ")  # no words by themselves, but what a misread 'à' leaves before U+00A0


def cost(text: str) -> float:
    """Implausibility of a token; 0 for plain ASCII."""
    total, before, prev = 0.0, "p", ""
    latin_high = 0  # run of Latin letters beyond ASCII
    consonants = 0  # run of Cyrillic consonants
    greek, greek_alone, others = 0.0, 0.0, False  # cost of Greek letters beside other scripts, and by themselves
    for n, ch in enumerate(text):
        k = _kinds.get(ch)
        if k is None:
            k = _kinds[ch] = _kind(ord(ch))
        if ch >= "\x80":
            if k == "x":
                total += 5
            elif k == "s":
                total += 3
            elif k in "gG":
                greek += 2
                greek_alone += _RARE.get(ch.lower(), 2.5) + 0.1
            elif k == "o":
                total += 2.5
            elif k == "p":
                total += 0.4
                # ordinary marks, but not next to letters in the middle of a word
                if ch not in _INSIDE and before in _LETTERS and before != "j" and n + 1 < len(text):
                    nk = _kinds.get(text[n + 1]) or _kind(ord(text[n + 1]))
                    if nk in "lucCgGox" or (nk in "ps" and text[n + 1] >= "\x80"):
                        total += 2
                if before in "ps" and prev >= "\x80":
                    total += 0.6
                if ch in "€™©®¡¿ªº½¼¾×°£§" and before in "luC":
                    total += 2
                if ch == "\xa0" and prev in _ALONE and (n < 2 or (_kinds.get(text[n - 2]) or _kind(ord(text[n - 2]))) not in _LETTERS):
                    total += 2
            elif k in "cC":
                total += _RARE.get(ch.lower(), 2.5) + 0.1
            elif k == "j":
                total += 0.1 if "\u3000" <= ch < "\u3100" or "\uff00" <= ch < "\uff61" else 1.2 if ch in _COMMON else 2.6
            elif k == "u":
                total += 1.0
            else:
                total += 0.5
        if k in _LETTERS and before in _LETTERS:
            a, b = _SCRIPT[before], _SCRIPT[k]
            if a != b:
                total += 1.5 if 4 in (a, b) else 4
            elif k in "uCG" and before in "lcg" and (ch >= "\x80" or prev >= "\x80"):
                total += 2.5
        if k in "lu" and ch >= "\x80":
            latin_high += 1
            if latin_high > 2:
                total += 1.5
        else:
            latin_high = 0
        if k in "cC":
            consonants = 0 if ch in _VOWELS else consonants + 1
            if consonants > 2:
                total += 0.8
        else:
            consonants = 0
        others = others or k in "lucCjo"
        before, prev = k, ch
    return total + (greek if others else greek_alone)


_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: character to the character with the number of its byte; what has no byte becomes U+0001
_AS_BYTE = {c: {p: "\x01" for p in range(0x80, 0x100)} | {p: chr(b) for p, b in _BYTES[c].items()} for c in _WIDE}


def _utf8_pieces(text: str, charset: str) -> str | None:
    """``text`` with every run of characters whose bytes are a UTF-8 sequence replaced; None if there is none."""
    as_bytes = text.translate(_AS_BYTE[charset])
    out, at = [], 0
    for m in _SEQUENCE.finditer(as_bytes):
        try:
            ch = m[0].encode("latin-1").decode()
        except UnicodeDecodeError:
            continue
        out += (text[at : m.start()], ch)
        at = m.end()
    return "".join([*out, text[at:]]) if at else None


def _steps(text: str):
    """Texts one operation away, and the price of the operation: bytes of another charset are dearer than misread UTF-8, which leaves clear traces."""
    if "&" in text and (t := html.unescape(text)) != text:
        yield t, 0.3
    if text.isascii():
        return
    for charset in _WIDE:
        t = _utf8_pieces(text, charset)
        if t is not None:
            yield t, 0.3
    if _HAS_EAST.search(text):
        for charset in _EASTERN:
            try:
                yield text.encode(charset).decode("utf-8"), 0.3
            except UnicodeError:
                continue
    points = {ord(c) for c in text if c >= "\x80"}
    for swap in _SWAPS:
        if points <= swap.keys():
            yield text.translate(swap), 0.6


def search(token: str, limit: int | None = 24, depth: int = 4, slack: float = 1.0) -> tuple[str, float, float]:
    """Cheapest text reachable from ``token``: (text, its cost, cost of the token itself).

    With ``limit`` None every text is expanded that could still lead to a cheaper one.
    """
    start = cost(token)
    best, best_cost = token, start
    seen = {hash(token)}
    heap = [(start, 0, 0.0, token)]
    expanded = 0
    while heap and (limit is None or expanded < limit):
        _, d, paid, text = heapq.heappop(heap)
        if d == depth or paid + 0.3 >= best_cost:  # a step costs 0.3 at least: nothing cheaper lies beyond
            continue
        expanded += 1
        for t, price in _steps(text):
            if (h := hash(t)) in seen:
                continue
            seen.add(h)
            total = cost(t) + paid + price
            if total < best_cost:
                best, best_cost = t, total
            if total < start + slack:  # a way to the original doesn't lead through worse text
                heapq.heappush(heap, (total, d + 1, paid + price, t))
    return best, best_cost, start


#: how much cheaper the reachable text has to be: in all, and per letter where both are Cyrillic
MARGIN, CYRILLIC_MARGIN, CYRILLIC_PER_LETTER = 2.0, 2.5, 0.3
_CYRILLIC = re.compile(r"[Ѐ-џ]")
#: German letters named by themselves
_UMLAUTS = re.compile(r"[!-/:-@]*[ÄÖÜäöüß]+[!-/:-@]*")
_found: dict[str, str | None] = {}


def repair(token: str) -> str | None:
    """The original of a garbled token (with the replacement characters, where lost), None for a sound one."""
    if token in _found:
        return _found[token]
    if len(_found) > 400_000:
        _found.clear()
    out = None
    plain = html.unescape(token) if "&" in token else token
    if "�" in plain:
        out = token
    elif not _EAST.fullmatch(plain) and not _UMLAUTS.fullmatch(plain) and cost(plain) >= 1.5:  # less is under the margin
        text, c, start = search(plain)
        gain = start - c
        if text != plain and gain >= MARGIN:
            both = len(_CYRILLIC.findall(token))
            if not both or len(_CYRILLIC.findall(text)) < both or gain >= max(CYRILLIC_MARGIN, CYRILLIC_PER_LETTER * both):
                out = text
        if out is None and any("\x80" <= ch < "\xa0" for ch in plain):
            out = token  # control characters no text holds: garbled, but nothing sound can be reached
    _found[token] = out
    return out


def strip_quoted_code(text: str) -> str:
    """``text`` without code: code elements of a page, lines indented by four blanks of a plain text."""
    if text.lstrip()[:1] == "<":
        return _CODE.sub(" ", text) if "<code" in text or "<CODE" in text else text
    return _INDENTED.sub("", text) if "    " in text else text


def garbled_tokens(text: str) -> dict[str, str]:
    """Garbled tokens of a text and their originals."""
    if text.isascii() and "&" not in text:
        return {}
    out, rest = {}, []
    refers = "&" in text and _REFERRING.search(text) is not None
    for token in set((_TOKEN if "\xa0" in text or "\x85" in text else _PLAIN).findall(strip_quoted_code(text))):
        if token.isascii() and not (refers and "&" in token and _REFERRING.search(token)):
            continue
        if (r := repair(token)) is not None:
            out[token] = r
        else:
            rest.append(token)
    if any(_CYRILLIC.search(t) and _CYRILLIC.search(r) and "�" not in t for t, r in out.items()):
        # one Cyrillic charset was taken for another: short words give no proof of their own, but follow
        for token in rest:
            if _CYRILLIC.search(token):
                text_, c, start = search(token)
                if c < start and _CYRILLIC.search(text_):
                    out[token] = text_
    return out


def restore(text: str) -> str:
    """``text`` with every garbled token outside quoted code replaced by its original."""
    bad = garbled_tokens(text)
    if not bad:
        return text
    keep = _CODE if text.lstrip()[:1] == "<" else _INDENTED
    out, at = [], 0
    swap = lambda s: _TOKEN.sub(lambda m: bad.get(m[0], m[0]), s)
    for m in keep.finditer(text):
        out += [swap(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, swap(text[at:])])


def _scan(with_text: bool):
    def run(batches):
        for b in batches:
            ids, texts, lost = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = v.decode("utf-8", "replace") if isinstance(v, bytes) else v
                if not t:
                    continue
                bad = garbled_tokens(t)
                if bad:
                    ids.append(i)
                    if with_text:
                        r = restore(t)
                        texts.append(r)
                        lost.append("�" in r or any("\x80" <= c < "\xa0" for c in r))
            cols = [pa.array(ids, pa.int64())]
            if with_text:
                cols += [pa.array(texts, pa.string()), pa.array(lost, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["record_id", "text", "lost"][: len(cols)])

    return run


def garbled(df: DataFrame, id_column: str, text_column: str, with_text: bool = False) -> DataFrame:
    """``record_id`` of the rows whose text holds wrongly decoded characters; with ``text`` (the text
    restored as far as possible) and ``lost`` (something stays lost) if asked for.

    Binary text is read as UTF-8. Null and empty texts are sound. Rows repeat as they come; extra columns
    are ignored. Samples in code elements, or in plain text on lines indented by four blanks, are sound.
    """
    out = "record_id long, text string, lost boolean" if with_text else "record_id long"
    return spread(df.select(F.col(id_column).cast("long"), F.col(text_column)).filter(F.col(text_column).isNotNull())).mapInArrow(_scan(with_text), out)


def garbled_records(responses: DataFrame, headers: DataFrame, with_text: bool = False) -> DataFrame:
    """``field, record_id`` of garbled bodies ('body') and header values ('header')."""
    b = garbled(responses, "response_id", "body", with_text).withColumn("field", F.lit("body"))
    h = garbled(headers, "header_id", "value", with_text).withColumn("field", F.lit("header"))
    both = b.unionByName(h)
    return both.select("field", *[c for c in both.columns if c != "field"])
