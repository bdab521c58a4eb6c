"""Leaf blocks of a stored page with what the markup says about them.

A leaf block is a run of text between two boundaries of block elements: a paragraph, a heading, a list
item, a cell, a menu of links side by side, or the loose text between such elements. It may share its line
with other blocks or stand on several lines; ``at`` names the lines of the body that hold text of it. One
forgiving pass over the tags finds the blocks; nothing has to be well formed. A plain text or JSON has a
block per line.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: comments, elements whose content is no text, the title, tags with and without sound quotes, declarations
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<title\b[^>]*>([^<]*)"
    r"|</?[a-zA-Z][^<>\"']*(?:(?:\"[^\"<]*\"|'[^'<]*')[^<>\"']*)*>|</?[a-zA-Z][^<>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>]*)""", re.I)
_WORDLIKE = re.compile(r"[a-z]{3,}(?:-[a-z]{2,})*")
#: elements that hold blocks; those of the second line start no container of their own
_HOLDERS = frozenset("div section article main aside header footer nav table td th form center body fieldset figure details".split())
_INNER = frozenset("tr ul ol dl tbody thead tfoot blockquote noscript".split())
#: elements that are a block by themselves
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre figcaption caption summary option button legend address".split())
_INLINE = frozenset("b i strong em font small span q label".split())
_IN_HEAD = frozenset("meta link base noscript head html".split())

_SKIP, _BLOCK, _END_BLOCK, _HOLD, _END_HOLD, _LINK, _END_LINK, _CODE, _END_CODE, _SPAN, _END_SPAN, _BREAK, _RULE, _HEAD, _END_HEAD = range(15)


class Block(NamedTuple):
    at: tuple  # numbers (from 1) of the lines that hold text of it
    text: str  # without markup, references resolved; line breaks stay
    bare: str  # the same without what stands in code
    tag: str  # its element, with the first class name
    inline: str  # inline element its text begins with
    around: tuple  # tags and word-like class names of the elements around it
    holder: int  # container it stands in
    linked: float  # share of the text inside links
    code: bool  # some of it stands in a code element, or the line is indented by four blanks
    rules: int  # horizontal rules before it


class Page(NamedTuple):
    kind: str  # html, text or json
    title: str
    blocks: list  # of Block: all but those of the head


def _names(attributes: str) -> list[str]:
    out = []
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            out += [w for w in m[1].lower().split() if _WORDLIKE.fullmatch(w)]
    return out


class _Tags(dict):
    """Tag to (what it does, name, class names); tags repeat, so each is looked into once."""

    def __missing__(self, tag: str):
        m = _NAME.match(tag)
        if m is None:
            return _SKIP, "", ()
        name, closing = m[1].lower(), tag[1] == "/"
        names: tuple = ()
        if name == "a":
            op = _END_LINK if closing else _LINK
        elif name == "code":
            op = _END_CODE if closing else _CODE
        elif name in _BLOCKS:
            op = _END_BLOCK if closing else _BLOCK
        elif name in _HOLDERS or name in _INNER:
            op = _END_HOLD if closing else _HOLD
        elif name in _INLINE:
            op = _END_SPAN if closing else _SPAN
        elif name == "br":
            op = _BREAK
        elif name == "hr":
            op = _RULE
        elif name == "head":
            op = _END_HEAD if closing else _HEAD
        else:
            op = _SKIP
        if op in (_BLOCK, _HOLD):
            names = tuple(_names(tag))
        got = op, name, names
        if len(tag) < 200:
            if len(self) > 50_000:
                self.clear()
            self[tag] = got
        return got


_tags = _Tags()


def _plain(body: str, kind: str) -> Page:
    out = []
    for n, s in enumerate(body.split("\n"), 1):
        t = s.strip()
        if t:
            code = s.startswith("    ")
            out.append(Block((n,), t, "" if code else t, "text", "", (), 0, 0.0, code, 0))
    return Page(kind, "", out)


def parse(body: str) -> Page:
    start = body.lstrip()[:1]
    if start != "<":
        return _plain(body, "json" if start and start in "{[" else "text")
    out: list[Block] = []
    title = ""
    # open elements that hold blocks: (name, what was around it, container it stands in)
    stack: list[tuple[str, tuple, int]] = []
    around: tuple = ()
    leaf, inline = "", ""
    holder, parents, blocks_in, kids_in = 0, [0], [0], [0]
    link = code = rules = 0
    head = False
    line, pos = 1, 0
    # the block under way
    parts: list[str] = []
    bare: list[str] = []
    at: list[int] = []
    linked, coded = 0, False
    place: tuple = ("", "", (), 0)

    def flush():
        nonlocal linked, coded
        text = "".join(parts)
        size = len(text)
        if "&" in text:
            text = html.unescape(text)
        text = text.strip()
        if text:
            plain = text
            if coded:
                plain = "".join(bare).strip()
                if "&" in plain:
                    plain = html.unescape(plain)
            tag, first, names, h = place
            blocks_in[h] += 1
            out.append(Block(tuple(at), text, plain, tag, first, names, h, linked / size, coded, rules))
        parts.clear()
        bare.clear()
        at.clear()
        linked, coded = 0, False

    def add(chunk: str):
        nonlocal line, linked, coded, place
        if not parts:
            place = leaf, inline, around, holder
        parts.append(chunk)
        if link:
            linked += len(chunk)
        if code:
            coded = True
        else:
            bare.append(chunk)
        if "\n" in chunk:
            pieces = chunk.split("\n")
            for k, piece in enumerate(pieces):
                if piece and not piece.isspace() and (not at or at[-1] != line + k) and ("&" not in piece or html.unescape(piece).strip()):
                    at.append(line + k)
            line += len(pieces) - 1
        elif (not at or at[-1] != line) and ("&" not in chunk or html.unescape(chunk).strip()):
            at.append(line)

    tags = _tags
    for m in _TOKEN.finditer(body):
        s = m.start()
        if s > pos:
            chunk = body[pos:s]
            if head or chunk.isspace():
                if parts:
                    parts.append(chunk)
                    bare.append(chunk)
                line += chunk.count("\n")
            else:
                add(chunk)
        pos = m.end()
        token = m[0]
        if m[2] is not None:
            title = title or html.unescape(m[2]).strip()
            line += token.count("\n")
            continue
        if m[1] is not None:
            line += token.count("\n")
            continue
        op, name, names = tags[token]
        if "\n" in token:
            line += token.count("\n")
        if op == _SKIP:
            continue
        if head and op != _END_HEAD:
            if name in _IN_HEAD:
                continue
            head = False
        if op == _LINK:
            link += 1
            inline = inline or "a"
        elif op == _END_LINK:
            link = max(0, link - 1)
            if inline == "a":
                inline = ""
        elif op == _BLOCK:
            if parts:
                flush()
            leaf, inline = (f"{name}.{names[0]}" if names else name), ""
        elif op == _END_BLOCK:
            if parts:
                flush()
            leaf = inline = ""
        elif op == _SPAN:
            inline = inline or name
        elif op == _END_SPAN:
            if inline == name:
                inline = ""
        elif op == _HOLD:
            if parts:
                flush()
            stack.append((name, around, holder))
            around = (*around, name, *names)
            if name not in _INNER:
                kids_in[holder] += 1
                parents.append(holder)
                blocks_in.append(0)
                kids_in.append(0)
                holder = len(parents) - 1
            leaf, inline = (f"{name}.{names[0]}" if names else name), ""
        elif op == _END_HOLD:
            if parts:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    around, holder = stack[k][1:]
                    del stack[k:]
                    break
            leaf = inline = ""
        elif op == _CODE:
            code += 1
        elif op == _END_CODE:
            code = max(0, code - 1)
        elif op == _BREAK:
            if parts:
                flush()
        elif op == _RULE:
            if parts:
                flush()
            rules += 1
            # what follows a rule is another container
            parents.append(parents[holder] if holder else 0)
            blocks_in.append(0)
            kids_in.append(1)
            holder = len(parents) - 1
            leaf = inline = ""
        elif op == _HEAD:
            head = True
        elif op == _END_HEAD:
            head = False
    if pos < len(body) and not head:
        chunk = body[pos:]
        if not chunk.isspace():
            add(chunk)
    if parts:
        flush()
    # an element around a single block is no container: the block stands in the next one out
    lone = [h for h in range(1, len(parents)) if blocks_in[h] == 1 and not kids_in[h]]
    if lone:
        up = set(lone)
        out = [b._replace(holder=parents[b.holder]) if b.holder in up else b for b in out]
    return Page("html", title, out)
