"""Pages as relations: one row per element, numbered so that every axis is an equality or a range.

``nodes`` shreds HTML with the tag parser of the standard library and a small tree builder: void elements
never hold content, p, li, dd, dt, tr, td, th and option end where their successor begins, what is left
open ends with its parent, closing tags without an opening are dropped. Selectors are compiled to joins:
a child joins on (page, parent), a descendant on the page with pre inside (pre, post].
"""

from __future__ import annotations

import itertools
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: element -> the open elements it ends
_ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    **dict.fromkeys("div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 pre blockquote hr fieldset".split(), {"p"}),
}
_FENCE = frozenset("table ul ol dl select div section article body html".split())

NODES = "node int, parent int, depth int, pre int, post int, tag string, attrs map<string,string>, nth int, nth_last int, nth_type int, own_text string, text string"


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[dict] = []

    def _close(self, node):
        node["post"] = len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        ends = _ENDS.get(tag)
        if ends:
            for k in range(len(self.stack) - 1, -1, -1):
                t = self.stack[k]["tag"]
                if t in ends:
                    for n in self.stack[k:]:
                        self._close(n)
                    del self.stack[k:]
                elif t in _FENCE:
                    break
        parent = self.stack[-1] if self.stack else None
        node = {"node": len(self.rows), "parent": parent["node"] if parent else -1, "depth": len(self.stack), "post": len(self.rows), "tag": tag, "attrs": {}, "parts": [], "own": [], "kids": []}
        for k, v in attrs:
            node["attrs"].setdefault(k, v if v is not None else "")
        if parent:
            parent["kids"].append(node)
        self.rows.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.stack and self.stack[-1]["tag"] == tag:
            self._close(self.stack.pop())

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k]["tag"] == tag:
                for n in self.stack[k:]:
                    self._close(n)
                del self.stack[k:]
                return

    def handle_data(self, data):
        if self.stack:
            self.stack[-1]["own"].append(data)
            for n in self.stack:
                n["parts"].append(data)

    def finish(self):
        self.close()
        for n in self.stack:
            self._close(n)
        roots = [n for n in self.rows if n["parent"] < 0]
        for kids in [roots, *(n["kids"] for n in self.rows)]:
            types: dict[str, int] = {}
            for i, n in enumerate(kids):
                types[n["tag"]] = types.get(n["tag"], 0) + 1
                n["nth"], n["nth_last"], n["nth_type"] = i + 1, len(kids) - i, types[n["tag"]]
        return self.rows


def tree(html: str) -> list[dict]:
    t = _Tree()
    t.feed(html)
    return t.finish()


def _shred(batches):
    names = ["page_id", "node", "parent", "depth", "pre", "post", "tag", "attrs", "nth", "nth_last", "nth_type", "own_text", "text"]
    for b in batches:
        rows = []
        for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if isinstance(html, bytes):
                html = html.decode("utf-8", "replace")
            for n in tree(html):
                rows.append((i, n["node"], n["parent"], n["depth"], n["node"], n["post"], n["tag"], list(n["attrs"].items()), n["nth"], n["nth_last"], n["nth_type"], "".join(n["own"]), "".join(n["parts"])))
        types = [b.schema.field(0).type, *[pa.int32()] * 5, pa.string(), pa.map_(pa.string(), pa.string()), *[pa.int32()] * 3, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def nodes(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Elements of each page in document order; pages with a null id or text have none."""
    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id), F.col(html)).filter(F.col(page_id).isNotNull() & F.col(html).isNotNull()).mapInArrow(_shred, f"page_id {kind}, {NODES}")


_CONTROLS = ("input", "textarea", "select", "button", "option")
_CONTROL = "struct<pre:int,post:int,tag:string,attrs:map<string,string>,text:string>"
_FORM = "struct<pre:int,post:int,attrs:map<string,string>>"


def _lists(rows: list[list[dict]], fields: dict) -> pa.ListArray:
    flat = [n for r in rows for n in r]
    ends = list(itertools.accumulate((len(r) for r in rows), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array([get(n) for n in flat], t) for get, t in fields.values()], list(fields)))


def _form_parts(batches):
    attrs = (lambda n: list(n["attrs"].items()), pa.map_(pa.string(), pa.string()))
    form = {"pre": (lambda n: n["node"], pa.int32()), "post": (lambda n: n["post"], pa.int32())}
    text = lambda n: "".join(n["own"]) if n["tag"] == "textarea" else "".join(n["parts"]) if n["tag"] == "option" else ""
    control = form | {"tag": (lambda n: n["tag"], pa.string()), "attrs": attrs, "text": (text, pa.string())}
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            pages = [tree(h.decode("utf-8", "replace") if isinstance(h, bytes) else h) for h in part.column(3).to_pylist()]
            controls = _lists([[n for n in p if n["tag"] in _CONTROLS] for p in pages], control)
            found = _lists([[n for n in p if n["tag"] == "form"] for p in pages], form | {"attrs": attrs})
            yield pa.RecordBatch.from_arrays([*part.columns[:3], controls, found], ["page_id", "url", "_base", "controls", "forms"])


def form_parts(pages: DataFrame) -> DataFrame:
    """``page_id, url, _base, controls, forms`` of pages (page_id, url, _base, html): their form controls and their forms in document order, a row a page.

    A page is read once and where it lies: nothing is joined or shuffled. Pages with a null id, address or text give no row.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    p = pages.select("page_id", "url", "_base", "html").filter("page_id is not null and url is not null and html is not null")
    return p.mapInArrow(_form_parts, f"page_id {kind}, url string, _base string, controls array<{_CONTROL}>, forms array<{_FORM}>")


def form_parts_of(pages: DataFrame, nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """``form_parts`` of pages whose elements are there already: controls from ``nodes``, forms from ``chosen``. One shuffle by page, no join."""
    in_order = lambda c: F.array_sort(F.collect_list(c), lambda a, b: a["pre"] - b["pre"])  # noqa: E731 - maps have no order of their own
    text = F.when(F.col("tag") == "textarea", F.col("own_text")).when(F.col("tag") == "option", F.col("text")).otherwise("")
    control = nodes.filter(F.col("tag").isin(*_CONTROLS)).select("page_id", F.struct("pre", "post", "tag", "attrs", text.alias("text")).alias("c"))
    form = chosen.filter(F.col("tag") == "form").select("page_id", F.struct("pre", "post", "attrs").alias("f"))
    site = pages.filter("url is not null").select("page_id", F.struct("url", "_base").alias("s"))
    all_ = control.unionByName(form, allowMissingColumns=True).unionByName(site, allowMissingColumns=True).filter("page_id is not null")
    d = all_.groupBy("page_id").agg(in_order("c").alias("controls"), in_order("f").alias("forms"), F.collect_list("s").alias("s"))
    return d.select("page_id", "controls", "forms", F.explode("s").alias("s")).select("page_id", "s.url", "s._base", "controls", "forms")


# --- selectors ---------------------------------------------------------------------------------------

_STEP = re.compile(r"\s*(>|\+|~)\s*|\s+")
_SIMPLE = re.compile(
    r"(?P<tag>[A-Za-z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]"
    r"|:(?P<pseudo>first-child|last-child|only-child|first-of-type|nth-child\(\s*(?P<n>\d+)\s*\)|nth-of-type\(\s*(?P<nt>\d+)\s*\)|not\((?P<neg>[^()]*)\)|contains\(\s*[\"']?(?P<has>[^\"')]*)[\"']?\s*\))"
)


def _compound(text: str) -> Column:
    cond, at = F.lit(True), 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector not supported: {text!r}")
        at = m.end()
        attrs = F.col("attrs")
        if m["tag"] and m["tag"] != "*":
            cond = cond & (F.col("tag") == m["tag"].lower())
        elif m["id"]:
            cond = cond & (F.element_at(attrs, "id") == m["id"])
        elif m["cls"]:
            cond = cond & F.coalesce(F.array_contains(F.split(F.element_at(attrs, "class"), r"\s+"), m["cls"]), F.lit(False))
        elif m["attr"]:
            v = F.element_at(attrs, m["attr"].lower())
            want = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
            test = {
                None: lambda v=v: v.isNotNull(), "=": lambda v=v, w=want: v == w, "^=": lambda v=v, w=want: v.startswith(w), "$=": lambda v=v, w=want: v.endswith(w),
                "*=": lambda v=v, w=want: v.contains(w), "~=": lambda v=v, w=want: F.array_contains(F.split(v, r"\s+"), w), "|=": lambda v=v, w=want: (v == w) | v.startswith(f"{w}-"),
            }[m["op"]]()
            cond = cond & F.coalesce(test, F.lit(False))
        elif m["pseudo"]:
            p = m["pseudo"]
            if p == "first-child":
                cond = cond & (F.col("nth") == 1)
            elif p == "last-child":
                cond = cond & (F.col("nth_last") == 1)
            elif p == "only-child":
                cond = cond & (F.col("nth") == 1) & (F.col("nth_last") == 1)
            elif p == "first-of-type":
                cond = cond & (F.col("nth_type") == 1)
            elif m["n"]:
                cond = cond & (F.col("nth") == int(m["n"]))
            elif m["nt"]:
                cond = cond & (F.col("nth_type") == int(m["nt"]))
            elif m["neg"] is not None:
                cond = cond & ~_compound(m["neg"].strip())
            else:
                cond = cond & F.col("text").contains(m["has"])
    return cond


def _split(selector: str) -> list[tuple[str, str]]:
    """(combinator, compound) steps of one selector; blanks inside brackets and parentheses don't count."""
    out, comb, at, depth, start = [], " ", 0, 0, 0
    s = selector.strip()
    while at < len(s):
        ch = s[at]
        depth += (ch in "[(") - (ch in "])")
        m = _STEP.match(s, at) if depth == 0 else None
        if m and m.end() > at:
            if s[start:at]:
                out.append((comb, s[start:at]))
            comb = m[1] or " "
            at = start = m.end()
        else:
            at += 1
    out.append((comb, s[start:]))
    return out


def css(dom: DataFrame, selector: str, under: DataFrame | None = None) -> DataFrame:
    """Elements that match, in document order within their page, each once; ``under`` limits to descendants of its rows.

    With ``::text`` or ``::attr(name)`` at the end a column ``value`` holds the text nodes of the element
    (joined) or the attribute; elements without are left out.
    """
    found, m = None, None
    parts = re.split(r",(?![^\[(]*[\])])", selector)
    for part in parts:
        m = re.fullmatch(r"\s*(.*?)(::text|::attr\(\s*([\w:-]+)\s*\))?\s*", part, re.S)
        one, cur = m[1], under
        for comb, compound in _split(one):
            step = dom.filter(_compound(compound))
            if cur is None:
                cur = step
            elif comb == ">":
                up = cur.select("page_id", F.col("node").alias("_up")).distinct()
                cur = step.join(up, (step.page_id == up.page_id) & (step.parent == up._up), "left_semi")
            elif comb in "+~":
                up = cur.select(F.col("page_id").alias("_p"), F.col("parent").alias("_up"), F.col("nth").alias("_n")).distinct()
                near = F.col("nth") == F.col("_n") + 1 if comb == "+" else F.col("nth") > F.col("_n")
                cur = step.join(up, (F.col("page_id") == F.col("_p")) & (F.col("parent") == F.col("_up")) & near, "left_semi")
            else:
                up = cur.select(F.col("page_id").alias("_p"), F.col("pre").alias("_pre"), F.col("post").alias("_post")).distinct()
                cur = step.join(up, (F.col("page_id") == F.col("_p")) & (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_post")), "left_semi")
        found = cur if found is None else found.unionByName(cur)
    if len(parts) > 1:
        found = found.dropDuplicates(["page_id", "node"])
    if m[3]:
        found = found.withColumn("value", F.element_at("attrs", m[3].lower())).filter("value is not null")
    elif m[2]:
        found = found.withColumn("value", F.col("own_text")).filter("value <> ''")
    return found


_XSTEP = re.compile(r"(//|/)(?:(?P<axis>descendant-or-self|descendant|child|self)::)?(?P<name>text\(\)|@[\w:-]+|[\w-]+|\*)(?P<preds>(?:\[[^\[\]]*\])*)")


def xpath(dom: DataFrame, query: str, under: DataFrame | None = None) -> DataFrame:
    """Elements of a path of child and descendant steps with predicates ``[@a]``, ``[@a='v']``, ``[n]``, ``[contains(@a, 'v')]``;
    a last step ``@a`` or ``text()`` adds ``value``, ``string(path)`` the whole text of each element."""
    q = query.strip()
    whole = re.fullmatch(r"string\((.*)\)", q)
    q = whole[1] if whole else q
    q = re.sub(r"^\.(?=/)", "", q)
    if not q.startswith("/"):
        q = "/" + q
    cur, at = under, 0
    value = None
    while at < len(q):
        m = _XSTEP.match(q, at)
        if not m:
            raise ValueError(f"path not supported: {query!r}")
        at = m.end()
        if m["name"].startswith("@") or m["name"] == "text()":
            value = F.element_at("attrs", m["name"][1:].lower()) if m["name"][0] == "@" else F.nullif(F.col("own_text"), F.lit(""))
            break
        css_step = "*" if m["name"] == "*" else m["name"]
        cond = _compound(css_step)
        nth = None
        for p in re.findall(r"\[([^\[\]]*)\]", m["preds"]):
            p = p.strip()
            if p.isdigit():
                nth = int(p)
            elif c := re.fullmatch(r"contains\(\s*(?:@([\w:-]+)|\.|text\(\))\s*,\s*['\"]([^'\"]*)['\"]\s*\)", p):
                cond = cond & F.coalesce((F.element_at("attrs", c[1]) if c[1] else F.col("text")).contains(c[2]), F.lit(False))
            elif c := re.fullmatch(r"@([\w:-]+)(?:\s*(!?=)\s*['\"]([^'\"]*)['\"])?", p):
                v = F.element_at("attrs", c[1].lower())
                cond = cond & F.coalesce(v.isNotNull() if c[2] is None else v == c[3] if c[2] == "=" else v != c[3], F.lit(False))
            else:
                raise ValueError(f"predicate not supported: {p!r}")
        if nth is not None:
            cond = cond & (F.col("nth_type" if m["name"] != "*" else "nth") == nth)
        step = dom.filter(cond)
        if cur is None:
            cur = step if m[1] == "//" else step.filter("parent < 0")
        elif m[1] == "/":
            up = cur.select(F.col("page_id").alias("_p"), F.col("node").alias("_up")).distinct()
            cur = step.join(up, (F.col("page_id") == F.col("_p")) & (F.col("parent") == F.col("_up")), "left_semi")
        else:
            up = cur.select(F.col("page_id").alias("_p"), F.col("pre").alias("_pre"), F.col("post").alias("_post")).distinct()
            cur = step.join(up, (F.col("page_id") == F.col("_p")) & (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_post")), "left_semi")
    if whole:
        return cur.withColumn("value", F.col("text"))
    return cur if value is None else cur.withColumn("value", value).filter("value is not null")


def collected(found: DataFrame, value: str = "value") -> DataFrame:
    """``page_id, values`` in document order: what getall gives; its first element is what get gives."""
    return found.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def first(found: DataFrame, value: str = "value", default: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """``page_id, value`` of the first hit of each page; with ``pages`` every page has a row, ``default`` where it has no hit."""
    got = found.groupBy("page_id").agg(F.min_by(value, "pre").alias("value"))
    return got if pages is None else pages.select("page_id").join(got, "page_id", "left").withColumn("value", F.coalesce("value", F.lit(default)))


def matches(found: DataFrame, pattern: str, value: str = "value") -> DataFrame:
    """``page_id, pre, at, value``: matches of a pattern in each hit, its first group if it has one; the first of them is what re_first gives."""
    got = F.regexp_extract_all(F.col(value), F.lit(pattern), F.lit(min(1, re.compile(pattern).groups)))
    return found.select("page_id", "pre", F.posexplode(got).alias("at", "value"))


def attributes(found: DataFrame) -> DataFrame:
    """``page_id, attrs`` of the first hit of each page."""
    return found.groupBy("page_id").agg(F.min_by("attrs", "pre").alias("attrs"))
