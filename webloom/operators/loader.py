"""Item loading: processors over arrays of values as Column functions, and a loader that fills one select."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Processor = Callable[[Column], Column]


def identity(v: Column) -> Column:
    return v


def take_first(v: Column) -> Column:
    """First value that is neither null nor ''; 0 counts as a value."""
    return F.get(F.filter(v, lambda x: x.isNotNull() & (x.cast("string") != "")), 0)


def join_with(sep: str = " ") -> Processor:
    return lambda v: F.array_join(v, sep)


def compose(*fs: Processor) -> Processor:
    """Functions of the whole array one after the other; stops at null."""

    def run(v: Column) -> Column:
        for f in fs:
            v = F.when(v.isNotNull(), f(v))
        return v

    return run


def _unary(f: Processor) -> Processor:
    """``f`` with one parameter: functions with optional ones would get the index as well."""
    return lambda x: f(x)


def map_compose(*fs: Processor) -> Processor:
    """Functions of each value one after the other; nulls drop out between them."""

    def run(v: Column) -> Column:
        for f in fs:
            v = F.filter(F.transform(v, _unary(f)), lambda x: x.isNotNull())
        return v

    return run


def select_json(path: str) -> Processor:
    """Values at a JSON path in each text, flattened; ``[*]`` takes all elements."""

    def one(x: Column) -> Column:
        got = F.get_json_object(x, path)
        many = F.from_json(got, "array<string>")
        return F.when(F.lit("[*]" in path) & got.startswith("["), many).otherwise(F.array(got))

    return lambda v: F.filter(F.flatten(F.transform(v, one)), lambda x: x.isNotNull())


def find_all(pattern: str, group: int = 0) -> Processor:
    """All matches in each value."""
    return lambda v: F.flatten(F.transform(v, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(group))))


def jmes(path: str) -> Callable[[Column], Column]:
    """Values of a JSON text at a path of names, ``[n]``, ``[*]`` and ``a.b``, as an array of texts."""
    p = "$." + path.lstrip("$.")
    return lambda text: select_json(p)(F.array(text))


class ItemLoader:
    """Collects values per field from columns (arrays or scalars) and gives one projection.

    Values of selectors come from a shredded page (``nodes``): ``add_css`` and ``add_xpath`` remember the selection, ``load``
    joins each of them once on the page. ``nested`` gives a loader of the same fields whose selections lie inside elements.
    """

    def __init__(self, default_in: Processor = identity, default_out: Processor = identity):
        self.fields: dict[str, list[Column]] = {}
        self.ins: dict[str, Processor] = {}
        self.outs: dict[str, Processor] = {}
        self.default_in, self.default_out = default_in, default_out
        self.selections: list[tuple[str, str, str, str | None]] = []
        self.inside: tuple[str, str] | None = None
        self.root = self

    def processors(self, name: str, input: Processor | None = None, output: Processor | None = None) -> ItemLoader:
        if input:
            self.ins[name] = input
        if output:
            self.outs[name] = output
        return self

    def add(self, name: str, values: Column, *, scalar: bool = False, pattern: str | None = None) -> ItemLoader:
        """Values of a column; with ``pattern`` the matches (the first group, if it has one) in each of them."""
        v = F.array(values) if scalar else values
        v = F.coalesce(F.filter(v, lambda x: x.isNotNull()), F.array().cast("array<string>"))
        if pattern is not None:
            v = find_all(pattern, min(1, re.compile(pattern).groups))(v)
        self.root.fields.setdefault(name, []).append(self.root.ins.get(name, self.root.default_in)(v))
        return self

    def replace(self, name: str, values: Column, *, scalar: bool = False, pattern: str | None = None) -> ItemLoader:
        self.root.fields.pop(name, None)
        return self.add(name, values, scalar=scalar, pattern=pattern)

    def add_jmes(self, name: str, text: Column, path: str, *, pattern: str | None = None) -> ItemLoader:
        """Values of a JSON text at a path."""
        return self.add(name, jmes(path)(text), pattern=pattern)

    def _select(self, kind: str, name: str, query: str, pattern: str | None) -> ItemLoader:
        column = f"_s{len(self.root.selections)}"
        self.root.selections.append((column, kind, query, self.inside))
        return self.add(name, F.col(column), pattern=pattern)

    def add_css(self, name: str, query: str, *, pattern: str | None = None) -> ItemLoader:
        """Texts or attributes of a CSS selection (``::text``, ``::attr``), the whole text of the elements without."""
        return self._select("css", name, query, pattern)

    def add_xpath(self, name: str, query: str, *, pattern: str | None = None) -> ItemLoader:
        return self._select("xpath", name, query, pattern)

    def nested(self, css: str | None = None, xpath: str | None = None) -> ItemLoader:
        """A loader for the same item whose selections lie inside the elements of a selection."""
        if (css is None) == (xpath is None):
            raise ValueError("one of css and xpath")
        child = ItemLoader()
        child.root, child.inside = self.root, ("css", css) if css is not None else ("xpath", xpath)
        return child

    def load(self, df: DataFrame, *keep: str, nodes: DataFrame | None = None, page_id: str = "page_id") -> DataFrame:
        """One item per row of ``df``. ``nodes`` is needed if selectors were added; they meet the rows on ``page_id``."""
        from webloom.operators import dom

        run = {"css": dom.css, "xpath": dom.xpath}
        for column, kind, query, inside in self.root.selections:
            if nodes is None:
                raise ValueError("selectors need nodes")
            found = run[kind](nodes, query, run[inside[0]](nodes, inside[1]) if inside else None)
            value = "value" if "value" in found.columns else "text"
            df = df.join(dom.collected(found, value).select(F.col("page_id").alias(page_id), F.col("values").alias(column)), page_id, "left")
        cols = [self.root.outs.get(n, self.root.default_out)(F.concat(*vs) if len(vs) > 1 else vs[0]).alias(n) for n, vs in self.root.fields.items()]
        return df.select(*keep, *cols)
