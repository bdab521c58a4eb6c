"""Ordered chains of table transforms: what middleware and item pipelines are over relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    name: str
    order: int | None  # None switches it off
    on_request: Transform | None = None
    on_response: Transform | None = None


def ordered(base: list[Step], custom: list[Step] = ()) -> list[Step]:
    """Steps by ascending order; a custom step replaces the base step of its name, order None removes it."""
    by = {s.name: s for s in base} | {s.name: s for s in custom}
    return sorted((s for s in by.values() if s.order is not None), key=lambda s: s.order)


def requests(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Request side, in order. A step that answers a request sets ``route``; later steps see only rows without one."""
    if "route" not in df.columns:
        df = df.withColumn("route", F.lit(None).cast("string"))
    for s in steps:
        if s.on_request:
            open_ = s.on_request(df.filter("route is null"))
            df = open_.unionByName(df.filter("route is not null"), allowMissingColumns=True)
    return df


def responses(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Response side, in reverse order."""
    for s in reversed(steps):
        if s.on_response:
            df = s.on_response(df)
    return df


def outputs(results: DataFrame, column: str = "output", error: str | None = None) -> DataFrame:
    """What callbacks gave as one row per output: lists are taken apart, null gives none, anything else is one output.

    With ``error`` (a column) what was given before the callback failed stays, and the failure comes as a last row with a null output.
    """
    kind = results.schema[column].dataType
    many = F.col(column) if kind.typeName() == "array" else F.when(F.col(column).isNotNull(), F.array(column))
    rest = [c for c in results.columns if c not in (column, error)]
    out = results.select(*rest, F.posexplode(many).alias("at", column)).filter(F.col(column).isNotNull())
    if error is None:
        return out
    failed = results.filter(F.col(error).isNotNull()).select(*rest, F.coalesce(F.size(many), F.lit(0)).alias("at"), F.lit(None).cast(out.schema[column].dataType).alias(column), error)
    return out.withColumn(error, F.lit(None).cast("string")).unionByName(failed)


@dataclass(frozen=True)
class Drop:
    """A pipeline step that drops items for which ``when`` holds, for ``reason``."""

    reason: str
    when: Callable[[DataFrame], Column]


def pipeline(items: DataFrame, steps: list[Transform | Drop]) -> DataFrame:
    """Items with ``dropped``: the reason of the first step that dropped them, null for those that passed; one pass, no union."""
    df = items.withColumn("dropped", F.lit(None).cast("string"))
    for s in steps:
        df = df.withColumn("dropped", F.when(F.col("dropped").isNotNull(), F.col("dropped")).when(F.coalesce(s.when(df), F.lit(False)), s.reason)) if isinstance(s, Drop) else s(df)
    return df


#: Priorities of the layers of settings, lowest first. They must be these, or another value would win.
LAYERS = {"default": 0, "command": 10, "addon": 15, "project": 20, "spider": 30, "cmdline": 40}


def resolve_settings(settings: DataFrame) -> DataFrame:
    """``name, value`` in force of settings (name, value, layer, seq): the highest layer, then the latest."""
    rank = F.coalesce(*[F.when(F.col("layer") == k, v) for k, v in LAYERS.items()], F.lit(-1))
    return settings.groupBy("name").agg(F.max_by("value", F.struct(rank, F.col("seq"))).alias("value"))


def contract(output: DataFrame, returns: tuple[int, int | None] | None = None, scrapes: list[str] = ()) -> list[str]:
    """What an output breaks of a contract: numbers of rows, fields that must be there in every row."""
    wrong = []
    missing = [f for f in scrapes if f not in output.columns]
    wrong += [f"field {f} is missing" for f in missing]
    here = [f for f in scrapes if f in output.columns]
    r = output.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull()).alias(f"null_{k}") for k, f in enumerate(here)]).first()
    if returns and (r["n"] < returns[0] or (returns[1] is not None and r["n"] > returns[1])):
        wrong.append(f"{r['n']} rows, expected {returns[0]} to {returns[1] if returns[1] is not None else 'any number'}")
    wrong += [f"field {f} is null in {r[f'null_{k}']} rows" for k, f in enumerate(here) if r[f"null_{k}"]]
    return wrong
