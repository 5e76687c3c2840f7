"""Contexts as lazy frames (__k, __s): distinct keys, each with one score."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Context
from ..errors import SituError
from ..governance import check_fresh
from ..linter import family

if TYPE_CHECKING:
    from ..engine import Engine


def distinct(df: DataFrame) -> DataFrame:
    """One row for each key that is not null, with its largest score."""
    return df.where("__k is not null").groupBy("__k").agg(F.max("__s").alias("__s"))


def body(engine: Engine, ctx: Context, args: dict[str, str], busy: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a context's definition with its parameters bound."""
    if ctx.frame is not None:
        return ctx.frame
    for name in args:
        if name.lower() not in {p.lower() for p in ctx.params}:
            raise SituError("E115", f"context {ctx.name} has no parameter {name}")
    values = {p.lower(): args.get(p, args.get(p.lower(), default)) for p, (_, default) in ctx.params.items()}
    if missing := [p for p, v in values.items() if v is None]:
        raise SituError("E206", f"context {ctx.name} needs {', '.join(missing)}")
    return engine.frame(ctx.body, params=values, busy=(*busy, ctx.name.lower()))


def resolve(engine: Engine, ctx: Context, args: dict[str, str] | None = None, when: tuple | None = None, busy: tuple[str, ...] = (), unique: bool = True) -> DataFrame:
    """A context's members, each key once if they are to be ``unique``.  ``when`` is ("AT", t) or ("BETWEEN", a, b) in SQL, compared at the context's granularity."""
    if ctx.name.lower() in busy:
        raise SituError("E103", f"context {ctx.name} depends on itself")
    engine.authorise("USE", ctx.name)
    if ctx.strategy:
        return composed(engine, ctx, args or {}, when, busy)
    if ctx.parts and not args and not when:
        return distinct(engine.spark.read.parquet(*ctx.parts).select("__k", "__s"))
    if ctx.snapshot and not args and not when:
        check_fresh(engine, ctx)
        return engine.spark.read.parquet(ctx.snapshot)
    rows = body(engine, ctx, args or {}, busy)
    if when:
        if not ctx.temporal:
            raise SituError("E109", f"context {ctx.name} is not temporal")
        column, unit = ctx.temporal
        if column.lower() not in {c.lower() for c in rows.columns}:
            rows = engine.frame(ctx.body, params={p.lower(): v for p, (_, v) in ctx.params.items()}, busy=(*busy, ctx.name.lower()), extra=column)
        at = lambda v: F.expr(f"date_trunc('{unit}', CAST({v} AS TIMESTAMP_NTZ))")
        mine = F.expr(f"date_trunc('{unit}', CAST(`{column}` AS TIMESTAMP_NTZ))")
        rows = rows.where(mine == at(when[1]) if when[0] == "AT" else (mine >= at(when[1])) & (mine <= at(when[2])))
    if ctx.key.lower() not in {c.lower() for c in rows.columns}:
        raise SituError("E114", f"context {ctx.name} has no column {ctx.key}")
    score = F.expr(ctx.score) if ctx.score else F.col(ctx.score_column) if ctx.score_column else F.lit(1.0)
    found = rows.select(F.col(f"`{ctx.key}`").alias("__k"), score.alias("__s"))
    if family(kind := found.schema["__s"].dataType.simpleString()) != "number":
        raise SituError("E111", f"the score of context {ctx.name} is {kind}, not a number")
    found = found.withColumn("__s", F.col("__s").cast("double"))
    return distinct(found) if unique else found.where("__k is not null")


def composed(engine: Engine, ctx: Context, args: dict[str, str], when: tuple | None, busy: tuple[str, ...]) -> DataFrame:
    """UNION keeps the largest score of any part, INTERSECT the smallest of all, WEIGHTED the largest weighted one."""
    parts = []
    for name, weight in ctx.compose:
        child = engine.catalog.contexts[name]
        part = resolve(engine, child, {k: v for k, v in args.items() if k in child.params}, when, (*busy, ctx.name.lower()))
        parts.append(part.withColumn("__s", F.col("__s") * weight) if ctx.strategy == "WEIGHTED" else part)
    every = reduce(DataFrame.union, parts)
    if ctx.strategy == "INTERSECT":
        return every.groupBy("__k").agg(F.min("__s").alias("__s"), F.count("*").alias("n")).where(F.col("n") == len(parts)).drop("n")
    return every.groupBy("__k").agg(F.max("__s").alias("__s"))
