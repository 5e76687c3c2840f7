"""Who may see what, and how old it may be: row policies, classifications, freshness, identities across systems."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, Context
from .errors import Diagnostic, SituError

if TYPE_CHECKING:
    from .engine import Engine

#: Classifications, lowest first.
LEVELS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
#: Fixed value: a snapshot of more seconds is stale, unless its context or the settings say otherwise.
MAX_STALENESS = 300.0
_UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}


@dataclass(frozen=True)
class RowPolicy:
    """A condition on a table's rows for some principals, or for all; session.name stands for a value of the session."""

    table: str
    condition: str
    principals: tuple[str, ...] = ()

    def holds_for(self, principal: str | None) -> bool:
        """Whether the policy restricts this principal; a policy for all restricts also those without a name."""
        return not self.principals or (principal or "").lower() in {p.lower() for p in self.principals}


def literal(value: Any) -> str:
    """A value as Spark SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def condition(policies: Iterable[RowPolicy], table: str, principal: str | None, session: Mapping[str, Any]) -> str:
    """What a principal's rows of a table must meet, or nothing.  A value that the session lacks is an error: a policy
    never opens because something is missing."""

    def value(m: re.Match) -> str:
        if m[1].lower() not in session:
            raise SituError("E208", f"the policy of table {table} needs session.{m[1]}")
        return literal(session[m[1].lower()])

    mine = [p for p in policies if p.table.lower() == table.lower() and p.holds_for(principal)]
    return " AND ".join(f"({re.sub(r'(?i)\bsession\.(\w+)', value, p.condition)})" for p in mine)


def classification(catalog: Catalog, ctx: Context, busy: tuple[str, ...] = ()) -> str:
    """The highest of a context's own classification and those of all that it depends on; empty if none has one."""
    found = [ctx.classification.upper()] if ctx.classification else []
    for d in ctx.depends_on:
        if d in catalog.contexts and d.lower() not in busy:
            found += [c for c in [classification(catalog, catalog.contexts[d], (*busy, ctx.name.lower()))] if c]
    return max(found, key=lambda c: LEVELS.index(c) if c in LEVELS else len(LEVELS), default="")


def seconds(text: str) -> float:
    """Seconds of a duration such as '5 minutes', 'every 5 minutes', '300s' or 300."""
    m = re.fullmatch(r"(?:every\s+)?(\d+(?:\.\d+)?)\s*([a-z]*)", str(text).strip().strip("'").lower())
    if not m or (m[2] and m[2] not in _UNITS and m[2].rstrip("s") not in _UNITS):
        raise SituError("E001", f"{text} is no duration")
    return float(m[1]) * (_UNITS.get(m[2]) or _UNITS.get(m[2].rstrip("s"), 1))


def check_fresh(engine: Engine, ctx: Context) -> None:
    """Tells of a snapshot that is older than ``max_staleness`` (W010) or twice that (W012).  With the setting
    strict_freshness one of the second kind is refreshed first."""
    limit = seconds(ctx.options.get("max_staleness") or engine.catalog.conf.get("max_staleness") or MAX_STALENESS)
    age = time.time() - (ctx.refreshed_at or 0.0)
    if age <= limit:
        return
    if age > 2 * limit and str(engine.catalog.conf.get("strict_freshness", "")).lower() == "true":
        engine.refresh(ctx.name)
        return
    ctx.state = "stale"
    engine.diagnostics.append(Diagnostic("W012" if age > 2 * limit else "W010", f"context {ctx.name} was refreshed {age:.0f} s ago, more than {limit:g} s", "REFRESH CONTEXT brings it up to date"))


def due(engine: Engine, now: float | None = None) -> list[str]:
    """Contexts whose refresh_schedule ('every 5 minutes') has come, after those that they depend on."""
    now = time.time() if now is None else now
    late = {c.name.lower() for c in engine.catalog.contexts.values() if c.options.get("refresh_schedule") and now - (c.refreshed_at or 0.0) >= seconds(c.options["refresh_schedule"])}
    return [n for n in engine.catalog.order(sorted(late)) if n in late]


@dataclass(frozen=True)
class Identities:
    """A table that says which keys of two systems are the same entity, with a confidence from 0 to 1."""

    frame: DataFrame
    left: str
    right: str
    confidence: str | None = None

    def between(self, key: str, columns: set[str]) -> tuple[str, str] | None:
        """The map's column for a context's key and its other column, if a query has that."""
        for a, b in ((self.left, self.right), (self.right, self.left)):
            if a.lower() == key.lower() and b.lower() in columns:
                return a, b
        return None

    def translate(self, members: DataFrame, a: str, b: str, least: float) -> DataFrame:
        """Members by the other system's keys: scores times confidence, the largest where several keys meet in one.
        Matches below ``least`` are not taken."""
        sure = F.col(f"`{self.confidence}`").cast("double") if self.confidence else F.lit(1.0)
        pairs = self.frame.select(F.col(f"`{a}`").alias("__a"), F.col(f"`{b}`").alias("__b"), sure.alias("__sure")).where((F.col("__sure") >= least) & F.col("__b").isNotNull())
        found = members.join(pairs, F.col("__k") == F.col("__a"))
        return found.groupBy(F.col("__b").alias("__k")).agg(F.max(F.col("__s") * F.col("__sure")).alias("__s"))
