"""Scores of rows by the contexts that they belong to, as SQL over a marker and a score column for each context."""

from __future__ import annotations

from dataclasses import dataclass

#: The strategies of ORDER BY CONTEXT USING.
STRATEGIES = ("MAX", "MIN", "AVG", "SUM", "COUNT", "WEIGHTED_MAX", "WEIGHTED_SUM")


@dataclass
class Ref:
    """A context in a predicate: its joined relation's alias, its weight and how its predicate combines."""

    alias: str
    weight: float | None
    mode: str  # any, all, then or not
    group: int  # the number of its predicate

    @property
    def member(self) -> str:
        """Whether the row is a member."""
        return f"{self.alias}.__k IS NOT NULL"

    @property
    def raw(self) -> str:
        """The score without weight."""
        return f"{self.alias}.__s"


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def count(refs: list[Ref]) -> str:
    """How many contexts of predicates that are not negated the row belongs to."""
    found = [f"CAST({r.member} AS INT)" for r in refs if r.mode != "not"]
    return f"({' + '.join(found)})" if found else "0"


def _merge(name: str, parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else f"{name}({', '.join(parts)})"


def score(refs: list[Ref], strategy: str | None = None, mode: str = "additive") -> str:
    """The row's score: by a strategy, or by default.

    additive: the sum of weight times score over all memberships.  algebra: MAX in a union, MIN where all are needed,
    the last stage of a chain, MAX of weighted scores if a weight is given, and MIN across predicates.
    """
    used = [r for r in refs if r.mode != "not"]
    if not used:
        return "CAST(0.0 AS DOUBLE)"
    weighted = lambda r: f"{r.raw} * {_number(1.0 if r.weight is None else r.weight)}"
    if strategy == "COUNT":
        return f"CAST({count(refs)} AS DOUBLE)"
    if strategy in ("MAX", "MIN"):
        return _merge("greatest" if strategy == "MAX" else "least", [r.raw for r in used])
    if strategy == "WEIGHTED_MAX":
        return _merge("greatest", [weighted(r) for r in used])
    total = " + ".join(f"coalesce({weighted(r)}, 0.0D)" for r in used)
    if strategy == "SUM":
        return "(" + " + ".join(f"coalesce({r.raw}, 0.0D)" for r in used) + ")"
    if strategy == "AVG":
        return "((" + " + ".join(f"coalesce({r.raw}, 0.0D)" for r in used) + f") / nullif({count(refs)}, 0))"
    if strategy == "WEIGHTED_SUM":
        weights = " + ".join(f"IF({r.member}, {_number(1.0 if r.weight is None else r.weight)}, 0.0D)" for r in used)
        return f"(({total}) / nullif({weights}, 0.0D))"
    if mode == "additive":
        return f"({total})"
    groups: dict[int, list[Ref]] = {}
    for r in used:
        groups.setdefault(r.group, []).append(r)
    parts = []
    for g in groups.values():
        if g[0].mode == "then":
            parts.append(g[-1].raw)
        elif any(r.weight is not None for r in g):
            parts.append(_merge("greatest", [weighted(r) for r in g]))
        else:
            parts.append(_merge("least" if g[0].mode == "all" else "greatest", [r.raw for r in g]))
    return _merge("least", parts)
