"""A fluent way to write a SELECT."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .engine import Engine
    from .result import Result


class QueryBuilder:
    """Collects clauses; ``build`` gives the statement."""

    def __init__(self, engine: Engine, table: str, alias: str | None = None):
        self.engine, self.table, self.alias = engine, table, alias
        self._select: list[str] = []
        self._joins: list[str] = []
        self._where: list[str] = []
        self._group: list[str] = []
        self._having: list[str] = []
        self._order: list[str] = []
        self._limit = self._offset = self._window = None
        self._distinct = False

    def select(self, *items: str) -> QueryBuilder:
        """Items; all columns without."""
        self._select += items
        return self

    def distinct(self) -> QueryBuilder:
        """Rows once each."""
        self._distinct = True
        return self

    def join(self, table: str, on: str, how: str = "INNER", alias: str | None = None) -> QueryBuilder:
        """A join."""
        self._joins.append(f"{how.upper()} JOIN {table}{f' AS {alias}' if alias else ''} ON {on}")
        return self

    def where(self, condition: str) -> QueryBuilder:
        """A condition besides others."""
        self._where.append(condition)
        return self

    def where_context(self, *contexts: str, on: str | None = None, all_mode: bool = False, negated: bool = False, weights: dict[str, float] | None = None, then: bool = False) -> QueryBuilder:
        """A context predicate."""
        if negated and all_mode:
            raise ValueError("NOT IN takes no ALL")
        refs = [c + (f" WEIGHT {float(weights[c])!r}" if weights and c in weights else "") for c in contexts]
        word = "NOT IN" if negated else "IN ALL" if all_mode else "IN"
        self._where.append(f"CONTEXT {f'ON {on} ' if on else ''}{word} ({(' THEN ' if then else ', ').join(refs)})")
        return self

    def group_by(self, *items: str) -> QueryBuilder:
        """Grouping."""
        self._group += items
        return self

    def having(self, condition: str) -> QueryBuilder:
        """A condition on groups."""
        self._having.append(condition)
        return self

    def context_window(self, n: int) -> QueryBuilder:
        """The n entities with the highest scores."""
        self._window = n
        return self

    def order_by_context(self, direction: str = "DESC", using: str | None = None) -> QueryBuilder:
        """Ranks by context."""
        self._order.append(f"CONTEXT{f' USING {using}' if using else ''} {direction}")
        return self

    def order_by(self, *items: str) -> QueryBuilder:
        """Sorts."""
        self._order += items
        return self

    def limit(self, n: int) -> QueryBuilder:
        """So many rows."""
        self._limit = int(n)
        return self

    def offset(self, n: int) -> QueryBuilder:
        """Skips rows."""
        self._offset = int(n)
        return self

    def build(self) -> str:
        """The statement."""
        parts = [f"WITH CONTEXT WINDOW {self._window}"] if self._window is not None else []
        parts.append(f"SELECT {'DISTINCT ' if self._distinct else ''}{', '.join(self._select) or '*'} FROM {self.table}{f' AS {self.alias}' if self.alias else ''}")
        parts += self._joins
        for word, items, joint in (("WHERE", self._where, " AND "), ("GROUP BY", self._group, ", "), ("HAVING", self._having, " AND "), ("ORDER BY", self._order, ", ")):
            if items:
                parts.append(f"{word} {joint.join(items)}")
        parts += [f"LIMIT {self._limit}"] if self._limit is not None else []
        parts += [f"OFFSET {self._offset}"] if self._offset is not None else []
        return " ".join(parts)

    def execute(self) -> Result:
        """Runs the statement."""
        return self.engine.execute(self.build())

    def explain(self) -> str:
        """How the statement would run."""
        return self.engine.explain(self.build())
