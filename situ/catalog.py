"""The catalog: tables, contexts, event logs, process models, providers, maps, grants and settings; case-insensitive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .errors import SituError, did_you_mean

#: States of a context's life, by names of this engine's own.
STATES = ("draft", "validated", "active", "stale", "refreshing", "failed", "deprecated", "archived", "dropped")


@dataclass
class Table:
    """A registered table, which is a temporary view."""

    name: str
    primary_key: str | None = None
    alias: str | None = None
    columns: dict[str, str] = field(default_factory=dict)


@dataclass
class Context:
    """A named set of entity keys, with a score or without."""

    name: str
    key: str
    body: str = ""
    score: str | None = None  # an expression over the body
    score_column: str | None = None
    frame: Any = None  # a DataFrame, instead of a body
    compose: list[tuple[str, float]] = field(default_factory=list)
    strategy: str = ""
    params: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    temporal: tuple[str, str] | None = None
    description: str = ""
    tags: tuple[str, ...] = ()
    classification: str = ""
    options: dict[str, str] = field(default_factory=dict)
    state: str = "active"
    depends_on: tuple[str, ...] = ()
    snapshot: str | None = None  # the folder of its last refresh
    refreshed_at: float | None = None
    key_type: str = ""
    parts: tuple[str, ...] = ()  # folders of members that batches have brought

    @property
    def scored(self) -> bool:
        """Whether members have scores of their own."""
        return bool(self.score or self.score_column or self.strategy)


@dataclass
class EventLog:
    """Which columns of a table are the case, activity, time and resource of events."""

    name: str
    source: str
    case: str
    activity: str
    timestamp: str
    resource: str | None = None
    attributes: tuple[str, ...] = ()
    description: str = ""
    tags: tuple[str, ...] = ()


@dataclass
class ProcessModel:
    """The paths that cases are expected to take."""

    name: str
    paths: list[list[str]]
    log: str | None = None


@dataclass
class Provider:
    """An external source of memberships (mcp) or rows (remote)."""

    name: str
    kind: str
    impl: Any
    entity_type: str | None = None
    entity_key: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


class Names(dict):
    """A map by lower-case names that says what it lacks."""

    def __init__(self, what: str, code: str):
        super().__init__()
        self.what, self.code = what, code

    def __getitem__(self, name: str):
        try:
            return super().__getitem__(name.lower())
        except KeyError:
            raise SituError(self.code, f"unknown {self.what} {name}", did_you_mean(name, list(self))) from None

    def __setitem__(self, name: str, value) -> None:
        super().__setitem__(name.lower(), value)

    def __delitem__(self, name: str) -> None:
        super().__delitem__(name.lower())

    def __contains__(self, name) -> bool:
        return super().__contains__(name.lower())


class Catalog:
    """All that an engine knows by name."""

    def __init__(self):
        self.tables: Names = Names("table", "E201")
        self.contexts: Names = Names("context", "E100")
        self.logs: Names = Names("event log", "E202")
        self.models: Names = Names("process model", "E203")
        self.providers: Names = Names("provider", "E204")
        self.namespaces: dict[str, str] = {}
        self.grants: list[tuple[str, str, str]] = []
        self.identity: list[tuple[str, str]] = []
        self.policies: list = []
        self.identities: list = []
        self.conf: dict[str, str] = {}
        self.audit: list[tuple] = []

    def order(self, names: list[str] | None = None) -> list[str]:
        """Contexts after those that they depend on; a cycle is E103."""
        out: list[str] = []
        busy: set[str] = set()

        def visit(n: str) -> None:
            n = n.lower()
            if n in out or n not in self.contexts:
                return
            if n in busy:
                raise SituError("E103", f"context {n} depends on itself")
            busy.add(n)
            for d in self.contexts[n].depends_on:
                visit(d)
            out.append(n)

        for n in names or list(self.contexts):
            visit(n)
        return out

    def dependents(self, name: str) -> list[str]:
        """Contexts that use this one."""
        return [c.name for c in self.contexts.values() if name.lower() in {d.lower() for d in c.depends_on}]

    def partner(self, column: str, has: Callable[[str], bool]) -> str | None:
        """The column that an identity map equates with this one and that the query has."""
        for a, b in self.identity:
            for x, y in ((a, b), (b, a)):
                if x.rpartition(".")[2].lower() == column.lower() and has(y.rpartition(".")[2]):
                    return y.rpartition(".")[2]
        return None
