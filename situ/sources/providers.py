"""External sources: memberships (ids with optional scores) and remote tables, fetched on the driver at bind time."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any


@dataclass
class Membership:
    """What a membership provider returns."""

    entity_type: str
    entity_ids: Sequence[Any]
    scores: Sequence[float] | None = None


class ScoreThresholdProvider:
    """Members are the keys whose score reaches a threshold; scores are divided by the largest possible one."""

    def __init__(self, scores: Mapping[Any, float], entity_type: str = "entity", threshold: float = 0.5, largest: float = 1.0):
        self.scores, self.entity_type, self.threshold, self.largest = dict(scores), entity_type, threshold, largest

    def resolve(self, entity_type: str | None = None, params: Mapping[str, Any] | None = None, limit: int | None = None) -> Membership:
        """The members, highest score first; params may set another threshold."""
        least = float((params or {}).get("threshold", self.threshold))
        found = sorted(((min(s / self.largest, 1.0), k) for k, s in self.scores.items() if s >= least), key=lambda p: (-p[0], str(p[1])))[:limit]
        return Membership(self.entity_type, [k for _, k in found], [s for s, _ in found])


class RankingProvider:
    """Everybody is a member; scores are divided by the highest if asked for."""

    def __init__(self, scores: Mapping[Any, float], entity_type: str = "entity", normalize: bool = True):
        self.scores, self.entity_type, self.normalize = dict(scores), entity_type, normalize

    def resolve(self, entity_type: str | None = None, params: Mapping[str, Any] | None = None, limit: int | None = None) -> Membership:
        """All members, highest score first."""
        top = max(self.scores.values(), default=1.0) if self.normalize else 1.0
        found = sorted(self.scores.items(), key=lambda p: (-p[1], str(p[0])))[:limit]
        return Membership(self.entity_type, [k for k, _ in found], [s / top if top else 0.0 for _, s in found])


class RowsProvider:
    """A remote table of given rows by resource."""

    def __init__(self, resources: Mapping[str, Any]):
        self.resources = dict(resources)

    def query(self, resource: str, filters: Mapping[str, Any] | None = None, columns: Sequence[str] | None = None, limit: int | None = None) -> Any:
        """The rows: a list of maps, or a pandas, Arrow or Spark table.  Hints are followed for lists; values of another type
        than a filter's are left to the query, and where no row fits one is given, as it shows the columns."""
        rows = self.resources[resource]
        if not isinstance(rows, list) or not rows:
            return rows
        fits = lambda r: all(k not in r or isinstance(r[k], str) != isinstance(v, str) or r[k] == v for k, v in (filters or {}).items())
        found = [r for r in rows if fits(r)][:limit] or rows[:1]
        return [{k: r[k] for k in columns} for r in found] if columns and all(set(columns) <= set(r) for r in found) else found


def timed(call: Callable[[], Any], seconds: float) -> Any:
    """The call's result; TimeoutError after so many seconds, without waiting for the call any longer."""
    out: dict[str, Any] = {}

    def run() -> None:
        try:
            out["value"] = call()
        except BaseException as e:  # handed to the caller
            out["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TimeoutError(f"no answer within {seconds:g} s")
    if "error" in out:
        raise out["error"]
    return out["value"]
