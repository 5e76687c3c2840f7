"""Contexts in SQL on Spark: named sets of entities that queries filter, combine and rank by."""

from .engine import Engine
from .errors import Diagnostic, SituError
from .result import Result
from .sources.providers import Membership, RankingProvider, RowsProvider, ScoreThresholdProvider

__all__ = ["Diagnostic", "Engine", "Membership", "RankingProvider", "Result", "RowsProvider", "ScoreThresholdProvider", "SituError"]
