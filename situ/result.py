"""Results: lazy frames with what is known about the statement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Result:
    """A statement's rows (``df`` is lazy), its text, Spark SQL, diagnostics and trace."""

    df: DataFrame
    sql: str
    plan_sql: str = ""
    diagnostics: list = field(default_factory=list)
    trace: dict[str, Any] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        """Column names."""
        return self.df.columns

    @property
    def rows(self) -> list[tuple]:
        """All rows, on the driver."""
        return [tuple(r) for r in self.df.collect()]

    def to_pandas(self):
        """A pandas frame."""
        return self.df.toPandas()

    def to_arrow(self):
        """An Arrow table."""
        return self.df.toArrow()

    def to_polars(self):
        """A polars frame, if polars is installed."""
        try:
            import polars
        except ImportError as e:
            raise ImportError("to_polars needs the package polars") from e
        return polars.from_arrow(self.to_arrow())

    def to_dicts(self) -> list[dict]:
        """All rows as maps."""
        return [r.asDict() for r in self.df.collect()]

    def show(self, max_rows: int = 40) -> None:
        """Prints up to so many rows."""
        self.df.show(max_rows, truncate=False)

    def __iter__(self):
        return iter(self.rows)

    def __len__(self) -> int:
        return self.df.count()
