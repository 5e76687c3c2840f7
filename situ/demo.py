"""A small engine to try: a tool hire's machines, rentals and service events, of any size, made by rule."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .engine import Engine
from .sources.providers import RowsProvider, ScoreThresholdProvider


def demo(spark: SparkSession | None = None, machines: int = 200) -> Engine:
    """An engine with three tables of lazy rows, four contexts, two providers and an event log."""
    e = Engine(spark)
    ids = e.spark.range(1, machines + 1)
    e.register_table("machines", ids.selectExpr("id AS machine_id", "element_at(array('drill', 'saw', 'lift', 'pump'), CAST(id % 4 AS INT) + 1) AS kind", "id * 37 % 90 + 10 AS hours"), primary_key="machine_id", alias="m")
    rentals = e.spark.range(1, 5 * machines + 1)
    e.register_table("rentals", rentals.selectExpr("id AS rental_id", f"id * 7 % {machines} + 1 AS machine_id", "id * 13 % 400 + 20.0 AS fee", "timestamp_seconds(1700000000 + id * 3600) AS since", "id % 9 = 0 AS late"), primary_key="rental_id", alias="r")
    steps = "element_at(array('booked', 'handed', 'returned', 'repaired'), step + 1)"
    e.register_table("service", rentals.selectExpr("id AS rental_id", "explode(sequence(0, CAST(2 + id % 2 AS INT))) AS step").selectExpr("rental_id", f"{steps} AS activity", "timestamp_seconds(1700000000 + rental_id * 3600 + step * 600) AS at"))
    e.register_context("worn", "SELECT machine_id, hours / 100.0 AS wear FROM machines WHERE hours > 70", entity_key="machine_id", has_score=True, score_column="wear")
    e.register_context("lifts", "SELECT machine_id FROM machines WHERE kind = 'lift'", entity_key="machine_id")
    e.register_context("overdue", "SELECT rental_id, fee / 420.0 AS weight FROM rentals WHERE late", entity_key="rental_id", has_score=True, score_column="weight")
    e.execute("CREATE CONTEXT costly(least DOUBLE DEFAULT 300) ON rental_id AS SELECT rental_id FROM rentals WHERE fee > :least")
    e.register_mcp_provider("inspector", ScoreThresholdProvider({k: k * 29 % 101 / 100 for k in range(1, machines + 1)}, "machine"), entity_type="machine", entity_key="machine_id")
    e.register_remote_provider("depot", RowsProvider({"spares": [{"kind": k, "spares": n} for k, n in (("drill", 3), ("saw", 0), ("lift", 1), ("pump", 7))]}))
    e.register_event_log("hire", "service", case="rental_id", activity="activity", timestamp="at")
    e.execute("CREATE PROCESS MODEL smooth EXPECTED PATH ('booked', 'handed', 'returned')")
    return e
