"""Process functions as SQL over a case's trace: an array of (ts, seq, activity, resource) in the order of time.

Events without case, activity or time are left out.  Events at the same time are ordered by activity, then resource.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import EventLog, ProcessModel


def traces(events: DataFrame, log: EventLog) -> DataFrame:
    """One row for each case: case_id and its trace.  One shuffle by case; a case's events are one array."""
    resource = F.col(log.resource) if log.resource else F.lit(None)
    rows = events.select(F.col(log.case).alias("case_id"), F.col(log.timestamp).alias("ts"), F.col(log.activity).cast("string").alias("activity"), resource.cast("string").alias("resource"))
    rows = rows.where("case_id is not null and ts is not null and activity is not null")
    return rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ts", "activity", "resource"))).alias("trace"))


def times(events: DataFrame, log: EventLog, columns: dict[str, str]) -> DataFrame:
    """One row for each case: case_id and aggregates of its events (ts, activity), which are summed up where they lie."""
    rows = events.select(F.col(log.case).alias("case_id"), F.col(log.timestamp).alias("ts"), F.col(log.activity).cast("string").alias("activity"))
    rows = rows.where("case_id is not null and ts is not null and activity is not null")
    return rows.groupBy("case_id").agg(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def short(name: str, t: str, args: list[str], columns: dict[str, str]) -> str | None:
    """The SQL of a function that needs no whole trace, over the aggregates that it adds to ``columns``; else None."""

    def need(sql: str) -> str:
        found = next((c for c, s in columns.items() if s == sql), f"a{len(columns)}")
        columns[found] = sql
        return f"{t}.{found}"

    if name in ("CASE_START", "CASE_END"):
        return need("min(ts)" if name == "CASE_START" else "max(ts)")
    if name == "THROUGHPUT_TIME":
        return f"({need('max(ts)')} - {need('min(ts)')})"
    if name == "ACTIVITY_COUNT":
        return f"coalesce(CAST({need('count(*)')} AS INT), 0)"
    if name == "THROUGHPUT_TIME_BETWEEN" and all(a[:1] == "'" for a in args):
        first, last = (need(f"min(ts) FILTER (WHERE activity = {a})") for a in args)
        return f"({last} - {first})"
    if name == "REWORK_COUNT" and args[0][:1] == "'":
        return f"CAST(IF({t}.case_id IS NULL, NULL, greatest({need(f'count(*) FILTER (WHERE activity = {args[0]})')} - 1, 0)) AS INT)"
    return None


def literal(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def path_regex(pattern: str) -> str:
    """A pattern of activities joined by -> (directly follows), with * for any activities, as a regular expression over
    a path whose activities each stand between line feeds."""
    steps = [s.strip() for s in pattern.split("->")]
    out = "".join("(?:\\n[^\\n]*\\n)*" if s == "*" else f"\\n{re.escape(s)}\\n" for s in steps)
    return out


def path_contains(t: str, pattern: str) -> str:
    """Whether the trace has the pattern."""
    framed = f"array_join(transform({t}.trace, e -> concat('\\n', e.activity, '\\n')), '')"
    return f"IF({t}.trace IS NULL, NULL, {framed} RLIKE {literal(path_regex(pattern))})"


def acts(t: str) -> str:
    """The trace's activities."""
    return f"transform({t}.trace, e -> e.activity)"


def first_of(t: str, activity: str) -> str:
    """When an activity first happened."""
    return f"array_min(transform(filter({t}.trace, e -> e.activity = {activity}), e -> e.ts))"


def call(name: str, t: str, args: list[str], model: ProcessModel | None = None) -> str:
    """The SQL of a process function; ``args`` are its arguments without the case."""
    path = f"array_join({acts(t)}, ' -> ')"
    last = f"element_at({t}.trace, -1).ts"
    if name == "THROUGHPUT_TIME":
        return f"({last} - {t}.trace[0].ts)"
    if name == "THROUGHPUT_TIME_BETWEEN":
        return f"({first_of(t, args[1])} - {first_of(t, args[0])})"
    if name in ("PATH_STRING", "VARIANT"):
        return path
    if name == "CASE_START":
        return f"{t}.trace[0].ts"
    if name == "CASE_END":
        return last
    if name == "ACTIVITY_COUNT":
        return f"coalesce(size({t}.trace), 0)"
    if name == "REWORK_COUNT":
        return f"IF({args[0]} IS NULL OR {t}.trace IS NULL, NULL, greatest(size(filter({t}.trace, e -> e.activity = {args[0]})) - 1, 0))"
    paths = model.paths
    if name == "CONFORMS_TO":
        return f"array_contains(array({', '.join('array(' + ', '.join(map(literal, p)) + ')' for p in paths)}), {acts(t)})"
    # Activities become characters, so that the distance of paths is one of strings; what no path has becomes one more.
    known = list(dict.fromkeys(a for p in paths for a in p))
    code = {a: chr(0x4E00 + i) for i, a in enumerate(known)}
    cases = " ".join(f"WHEN {literal(a)} THEN '{c}'" for a, c in code.items())
    coded = f"array_join(transform({t}.trace, e -> CASE e.activity {cases} ELSE '?' END), '')"
    strings = ["".join(code[a] for a in p) for p in paths]
    scores = [f"levenshtein({coded}, '{s}') / CAST(greatest(length({coded}), {max(1, len(s))}) AS DOUBLE)" for s in strings]
    best = scores[0] if len(scores) == 1 else f"least({', '.join(scores)})"
    if name == "DEVIATION_SCORE":
        return best
    kinds = []
    for p, score in zip(paths, scores):
        want = f"array({', '.join(map(literal, p))})"
        kinds.append(
            f"WHEN {score} = {best} THEN CASE WHEN {acts(t)} = {want} THEN NULL WHEN array_sort({acts(t)}) = array_sort({want}) THEN 'SWAP' "
            f"WHEN size({acts(t)}) < {len(p)} AND size(array_except({acts(t)}, {want})) = 0 THEN 'SKIP' "
            f"WHEN size({acts(t)}) > {len(p)} AND size(array_except({want}, {acts(t)})) = 0 THEN 'INSERT' ELSE 'MIXED' END"
        )
    return f"IF({t}.trace IS NULL, NULL, CASE {' '.join(kinds)} END)"


#: The functions and the place of their case argument.
FUNCTIONS = {
    "THROUGHPUT_TIME": 0, "THROUGHPUT_TIME_BETWEEN": 0, "PATH_STRING": 0, "VARIANT": 0, "CASE_START": 0, "CASE_END": 0, "ACTIVITY_COUNT": 0,
    "PATH_CONTAINS": 0, "REWORK_COUNT": 1, "CONFORMS_TO": 0, "DEVIATION_SCORE": 0, "DEVIATION_TYPE": 0,
}
