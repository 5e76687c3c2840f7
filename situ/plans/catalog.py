"""Registered queries, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.providers import RowsProvider, ScoreThresholdProvider

TABLES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}
EMBEDDINGS = "embeddings"


def engine(spark: SparkSession, sf_dir: str, **more) -> Engine:
    """An engine with the tables and contexts that the queries use; all of it lazy."""
    e = Engine(spark, **more)
    for name, key in TABLES.items():
        e.register_table(name, f"{sf_dir}/{name}.parquet", primary_key=key)
    e.register_context("open_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'", entity_key="o_orderkey")
    e.register_context("big_order", "SELECT o_orderkey, o_totalprice / 500000.0 AS s FROM orders WHERE o_totalprice >= 400000", entity_key="o_orderkey", score_column="s", has_score=True)
    e.register_context("debtor", "SELECT c_custkey, -c_acctbal / 1000.0 AS s FROM customer WHERE c_acctbal < 0", entity_key="c_custkey", score_column="s", has_score=True)
    e.register_context("late_line", "SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01'", entity_key="l_orderkey")
    e.execute("CREATE CONTEXT above(t DOUBLE DEFAULT 300000) ON o_orderkey AS SELECT o_orderkey FROM orders WHERE o_totalprice > :t")
    e.execute("CREATE CONTEXT placed ON o_orderkey TEMPORAL (o_orderdate, MONTH) AS SELECT o_orderkey, o_orderdate FROM orders")
    for s in ("UNION", "INTERSECT", "WEIGHTED"):
        e.execute(f"CREATE CONTEXT mix_{s.lower()} AS COMPOSE (open_order WEIGHT 0.5, big_order WEIGHT 2.0) WITH STRATEGY {s}")
    e.register_identity_map({"orders.o_orderkey": "lineitem.l_orderkey", "orders.o_custkey": "customer.c_custkey"})
    e.register_mcp_provider("watch", ScoreThresholdProvider({k: (k * 7919 % 1009) / 1008.0 for k in range(1, 301)}, "order"), entity_type="order", entity_key="o_orderkey")
    e.register_remote_provider("desk", RowsProvider({"issues": [{"issue_order": i, "priority": ("low", "high")[i % 2]} for i in range(1, 241)]}))
    e.register_event_log("clicks", "events", case="user_id", activity="event_type", timestamp="ts")
    e.execute("CREATE PROCESS MODEL visit EXPECTED PATH ('view', 'click', 'purchase') EXPECTED PATH ('click', 'view', 'error')")
    return e


# Contexts of the oracles.
_CTX = """open_order AS (SELECT o_orderkey AS k, 1.0::DOUBLE AS s FROM orders WHERE o_orderstatus = 'O'),
big_order AS (SELECT o_orderkey AS k, o_totalprice / 500000.0 AS s FROM orders WHERE o_totalprice >= 400000),
debtor AS (SELECT c_custkey AS k, -c_acctbal / 1000.0 AS s FROM customer WHERE c_acctbal < 0),
late_line AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01'),
watch AS (SELECT i AS k, (i * 7919 % 1009) / 1008.0 AS s FROM range(1, 301) t(i) WHERE (i * 7919 % 1009) / 1008.0 >= 0.5)"""
_OB = f"""WITH {_CTX}, j AS (SELECT o.*, a.k IS NOT NULL AS ma, b.k IS NOT NULL AS mb, a.s AS sa, b.s AS sb
FROM orders o LEFT JOIN open_order a ON o.o_orderkey = a.k LEFT JOIN big_order b ON o.o_orderkey = b.k)"""
_T = "o_orderkey, o_custkey, o_totalprice"
_TRACE = """WITH e AS (SELECT user_id, ts, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
t AS (SELECT user_id, string_agg(event_type, ' -> ' ORDER BY ts, event_type) AS path, min(ts) AS first, max(ts) AS last, count(*) AS n,
min(ts) FILTER (event_type = 'view') AS v, min(ts) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c FROM e GROUP BY user_id)"""
_CASES = "(SELECT DISTINCT user_id FROM events) AS u"


_KIND = """CASE WHEN acts = {0} THEN NULL WHEN list_sort(acts) = list_sort({0}) THEN 'SWAP' WHEN len(acts) < 3 AND list_has_all({0}, acts) THEN 'SKIP'
WHEN len(acts) > 3 AND list_has_all(acts, {0}) THEN 'INSERT' ELSE 'MIXED' END"""
_DEVIATION = f"""WITH e AS (SELECT user_id, ts, event_type AS a FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
t AS (SELECT user_id, list(a ORDER BY ts, a) AS acts, string_agg(CASE a WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'purchase' THEN 'p' WHEN 'error' THEN 'e' ELSE '?' END, '' ORDER BY ts, a) AS s FROM e GROUP BY user_id),
d AS (SELECT *, levenshtein(s, 'vcp') / greatest(length(s), 3) AS x, levenshtein(s, 'cve') / greatest(length(s), 3) AS y FROM t)
SELECT user_id, round(least(x, y), 6) AS score, CASE WHEN x <= y THEN {_KIND.format("['view', 'click', 'purchase']")} ELSE {_KIND.format("['click', 'view', 'error']")} END AS kind FROM d"""


def _round(column: str, name: str, places: int = 6) -> str:
    return f"round({column}, {places}) AS {name}"


def _same(text: str, *types: tuple[str, str]) -> tuple[str, str]:
    """A statement that both engines read alike, but for parts whose type is another."""
    oracle = text
    for a, b in types:
        oracle = oracle.replace(a, b)
    return text, oracle


def _using(strategy: str, oracle: str) -> tuple[str, str]:
    return (
        f"SELECT o_orderkey FROM orders WHERE CONTEXT IN (open_order WEIGHT 0.5, big_order WEIGHT 2.0) ORDER BY CONTEXT USING {strategy} DESC, o_orderkey LIMIT 40",
        f"{_OB} SELECT o_orderkey FROM j WHERE ma OR mb ORDER BY {oracle} DESC NULLS LAST, ma::INT + mb::INT DESC, o_orderkey LIMIT 40",
    )


_MA, _MB = "coalesce(sa, 0)", "coalesce(sb, 0)"
#: name: (statement, oracle); one text where both dialects agree.
SQL: dict[str, tuple[str, str | None]] = {
    "c_flagship": (
        "SELECT o.o_orderkey, c.c_name, o.o_totalprice, round(CONTEXT_SCORE(), 6) AS score, CONTEXT_COUNT() AS n FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE CONTEXT ON o IN (open_order, big_order WEIGHT 1.5) AND CONTEXT ON c IN (debtor WEIGHT 0.5) ORDER BY CONTEXT DESC LIMIT 50",
        f"{_OB} SELECT o_orderkey, c_name, o_totalprice, round({_MA} + 1.5 * {_MB} + 0.5 * d.s, 6) AS score, ma::INT + mb::INT + 1 AS n FROM j JOIN customer ON o_custkey = c_custkey JOIN debtor d ON c_custkey = d.k WHERE ma OR mb ORDER BY {_MA} + 1.5 * {_MB} + 0.5 * d.s DESC, n DESC, o_orderkey LIMIT 50",
    ),
    "c_in": (f"SELECT {_T} FROM orders WHERE CONTEXT IN (open_order)", f"{_OB} SELECT {_T} FROM j WHERE ma"),
    "c_union": (f"SELECT {_T} FROM orders WHERE CONTEXT IN (open_order, big_order)", f"{_OB} SELECT {_T} FROM j WHERE ma OR mb"),
    "c_all": (f"SELECT {_T} FROM orders WHERE CONTEXT IN ALL (open_order, big_order)", f"{_OB} SELECT {_T} FROM j WHERE ma AND mb"),
    "c_not_in": (f"SELECT {_T} FROM orders WHERE CONTEXT NOT IN (open_order, big_order)", f"{_OB} SELECT {_T} FROM j WHERE NOT (ma OR mb)"),
    "c_then": (f"SELECT {_T} FROM orders WHERE CONTEXT IN (open_order THEN big_order)", f"{_OB} SELECT {_T} FROM j WHERE ma AND mb"),
    "c_where": (f"SELECT {_T} FROM orders WHERE o_totalprice > 350000 AND CONTEXT IN (open_order)", f"{_OB} SELECT {_T} FROM j WHERE ma AND o_totalprice > 350000"),
    "c_score": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 6) AS score FROM orders WHERE CONTEXT IN (big_order)", f"{_OB} SELECT o_orderkey, round(sb, 6) AS score FROM j WHERE mb"),
    "c_weight": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 6) AS score FROM orders WHERE CONTEXT IN (open_order WEIGHT 0.25, big_order WEIGHT 2.0)", f"{_OB} SELECT o_orderkey, round(0.25 * {_MA} + 2 * {_MB}, 6) AS score FROM j WHERE ma OR mb"),
    "c_count": ("SELECT o_orderkey, CONTEXT_COUNT() AS n FROM orders WHERE CONTEXT IN (open_order, big_order)", f"{_OB} SELECT o_orderkey, ma::INT + mb::INT AS n FROM j WHERE ma OR mb"),
    "c_score_expr": ("SELECT o_orderkey, round(CONTEXT_SCORE() * 100 + 1, 7) AS pct FROM orders WHERE CONTEXT IN (big_order)", f"{_OB} SELECT o_orderkey, round(sb * 100 + 1, 7) AS pct FROM j WHERE mb"),
    "c_or": (f"SELECT {_T} FROM orders WHERE CONTEXT IN (open_order) OR o_totalprice > 450000", f"{_OB} SELECT {_T} FROM j WHERE ma OR o_totalprice > 450000"),
    "c_not": (f"SELECT {_T} FROM orders WHERE NOT (CONTEXT IN (open_order) OR o_totalprice < 250000)", f"{_OB} SELECT {_T} FROM j WHERE NOT (ma OR o_totalprice < 250000)"),
    "c_on_two": ("SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE CONTEXT ON o IN (open_order) AND CONTEXT ON c IN (debtor)", f"WITH {_CTX} SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN open_order a ON a.k = o_orderkey JOIN debtor d ON d.k = c_custkey"),
    "c_on_score": ("SELECT o.o_orderkey, round(CONTEXT_SCORE(), 6) AS score FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE CONTEXT ON o IN (big_order) AND CONTEXT ON c IN (debtor)", f"WITH {_CTX} SELECT o_orderkey, round(b.s + d.s, 6) AS score FROM orders JOIN big_order b ON b.k = o_orderkey JOIN debtor d ON d.k = o_custkey"),
    "c_using_max": _using("MAX", "greatest(sa, sb)"),
    "c_using_min": _using("MIN", "least(sa, sb)"),
    "c_using_avg": _using("AVG", f"({_MA} + {_MB}) / (ma::INT + mb::INT)"),
    "c_using_sum": _using("SUM", f"{_MA} + {_MB}"),
    "c_using_count": _using("COUNT", "ma::INT + mb::INT"),
    "c_using_weighted_max": _using("WEIGHTED_MAX", "greatest(sa * 0.5, sb * 2.0)"),
    "c_using_weighted_sum": _using("WEIGHTED_SUM", f"(0.5 * {_MA} + 2 * {_MB}) / (0.5 * ma::INT + 2 * mb::INT)"),
    "c_order_asc": ("SELECT o_orderkey FROM orders WHERE CONTEXT IN (big_order) ORDER BY CONTEXT ASC LIMIT 30", f"{_OB} SELECT o_orderkey FROM j WHERE mb ORDER BY sb, o_orderkey LIMIT 30"),
    "c_window": ("WITH CONTEXT WINDOW 100 SELECT o_orderkey, o_totalprice FROM orders WHERE CONTEXT IN (big_order) AND o_orderstatus <> 'F'", f"{_OB} SELECT o_orderkey, o_totalprice FROM (SELECT * FROM j WHERE mb ORDER BY sb DESC, o_orderkey LIMIT 100) WHERE o_orderstatus <> 'F'"),
    "c_window_unscored": ("WITH CONTEXT WINDOW 50 SELECT o_orderkey FROM orders WHERE CONTEXT IN (open_order)", f"{_OB} SELECT o_orderkey FROM j WHERE ma ORDER BY o_orderkey LIMIT 50"),
    "c_identity_map": (f"SELECT {_T} FROM orders WHERE CONTEXT IN (late_line)", f"WITH {_CTX} SELECT {_T} FROM orders JOIN late_line ON k = o_orderkey"),
    "c_multi_entity": (f"SELECT {_T}, round(CONTEXT_SCORE(), 6) AS score FROM orders WHERE CONTEXT IN (debtor)", f"WITH {_CTX} SELECT {_T}, round(s, 6) AS score FROM orders JOIN debtor ON k = o_custkey"),
    "c_mcp": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 6) AS score FROM orders WHERE CONTEXT IN (MCP(watch))", f"WITH {_CTX} SELECT o_orderkey, round(s, 6) AS score FROM orders JOIN watch ON k = o_orderkey"),
    "c_mcp_weight": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 6) AS score FROM orders WHERE CONTEXT IN (MCP(watch) WEIGHT 0.5, big_order WEIGHT 2.0)", f"WITH {_CTX} SELECT o_orderkey, round(0.5 * coalesce(w.s, 0) + 2 * coalesce(b.s, 0), 6) AS score FROM orders LEFT JOIN watch w ON w.k = o_orderkey LEFT JOIN big_order b ON b.k = o_orderkey WHERE w.k IS NOT NULL OR b.k IS NOT NULL"),
    "c_mcp_param": ("SELECT o_orderkey FROM orders WHERE CONTEXT IN (MCP(watch, threshold := 0.9))", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 1 AND 300 AND (o_orderkey * 7919 % 1009) / 1008.0 >= 0.9"),
    "c_remote_join": ("SELECT o.o_orderkey, r.priority FROM orders o JOIN REMOTE(desk.issues) AS r ON o.o_orderkey = r.issue_order WHERE CONTEXT ON o IN (open_order)", f"WITH {_CTX} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'high' ELSE 'low' END AS priority FROM orders JOIN open_order ON k = o_orderkey WHERE o_orderkey BETWEEN 1 AND 240"),
    "c_remote_scan": ("SELECT priority, COUNT(*) AS n FROM REMOTE(desk.issues) AS r GROUP BY priority", "SELECT p AS priority, 120 AS n FROM (VALUES ('low'), ('high')) t(p)"),
    "c_param": ("SELECT o_orderkey FROM orders WHERE CONTEXT IN (above(t := 420000))", "SELECT o_orderkey FROM orders WHERE o_totalprice > 420000"),
    "c_param_default": ("SELECT o_orderkey FROM orders WHERE CONTEXT IN (above)", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000"),
    "c_temporal_at": ("SELECT o_orderkey FROM orders WHERE CONTEXT IN (placed AT '1996-03-15')", "SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1996-03-01'"),
    "c_temporal_between": ("SELECT o_orderkey FROM orders WHERE CONTEXT IN (placed BETWEEN '1995-02-10' AND '1995-04-20')", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-02-01' AND o_orderdate < TIMESTAMP '1995-05-01'"),
    "c_compose_union": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 6) AS s FROM orders WHERE CONTEXT IN (mix_union)", f"{_OB} SELECT o_orderkey, round(greatest(sa, sb), 6) AS s FROM j WHERE ma OR mb"),
    "c_compose_intersect": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 6) AS s FROM orders WHERE CONTEXT IN (mix_intersect)", f"{_OB} SELECT o_orderkey, round(least(sa, sb), 6) AS s FROM j WHERE ma AND mb"),
    "c_compose_weighted": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 6) AS s FROM orders WHERE CONTEXT IN (mix_weighted)", f"{_OB} SELECT o_orderkey, round(greatest(sa * 0.5, sb * 2), 6) AS s FROM j WHERE ma OR mb"),
    "c_group_key": ("SELECT o_custkey, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders WHERE CONTEXT IN (debtor) GROUP BY o_custkey", f"WITH {_CTX} SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN debtor ON k = o_custkey GROUP BY o_custkey"),
    "c_group_prefilter": ("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE CONTEXT IN (open_order) GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1"),
    "c_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE CONTEXT IN (big_order))", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 400000)"),
    "s_project": ("SELECT o_orderkey, o_totalprice * 2 + 1 AS x, o_custkey % 7 AS m, -o_custkey AS neg FROM orders", "SELECT o_orderkey, o_totalprice * 2 + 1 AS x, o_custkey % 7 AS m, -o_custkey AS neg FROM orders"),
    "s_filter": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND NOT o_orderstatus = 'F' OR o_custkey <= 10", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND NOT o_orderstatus = 'F' OR o_custkey <= 10"),
    "s_case": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice BETWEEN 100000 AND 300000 THEN 'middle' ELSE 'small' END AS size FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice BETWEEN 100000 AND 300000 THEN 'middle' ELSE 'small' END AS size FROM orders"),
    "s_cast": ("SELECT o_orderkey, CAST(o_totalprice / 1000 AS BIGINT) AS k, CAST(o_orderkey AS VARCHAR) AS t FROM orders", "SELECT o_orderkey, CAST(o_totalprice / 1000 AS BIGINT) AS k, CAST(o_orderkey AS VARCHAR) AS t FROM orders"),
    "s_concat": ("SELECT c_custkey, c_name || '/' || UPPER(c_mktsegment) AS tag FROM customer", "SELECT c_custkey, c_name || '/' || upper(c_mktsegment) AS tag FROM customer"),
    "s_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_name NOT LIKE '%9'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_name NOT LIKE '%9'"),
    "s_in": ("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_custkey NOT IN (1, 2, 3)", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_custkey NOT IN (1, 2, 3)"),
    "s_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_custkey NOT BETWEEN 5 AND 50", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_custkey NOT BETWEEN 5 AND 50"),
    "s_null": ("SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS st FROM orders WHERE NULLIF(o_orderstatus, 'O') IS NOT NULL", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS st FROM orders WHERE nullif(o_orderstatus, 'O') IS NOT NULL"),
    "s_exists": ("SELECT o_orderkey FROM orders AS o WHERE EXISTS (SELECT l_orderkey FROM lineitem AS l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)", "SELECT o_orderkey FROM orders AS o WHERE EXISTS (SELECT l_orderkey FROM lineitem AS l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)"),
    "s_not_exists": ("SELECT o_orderkey FROM orders AS o WHERE NOT EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_orderkey = o.o_orderkey)", "SELECT o_orderkey FROM orders AS o WHERE NOT EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_orderkey = o.o_orderkey)"),
    "s_in_subq": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "s_scalar_subq": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 AS a FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)"),
    "s_from_subq": ("SELECT q.o_custkey, q.n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS q WHERE q.n > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "s_join_inner": ("SELECT n.n_name, r.r_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "s_join_left": ("SELECT o.o_orderkey, l.l_linenumber FROM orders AS o LEFT JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45"),
    "s_join_right": ("SELECT n.n_name, c.c_custkey FROM (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2) AS n RIGHT OUTER JOIN customer AS c ON n.n_nationkey = c.c_nationkey", "SELECT n_name, c_custkey FROM (SELECT * FROM nation WHERE n_regionkey = 2) RIGHT JOIN customer ON n_nationkey = c_nationkey"),
    "s_join_full": ("SELECT a.n_name AS a, b.n_name AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) AS a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 10) AS b ON a.n_nationkey = b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) AS a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 10) AS b ON a.n_nationkey = b.n_nationkey"),
    "s_join_cross": ("SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "s_join_theta": ("SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "s_agg": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 2) AS q, round(AVG(l_discount), 8) AS d, MIN(l_tax) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 8) AS d, min(l_tax) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2"),
    "s_agg_global": ("SELECT COUNT(*) AS n, round(SUM(o_totalprice), 1) AS s, round(STDDEV_SAMP(o_totalprice), 4) AS sd FROM orders", "SELECT count(*) AS n, round(sum(o_totalprice), 1) AS s, round(stddev_samp(o_totalprice), 4) AS sd FROM orders"),
    "s_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14"),
    "s_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "s_count_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1"),
    "s_win_row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders"),
    "s_win_rank": ("SELECT c_custkey, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM customer", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM customer"),
    "s_win_running": ("SELECT o_orderkey, round(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run FROM orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run FROM orders"),
    "s_win_moving": ("SELECT o_orderkey, round(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS m FROM orders", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS m FROM orders"),
    "s_win_lag": ("SELECT o_orderkey, LAG(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, LEAD(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders", "SELECT o_orderkey, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders"),
    "s_win_range": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM orders"),
    "s_win_groups": ("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders"),
    "s_win_over_agg": ("SELECT o_orderpriority, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY 1"),
    "s_global": ("SELECT n_nationkey, round(n_nationkey / GLOBAL(SUM(n_nationkey)), 8) AS share FROM nation", "SELECT n_nationkey, round(n_nationkey / sum(n_nationkey) OVER (), 8) AS share FROM nation"),
    "s_zscore": ("SELECT c_custkey, round(ZSCORE(c_acctbal), 6) AS z FROM customer", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / nullif(stddev_samp(c_acctbal) OVER (), 0), 6) AS z FROM customer"),
    "s_zscore_ctx": ("SELECT c_custkey, round(ZSCORE(c_acctbal), 6) AS z FROM customer WHERE CONTEXT IN (debtor)", f"WITH {_CTX} SELECT c_custkey, z FROM (SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / nullif(stddev_samp(c_acctbal) OVER (), 0), 6) AS z FROM customer) JOIN debtor ON k = c_custkey"),
    "s_order_nulls": ("SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 12", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 12"),
    "s_limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "s_cte": ("WITH r AS (SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1), n AS (SELECT n_name, n_regionkey FROM nation) SELECT n.n_name, r.r_name FROM n JOIN r ON n.n_regionkey = r.r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 1"),
    "s_union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey AS k FROM nation", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region UNION ALL SELECT n_nationkey FROM nation"),
    "s_intersect": ("SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey AS k FROM region", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region"),
    "s_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey AS k FROM region", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region"),
    "s_functions": ("SELECT c_custkey, LEN(c_name) AS n, STRPOS(c_name, '0') AS p, SUBSTRING(c_name, 1, 4) AS s, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), '-') AS m, GREATEST(c_acctbal, 0) AS g, ABS(c_acctbal) AS a FROM customer", "SELECT c_custkey, len(c_name)::INT AS n, strpos(c_name, '0')::INT AS p, substring(c_name, 1, 4) AS s, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS m, greatest(c_acctbal, 0) AS g, abs(c_acctbal) AS a FROM customer"),
    "s_dates": ("SELECT o_orderkey, YEAR(o_orderdate) AS y, DATE_TRUNC('month', o_orderdate) = TIMESTAMP_NTZ '1996-03-01 00:00:00' AS m FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '100' DAY", "SELECT o_orderkey, year(o_orderdate)::INT AS y, date_trunc('month', o_orderdate) = TIMESTAMP '1996-03-01' AS m FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL 100 DAY"),
    "s_cast2": _same("SELECT n_nationkey, CAST(n_nationkey / 2.0 AS INTEGER) AS a, CAST(n_nationkey * 0.25E0 - 3.5E0 AS BIGINT) AS b, CAST('9007199254740993' AS BIGINT) AS c, CAST(n_nationkey > 5 AS INTEGER) AS d, (n_nationkey * 0.5E0)::SMALLINT AS e, TRY_CAST(n_name AS INTEGER) AS f, n_nationkey::VARCHAR || '!' AS g, CAST('7' AS INT) + 1 AS h FROM nation"),
    "s_strings2": _same("SELECT c_custkey, STRING_SPLIT(c_name, '#')[2] AS a, REGEXP_REPLACE(c_name, '[0-9]', 'x') AS b, REGEXP_REPLACE(c_name, '([0-9])0', '<\\1>', 'g') AS c, REGEXP_EXTRACT(c_name, '[0-9]+') AS d, REGEXP_EXTRACT(c_name, '(0+)([1-9]+)', 2) AS e, CONCAT(c_name, NULL, '/', c_mktsegment) AS f, 'a\\b' || c_mktsegment AS g, SPLIT_PART(c_mktsegment, 'I', 1) AS h, LPAD(c_mktsegment, 12, '*') AS i, REVERSE(c_mktsegment) AS j, STARTS_WITH(c_mktsegment, 'AU') AS k, CONTAINS(c_mktsegment, 'UI') AS l, 'it''s' AS m, REPLACE(c_mktsegment, 'U', '$1') AS n, REGEXP_MATCHES(c_name, '[89]$') AS o FROM customer"),
    "s_dates2": _same("SELECT o_orderkey, DAYOFWEEK(o_orderdate) AS a, ISODOW(o_orderdate) AS b, STRFTIME(o_orderdate, '%Y/%m/%d at %H:%M') AS c, DATE_DIFF('month', o_orderdate, TIMESTAMP '1998-12-01 00:00:00') AS d, DATE_DIFF('day', o_orderdate, TIMESTAMP '1998-12-01 00:00:00') AS e, DATE_PART('dow', o_orderdate) AS f, EPOCH(o_orderdate) AS g, MONTHNAME(o_orderdate) AS h, QUARTER(o_orderdate) AS i, EXTRACT(DAY FROM o_orderdate) AS j, DAYNAME(o_orderdate) AS k, EPOCH_MS(o_orderdate) AS l, DATE_SUB('year', o_orderdate, TIMESTAMP '1998-12-01 00:00:00') AS m, WEEKOFYEAR(o_orderdate) AS n, STRPTIME('03.02.1997', '%d.%m.%Y') < o_orderdate AS o FROM orders"),
    "s_math2": _same("SELECT n_nationkey, round(LOG(n_nationkey + 1), 9) AS a, round(LN(n_nationkey + 1), 9) AS b, n_nationkey // 7 AS c, n_nationkey ** 2 AS d, XOR(n_nationkey, 5) AS e, TRUNC(n_nationkey * 3.7E0 - 20) AS f, POW(n_nationkey, 0.5) AS g, n_nationkey % 4 AS h, round(LOG2(n_nationkey + 1), 9) AS i, SIGN(n_nationkey - 3) AS j, FLOOR(n_nationkey / 7.0) AS k , 2 ** -1 AS m FROM nation"),
    "s_lists": _same("SELECT n_regionkey, LEN(n_name) AS a, [n_nationkey, 7, NULL][2] AS b, ARRAY_LENGTH(RANGE(n_nationkey)) AS c, LIST_SUM(RANGE(2, n_nationkey)) AS d, LIST_CONTAINS([1, 2, n_nationkey], 9) AS e, LIST_MAX(GENERATE_SERIES(1, n_nationkey)) AS f, LIST_POSITION([5, 6, 7], 6) AS g, ARRAY_LENGTH(LIST_DISTINCT([1, 1, n_regionkey])) AS h FROM nation WHERE n_nationkey > 2", ("LIST_SUM(RANGE(2, n_nationkey))", "list_sum(range(2, n_nationkey))::DOUBLE")),
    "s_aggregates2": _same("SELECT n_regionkey, MEDIAN(n_nationkey) AS a, QUANTILE_CONT(n_nationkey, 0.25) AS b, QUANTILE_DISC(n_nationkey, 0.5) AS c, ARRAY_LENGTH(LIST(NULLIF(n_nationkey, 3))) AS d, BOOL_OR(n_nationkey > 20) AS e, ARG_MAX(n_name, n_nationkey) AS f, VAR_POP(n_nationkey) AS g, COUNT_IF(n_nationkey > 9) AS h, ANY_VALUE(NULLIF(n_regionkey, n_regionkey)) AS i, PRODUCT(n_nationkey + 1) AS j, COUNT(*) FILTER (WHERE n_nationkey > 9) AS k FROM nation GROUP BY n_regionkey", ("QUANTILE_DISC(n_nationkey, 0.5)", "quantile_disc(n_nationkey, 0.5)::DOUBLE")),
    "s_within_group": _same("SELECT o_orderstatus, PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS m FROM orders GROUP BY o_orderstatus"),
    "s_rollup": _same("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "s_qualify": _same("SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 100000 QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "c_qualify": ("SELECT o_custkey, o_orderkey FROM orders WHERE CONTEXT IN (open_order) QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", f"{_OB} SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM j) WHERE rn = 1 AND ma"),
    "s_win_named": _same("SELECT o_orderkey, RANK() OVER w AS r, SUM(o_shippriority) OVER w AS s FROM (SELECT o_orderkey, o_custkey, o_orderdate, 1 AS o_shippriority FROM orders) AS x WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "s_win_more": _same("SELECT o_orderkey, round(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 9) AS a, round(CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 9) AS b, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d FROM orders"),
    "s_pareto": ("SELECT c_custkey, round(PARETO_SUM(c_acctbal), 6) AS share FROM customer WHERE c_acctbal > 0", "SELECT c_custkey, round(sum(c_acctbal) OVER (ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) / sum(c_acctbal) OVER (), 6) AS share FROM customer WHERE c_acctbal > 0"),
    "s_cte_nested": _same("WITH a AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey > 3) SELECT x.r_name, y.n_nationkey FROM (WITH b AS (SELECT r_regionkey, r_name FROM region) SELECT b.r_regionkey, b.r_name FROM b JOIN a ON b.r_regionkey = a.n_nationkey - 3) AS x JOIN (SELECT n_nationkey, n_regionkey FROM a) AS y ON x.r_regionkey = y.n_regionkey"),
    "s_using": _same("SELECT a.o_orderkey, b.n FROM orders AS a JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS b USING (o_custkey) WHERE a.o_custkey < 100"),
    "s_case_simple": _same("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS k FROM orders"),
    "s_values": _same("SELECT 1 + 1 AS two, 'a' || 'b' AS ab"),
    "s_zero": ("SELECT n_nationkey, n_regionkey / n_nationkey AS q, n_regionkey % (n_nationkey - 1) AS m FROM nation", "SELECT n_nationkey, n_regionkey / nullif(n_nationkey, 0) AS q, n_regionkey % nullif(n_nationkey - 1, 0) AS m FROM nation"),
    "s_star": _same("SELECT * FROM nation"),
    "c_all_score": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 6) AS score FROM orders WHERE CONTEXT IN ALL (open_order, big_order WEIGHT 3.0)", f"{_OB} SELECT o_orderkey, round(sa + 3 * sb, 6) AS score FROM j WHERE ma AND mb"),
    "c_then_score": ("SELECT o_orderkey, round(CONTEXT_SCORE(), 4) AS score, CONTEXT_COUNT() AS n FROM orders WHERE CONTEXT IN (open_order THEN big_order)", f"{_OB} SELECT o_orderkey, round(sa + sb, 4) AS score, 2 AS n FROM j WHERE ma AND mb"),
    "p_throughput": (f"SELECT u.user_id, unix_micros(TIMESTAMP '1970-01-01 00:00:00' + THROUGHPUT_TIME(u.user_id)) AS us FROM {_CASES}", f"{_TRACE} SELECT user_id, epoch_us(last) - epoch_us(first) AS us FROM t"),
    "p_between": (f"SELECT u.user_id, unix_micros(TIMESTAMP '1970-01-01 00:00:00' + THROUGHPUT_TIME_BETWEEN(u.user_id, 'view', 'purchase') USING EVENT LOG clicks) AS us FROM {_CASES}", f"{_TRACE} SELECT user_id, epoch_us(p) - epoch_us(v) AS us FROM t"),
    "p_path": (f"SELECT u.user_id, PATH_STRING(u.user_id) AS path FROM {_CASES}", f"{_TRACE} SELECT user_id, path FROM t"),
    "p_contains": (f"SELECT u.user_id FROM {_CASES} WHERE PATH_CONTAINS(u.user_id, 'view -> click -> * -> purchase -> error')", f"{_TRACE} SELECT user_id FROM t WHERE regexp_matches(replace(' -> ' || path || ' -> ', ' -> ', ' ->  -> '), ' -> view ->  -> click -> ( -> [a-z_]+ -> )* -> purchase ->  -> error -> ')"),
    "p_rework": (f"SELECT u.user_id, REWORK_COUNT('click', u.user_id) AS n FROM {_CASES}", f"{_TRACE} SELECT user_id, greatest(c - 1, 0)::INT AS n FROM t"),
    "p_start_end": (f"SELECT u.user_id, CASE_START(u.user_id) AS a, CASE_END(u.user_id) AS b FROM {_CASES}", f"{_TRACE} SELECT user_id, first AS a, last AS b FROM t"),
    "p_variant": (f"SELECT v.variant, COUNT(*) AS n FROM (SELECT VARIANT(u.user_id) AS variant FROM {_CASES}) AS v GROUP BY v.variant", f"{_TRACE} SELECT path AS variant, count(*) AS n FROM t GROUP BY 1"),
    "p_activity_count": ("SELECT c.c_custkey, ACTIVITY_COUNT(c.c_custkey) AS n FROM customer AS c", f"{_TRACE} SELECT c_custkey, coalesce(n, 0)::INT AS n FROM customer LEFT JOIN t ON user_id = c_custkey"),
    "p_conforms": (f"SELECT u.user_id, CONFORMS_TO(u.user_id, 'visit') AS ok FROM {_CASES}", f"{_TRACE} SELECT user_id, path IN ('view -> click -> purchase', 'click -> view -> error') AS ok FROM t"),
    "p_deviation": (f"SELECT u.user_id, round(DEVIATION_SCORE(u.user_id, 'visit'), 6) AS score, DEVIATION_TYPE(u.user_id, 'visit') AS kind FROM {_CASES}", _DEVIATION),
}


def _plain(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).execute(SQL[name][0]).df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ranked by contexts of two entities."""
    return _plain("c_flagship")(spark, sf_dir)


def _algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT o.o_orderkey, round(CONTEXT_SCORE(), 6) AS score FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE CONTEXT ON o IN (open_order, big_order) AND CONTEXT ON c IN (debtor)"
    return engine(spark, sf_dir, score_mode="algebra").execute(text).df


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).execute("SELECT round(bin_low, 4) AS bin_low, round(bin_high, 4) AS bin_high, count, round(frequency, 8) AS frequency FROM HISTOGRAM((SELECT o_totalprice FROM orders), 10) AS h").df


def _pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tables import pareto

    return engine(spark, sf_dir).spark.table("customer").where("c_acctbal > 0").transform(pareto, "c_acctbal", "c_custkey").select("c_custkey", F.round("share", 6).alias("share"))


def _cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register_table("embeddings", f"{sf_dir}/embeddings.parquet", primary_key="vec_id")
    return e.execute("SELECT * FROM CLUSTER((SELECT vec_id, embedding FROM embeddings), K := 8) AS c").df


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each vector is with the centre that is nearest to it: centres are the means of their clusters."""
    found = _cluster(spark, sf_dir).where("cluster_id is not null")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").join(found, F.col("vec_id") == F.col("entity_id")).select("vec_id", "cluster_id", "distance", F.posexplode("embedding").alias("i", "x"))
    centres = rows.groupBy("cluster_id", "i").agg(F.avg("x").alias("c"))
    near = rows.join(F.broadcast(centres.withColumnRenamed("cluster_id", "other")), "i")  # as many rows as centres have coordinates
    near = near.groupBy("vec_id", "cluster_id", "other").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("d"), F.max("distance").alias("distance"))
    own = F.max(F.when(F.col("other") == F.col("cluster_id"), F.col("d")))
    # After 20 steps centres may still move a little.
    return near.groupBy("vec_id").agg((own > F.min("d") + 0.05).cast("int").alias("wrong"))


def _ddl(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).execute(text).df


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context kept by a stream of events."""
    from ..streaming.refresh import maintain

    e = engine(spark, sf_dir)
    e.register_context("buyer", "SELECT user_id, value AS s FROM events WHERE event_type = 'purchase'", entity_key="user_id", score_column="s", has_score=True)
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where("event_type = 'purchase'").select("user_id", "value")
    maintain(e, "buyer", stream, e.shared_folder("stream")).awaitTermination()
    return e.execute("SELECT DISTINCT user_id, round(CONTEXT_SCORE(), 6) AS score FROM events WHERE CONTEXT IN (buyer)").df


def _advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context brought forward twice by a high-water mark; the second time sees the rows above the first one's."""
    from ..streaming.refresh import advance

    e = engine(spark, sf_dir)
    e.register_context("buyer", "SELECT user_id, value AS s FROM events WHERE event_type = 'purchase'", entity_key="user_id", score_column="s", has_score=True)
    rows = spark.table("events").where("event_type = 'purchase'").select("user_id", "value", "event_id")
    folder = e.shared_folder("advance")
    for some in (rows.where("event_id < 3000"), rows):
        advance(e, "buyer", some, "event_id", folder)
    return e.members("buyer").select(F.col("__k").alias("user_id"), F.round("__s", 6).alias("score"))


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "c_score_algebra": (_algebra, f"{_OB} SELECT o_orderkey, round(least(greatest(sa, sb), d.s), 6) AS score FROM j JOIN debtor d ON d.k = o_custkey WHERE ma OR mb"),
    "t_histogram": (
        _histogram,
        "WITH e AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, count(*) n FROM orders), c AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9)::INT b, count(*) c FROM orders, e GROUP BY 1) SELECT round(lo + i * ((hi - lo) / 10), 4) AS bin_low, round(lo + (i + 1) * ((hi - lo) / 10), 4) AS bin_high, coalesce(c, 0) AS count, round(coalesce(c, 0) / n, 8) AS frequency FROM e, range(10) r(i) LEFT JOIN c ON b = i",
    ),
    "t_pareto": (_pareto, "SELECT c_custkey, round(sum(c_acctbal) OVER (ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) / sum(c_acctbal) OVER (), 6) AS share FROM customer WHERE c_acctbal > 0"),
    "t_cluster": (_cluster, None),
    "t_cluster_nearest": (
        _nearest,
        "SELECT vec_id, 0 AS wrong FROM embeddings WHERE embedding IS NOT NULL",
    ),
    "d_alter": (_ddl("ALTER CONTEXT open_order RENAME TO still_open; ALTER CONTEXT still_open SET DESCRIPTION 'not shipped'; ALTER CONTEXT still_open SET TAGS ('a', 'b'); SHOW CONTEXTS WHERE name = 'still_open'"), "SELECT 'still_open' AS name, 'o_orderkey' AS entity_key, false AS has_score, false AS is_temporal, 'active' AS state, '' AS classification, 'not shipped' AS description, 'a,b' AS tags, '' AS depends_on"),
    "d_drop": (_ddl("DROP CONTEXT big_order CASCADE; DROP EVENT LOG clicks; DROP PROCESS MODEL visit; SHOW CONTEXTS WHERE NOT is_temporal"), "SELECT * FROM (VALUES ('above', 'o_orderkey', false), ('debtor', 'c_custkey', true), ('late_line', 'l_orderkey', false), ('open_order', 'o_orderkey', false)) t(name, entity_key, has_score), (SELECT false AS is_temporal, 'active' AS state, '' AS classification, '' AS description, '' AS tags, '' AS depends_on)"),
    "d_alter_log": (_ddl("ALTER EVENT LOG clicks ADD ATTRIBUTES ('value', 'props'); ALTER EVENT LOG clicks DROP ATTRIBUTES ('props'); ALTER EVENT LOG clicks SET DESCRIPTION 'visits'; DESCRIBE EVENT LOG clicks"), "SELECT 'clicks' AS name, 'events' AS source, 'user_id' AS case_column, 'event_type' AS activity_column, 'ts' AS timestamp_column, NULL::VARCHAR AS resource_column, 'value' AS attributes, 'visits' AS description"),
    "d_show_contexts": (_ddl("SHOW CONTEXTS LIKE 'mix%'"), "SELECT * FROM (VALUES ('mix_intersect', 'o_orderkey', true, false, 'active', '', '', '', 'open_order,big_order'), ('mix_union', 'o_orderkey', true, false, 'active', '', '', '', 'open_order,big_order'), ('mix_weighted', 'o_orderkey', true, false, 'active', '', '', '', 'open_order,big_order')) t(name, entity_key, has_score, is_temporal, state, classification, description, tags, depends_on)"),
    "d_describe": (_ddl("DESCRIBE CONTEXT above"), "SELECT unnest(['name', 'entity_key', 'definition', 'score', 'temporal', 'parameters', 'state', 'description', 'tags', 'classification', 'depends_on', 'snapshot']) AS property, unnest(['above', 'o_orderkey', 'SELECT o_orderkey FROM orders WHERE o_totalprice > : t', '', '', 't DOUBLE', 'active', '', '', '', '', '']) AS value"),
    "d_explain_context": (_ddl("EXPLAIN CONTEXT mix_union"), f"WITH {_CTX} SELECT * FROM (SELECT 'open_order' AS context, k::VARCHAR AS entity_key, s AS score, true AS member FROM open_order UNION ALL SELECT 'big_order', k::VARCHAR, s, true FROM big_order UNION ALL SELECT 'mix_union', k::VARCHAR, max(s), true FROM (SELECT * FROM open_order UNION ALL SELECT * FROM big_order) GROUP BY k)"),
    "d_show_models": (_ddl("SHOW PROCESS MODELS"), "SELECT 'visit' AS name, NULL::VARCHAR AS event_log, 2 AS n_paths, 'view -> click -> purchase; click -> view -> error' AS paths"),
    "d_show_logs": (_ddl("SHOW EVENT LOGS"), "SELECT 'clicks' AS name, 'events' AS source, 'user_id' AS case_column, 'event_type' AS activity_column, 'ts' AS timestamp_column, NULL::VARCHAR AS resource_column, '' AS attributes, '' AS description"),
    "d_validate": (_ddl("VALIDATE CONTEXT mix_weighted"), "SELECT 'ok' AS status, 'valid' AS message"),
    "d_refresh": (lambda spark, d: (lambda e: (e.execute("REFRESH CONTEXT big_order"), e.members("big_order").select(F.col("__k").alias("k"), F.round("__s", 6).alias("s")))[1])(engine(spark, d)), "SELECT o_orderkey AS k, round(o_totalprice / 500000.0, 6) AS s FROM orders WHERE o_totalprice >= 400000"),
    "x_advance": (_advance, "SELECT user_id, round(max(value), 6) AS score FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND event_id IS NOT NULL GROUP BY user_id"),
    "x_stream_refresh": (_stream, "SELECT user_id, round(max(value), 6) AS score FROM events WHERE event_type = 'purchase' GROUP BY user_id"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name: (session, folder) to frame."""
    return {n: _plain(n) for n in SQL} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by name."""
    return {n: o for n, (_, o) in SQL.items() if o} | {n: o for n, (_, o) in OTHERS.items() if o}
