"""The engine: registration, statements, explanation."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import governance, linter
from .builder import QueryBuilder
from .catalog import Catalog, Context, EventLog, Provider, Table
from .errors import Diagnostic, SituError
from .lexer import Token, render, statements, tokens
from .operators.contexts import distinct, resolve
from .plans.ddl import run as run_ddl
from .plans.select import Planner
from .result import Result
from .sources.providers import timed


class Engine:
    """Runs statements on a Spark session.

    ``score_mode`` is additive (weighted scores are summed) or algebra (MAX, MIN by predicate).  ``strict`` makes scores
    without a context predicate an error.  ``mcp_timeout_mode`` is warn, error or empty.
    """

    def __init__(self, spark: SparkSession | None = None, *, score_mode: str = "additive", strict: bool = False, mcp_timeout: float = 30.0, remote_timeout: float = 30.0, mcp_timeout_mode: str = "warn", config: Mapping[str, str] | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.catalog, self.score_mode, self.strict = Catalog(), score_mode, strict
        self.mcp_timeout, self.remote_timeout, self.mcp_timeout_mode = mcp_timeout, remote_timeout, mcp_timeout_mode
        self.catalog.conf.update(config or {})
        self.principal: str | None = None
        self.session: dict[str, Any] = {}
        self.diagnostics: list[Diagnostic] = []

    # -- registration -------------------------------------------------------------------------------------------
    def to_frame(self, data: Any) -> DataFrame:
        """A Spark frame of a Spark, pandas or Arrow table, a list of maps, or the path of a Parquet file."""
        if isinstance(data, DataFrame):
            return data
        return self.spark.read.parquet(data) if isinstance(data, str) else self.spark.createDataFrame(data)

    def register_table(self, name: str, data: Any, *, primary_key: str | None = None, alias: str | None = None) -> None:
        """Makes a table known; its frame stays lazy."""
        df = self.to_frame(data)
        df.createOrReplaceTempView(name)
        self.catalog.tables[name] = Table(name, primary_key, alias, {f.name: f.dataType.simpleString() for f in df.schema})

    def unregister_table(self, name: str) -> None:
        """Forgets a table."""
        del self.catalog.tables[name]
        self.spark.catalog.dropTempView(name)

    def register_context(self, name: str, sql: str | DataFrame, *, entity_key: str, has_score: bool = False, score_column: str | None = None, replace: bool = True, **more: Any) -> Context:
        """Makes a context known: a query or a frame that gives keys, and a score if it has one.  The query is analysed
        now and runs when a statement uses the context."""
        if not replace and name in self.catalog.contexts:
            raise SituError("E113", f"context {name} exists")
        if has_score and not score_column:
            raise SituError("E206", f"context {name} has a score but no score column")
        known = {f.name for f in fields(Context)}
        ctx = Context(name, entity_key, score_column=score_column, **{k: v for k, v in more.items() if k in known})
        if isinstance(sql, DataFrame):
            ctx.frame = sql
        else:
            ctx.body = sql.strip().rstrip(";")
        self.catalog.contexts[name] = ctx
        if not ctx.params:
            try:
                self.typed(ctx)
            except Exception:
                del self.catalog.contexts[name]
                raise
        return ctx

    def typed(self, ctx: Context) -> None:
        """Analyses a context and notes the type of its key; its score must be a number."""
        ctx.key_type = resolve(self, ctx).schema["__k"].dataType.simpleString()

    def context(self, name: str, *, entity_key: str, has_score: bool = False, score_column: str | None = None) -> Callable:
        """Decorator: the function returns the context's query or frame."""

        def register(f: Callable) -> Callable:
            self.register_context(name, f(), entity_key=entity_key, has_score=has_score, score_column=score_column)
            return f

        return register

    def register_event_log(self, name: str, source: str, *, case: str, activity: str, timestamp: str, resource: str | None = None) -> EventLog:
        """Makes an event log known."""
        columns = {c.lower() for c in self.spark.table(source).columns}
        if missing := [c for c in (case, activity, timestamp, resource) if c and c.lower() not in columns]:
            raise SituError("E210", f"{source} has no column {', '.join(missing)}")
        self.catalog.logs[name] = EventLog(name, source, case, activity, timestamp, resource)
        return self.catalog.logs[name]

    def register_mcp_provider(self, name: str, provider: Any, *, entity_type: str | None = None, entity_key: str | None = None, **options: Any) -> None:
        """Makes a provider of memberships known."""
        self.catalog.providers[name] = Provider(name, "mcp", provider, entity_type, entity_key, options)

    def register_remote_provider(self, name: str, provider: Any, **options: Any) -> None:
        """Makes a provider of rows known."""
        self.catalog.providers[name] = Provider(name, "remote", provider, options=options)

    def register_identity_map(self, mapping: Mapping[str, str]) -> None:
        """Equates columns of tables: {"t.a": "u.b"} works both ways."""
        self.catalog.identity += list(mapping.items())

    def register_identities(self, data: Any, left: str, right: str, confidence: str | None = None) -> None:
        """Equates keys of two systems row by row: with SET identity_mode = 'federated', a context by one of the columns
        serves queries that have the other, its scores times the confidence.  Rows below the setting identity_confidence
        are not taken."""
        self.catalog.identities.append(governance.Identities(self.to_frame(data), left, right, confidence))

    def add_row_policy(self, table: str, condition: str, *principals: str) -> None:
        """Lets some principals, or all, see only a table's rows that meet a condition in Spark SQL, in which session.name
        is a value of ``session``.  The condition stands where the table is read, so it is pushed down to the scan; the
        definitions of contexts see all rows, as their members are the same for everybody."""
        self.catalog.policies.append(governance.RowPolicy(table, condition, principals))

    def visible(self, table: str, busy: tuple[str, ...] = ()) -> DataFrame:
        """A table's rows that the principal may see."""
        some = "" if busy else governance.condition(self.catalog.policies, table, self.principal, {k.lower(): v for k, v in self.session.items()})
        return self.spark.table(table).where(some) if some else self.spark.table(table)

    def may(self, privilege: str, name: str) -> bool:
        """Whether the current principal may use a context."""
        try:
            self.authorise(privilege, name)
        except SituError:
            return False
        return True

    def authorise(self, privilege: str, name: str) -> None:
        """Fails if the current principal was not granted the use of a context.  It is asked wherever members are read, and
        counts once anything has been granted and a principal is set."""
        mine = [g for g in self.catalog.grants if g[1].lower() == f"context {name}".lower()]
        if self.principal and self.catalog.grants and not any(p in (privilege, "ALL") and who.lower() == self.principal.lower() for p, _, who in mine):
            raise SituError("E208", f"{self.principal} may not use context {name}")

    # -- sources ------------------------------------------------------------------------------------------------
    def fetch_members(self, source: Provider, args: Mapping[str, str], planner: Planner) -> DataFrame:
        """A provider's members as (__k, __s)."""
        literal = lambda v: v[1:-1] if v[:1] == "'" else float(v) if v.replace(".", "", 1).isdigit() else v
        began = time.time()
        if source.impl is None:
            raise SituError("E204", f"provider {source.name} has no implementation", "register_mcp_provider gives it one")
        try:
            got = timed(lambda: source.impl.resolve(source.entity_type, {k: literal(v) for k, v in args.items()}, None), float(source.options.get("timeout", self.mcp_timeout)))
        except TimeoutError as e:
            if source.options.get("on_failure", self.mcp_timeout_mode) == "error":
                raise RuntimeError(f"provider {source.name}: {e}") from e
            if source.options.get("on_failure", self.mcp_timeout_mode) == "warn":
                self.diagnostics.append(Diagnostic("W101", f"provider {source.name}: {e}; it has no members"))
            return self.spark.createDataFrame([], "__k string, __s double")
        if source.entity_type and got.entity_type and got.entity_type != source.entity_type:
            raise SituError("E302", f"provider {source.name} gives {got.entity_type}, not {source.entity_type}")
        if isinstance(got.entity_ids, DataFrame):  # any number of members, which executors read
            key, *score = got.entity_ids.columns
            planner.trace["providers"].append({"name": source.name, "count": None, "ms": (time.time() - began) * 1000})
            return distinct(got.entity_ids.selectExpr(f"`{key}` AS __k", f"CAST(`{score[0]}` AS DOUBLE) AS __s" if score else "1.0D AS __s"))
        scores = got.scores if got.scores is not None else [1.0] * len(got.entity_ids)
        planner.trace["providers"].append({"name": source.name, "count": len(got.entity_ids), "ms": (time.time() - began) * 1000})
        best: dict[Any, float] = {}
        for k, s in zip(got.entity_ids, scores):
            if k is not None:
                best[k] = max(best.get(k, float("-inf")), float(s))
        kind = "long" if best and all(isinstance(k, int) for k in best) else "string"
        return self.spark.createDataFrame([(k if kind == "long" else str(k), s) for k, s in best.items()], f"__k {kind}, __s double")

    def fetch_remote(self, name: str, planner: Planner, filters: Mapping[str, Any] | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """A remote resource's rows: provider.resource.  Filters, columns and limit are hints: what the provider does not
        use of them, the query does.  A provider that gives a Spark frame is read by executors."""
        provider, _, resource = name.partition(".")
        source = self.catalog.providers[provider]
        began = time.time()
        if source.impl is None:
            raise SituError("E204", f"provider {provider} has no implementation", "register_remote_provider gives it one")
        try:
            rows = timed(lambda: source.impl.query(resource, dict(filters or {}), list(columns or []), limit), float(source.options.get("timeout", self.remote_timeout)))
        except TimeoutError as e:
            raise RuntimeError(f"provider {provider}: {e}") from e
        planner.trace["providers"].append({"name": name, "ms": (time.time() - began) * 1000, "filters": dict(filters or {}), "columns": list(columns or []), "limit": limit})
        return self.to_frame(rows)

    def event_log(self, name: str | None, tables: list[str]) -> EventLog:
        """The named log, the default one, or the only one over these tables; several are E105."""
        name = name or self.catalog.conf.get("default_event_log")
        if name:
            return self.catalog.logs[name]
        found = [x for x in self.catalog.logs.values() if x.source.lower() in tables] or list(self.catalog.logs.values())
        if len(found) != 1:
            raise SituError("E105" if found else "E202", "several event logs match" if found else "no event log is known")
        return found[0]

    # -- statements ---------------------------------------------------------------------------------------------
    def frame(self, sql: str, params: Mapping[str, str | None] | None = None, busy: tuple[str, ...] = (), extra: str | None = None) -> DataFrame:
        """A query's frame; ``params`` are SQL values for :name, or for a bare name that stands for no column."""
        return self._plan(self._bound(tokens(sql), params or {}), busy, extra)[0]

    def _bound(self, parts: list[Token], params: Mapping[str, str | None]) -> list[Token]:
        out: list[Token] = []
        for i, t in enumerate(parts):
            if t.text == ":" and i + 1 < len(parts) and parts[i + 1].value.lower() in params:
                continue
            if t.kind == "name" and t.value.lower() in params and (i + 1 >= len(parts) or parts[i + 1].text not in (".", "(")) and (not i or parts[i - 1].text not in (".",) and parts[i - 1].up != "AS"):
                out += tokens(f"({params[t.value.lower()]})")
            else:
                out.append(t)
        return out

    def _plan(self, parts: list[Token], busy: tuple[str, ...] = (), extra: str | None = None) -> tuple[DataFrame, str, Planner]:
        planner = Planner(self)
        try:
            sql = planner.query(parts, None, busy, extra)
            return self.spark.sql(sql), sql, planner
        finally:
            for v in planner.temporary:  # the frame is analysed, and needs the views no more
                self.spark.catalog.dropTempView(v)

    def execute(self, sql: str) -> Result:
        """Runs all statements of a text; the result is the last one's."""
        found = statements(sql)
        if not found:
            raise SituError("E001", "no statement")
        out = None
        for parts in found:
            out = self._execute(parts, sql)
        return out

    def _execute(self, parts: list[Token], sql: str) -> Result:
        self.diagnostics = []
        first = parts[0].up
        if first in ("SELECT", "WITH", "(", "VALUES"):
            df, plan, planner = self._plan(parts)
            self.diagnostics += [d for d in linter.lint(render(parts), self.catalog) if d.code not in ("E107", "E108")]
            return Result(df, sql, plan, list(self.diagnostics), planner.trace)
        df = run_ddl(self, parts)
        previous = self.catalog.audit[-1][-1] if self.catalog.audit else ""
        text = render(parts)
        entry = (len(self.catalog.audit), time.time(), self.principal or "", text)
        self.catalog.audit.append((*entry, hashlib.sha256(f"{previous}|{entry}".encode()).hexdigest()))
        return Result(df, sql, diagnostics=list(self.diagnostics))

    def lint(self, sql: str) -> list[Diagnostic]:
        """Findings about a text."""
        return linter.lint(sql, self.catalog)

    def explain(self, sql: str) -> str:
        """The statement's Spark SQL, its contexts and Spark's plan."""
        df, plan, planner = self._plan(statements(sql)[0])
        physical = df._jdf.queryExecution().toString()
        return f"== Contexts ==\n{', '.join(planner.trace['contexts']) or 'none'}\n== Spark SQL ==\n{plan}\n{physical}"

    def query(self, table: str, alias: str | None = None) -> QueryBuilder:
        """A query builder."""
        return QueryBuilder(self, table, alias)

    # -- contexts as data ---------------------------------------------------------------------------------------
    def members(self, name: str, **args: Any) -> DataFrame:
        """A context's keys and scores."""
        return resolve(self, self.catalog.contexts[name], {k: repr(v) for k, v in args.items()})

    def preview(self, name: str, n: int = 20) -> DataFrame:
        """Some members, highest score first."""
        return self.members(name).orderBy(F.desc_nulls_last("__s"), "__k").limit(n)

    def refresh(self, name: str, args: Mapping[str, str] | None = None) -> str:
        """Writes a context's members to a new snapshot, which then serves it; returns the snapshot before."""
        ctx = self.catalog.contexts[name]
        before, ctx.snapshot = ctx.snapshot, None
        path = self.shared_folder(f"context-{ctx.name}")
        ctx.state = "refreshing"
        resolve(self, ctx, dict(args or {})).write.parquet(path)
        ctx.snapshot, ctx.refreshed_at, ctx.state = path, time.time(), "active"
        for d in self.catalog.dependents(name):
            if self.catalog.contexts[d].snapshot:
                self.catalog.contexts[d].state = "stale"
        return before or ""

    def shared_folder(self, name: str) -> str:
        """A new folder below spark.checkpoint.dir, or where that is unset, below the warehouse of a local session."""
        folder = self.spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            master = self.spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = self.spark.conf.get("spark.sql.warehouse.dir")
        return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def refresh_due(self, now: float | None = None) -> list[str]:
        """Refreshes the contexts whose schedule has come, in order of dependence: for a timer to call."""
        names = governance.due(self, now)
        for n in names:
            self.refresh(n)
        return names

    def diff(self, name: str, before: str) -> DataFrame:
        """Keys that joined and left a context since an earlier snapshot."""
        now, old = self.members(name), self.spark.read.parquet(before)
        joined = now.join(old, "__k", "left_anti").select("__k", F.lit("added").alias("change"))
        return joined.union(old.join(now, "__k", "left_anti").select("__k", F.lit("removed").alias("change")))

    def erase(self, name: str, keys: DataFrame) -> None:
        """Rewrites a context's snapshot and the parts that batches brought without some keys (the frame's first column),
        and deletes the old files.  A stream that keeps the context must not run meanwhile."""
        ctx = self.catalog.contexts[name]
        if ctx.parts:
            from .streaming.refresh import erase

            ctx.parts = erase(self.spark, ctx.parts, keys)
        if ctx.snapshot:
            kept = self.spark.read.parquet(ctx.snapshot).join(keys.select(F.col(keys.columns[0]).alias("__k")), "__k", "left_anti")
            path = f"{ctx.snapshot}-{uuid.uuid4().hex[:8]}"
            kept.write.parquet(path)
            old, ctx.snapshot = self.spark._jvm.org.apache.hadoop.fs.Path(ctx.snapshot), path
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
