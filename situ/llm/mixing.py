"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks.  With weights w that sum to W, block i of a source is released at slot
floor(i W / w) and due by slot ceil((i + 1) W / w); earliest deadline first among released blocks meets every deadline, so
after any number of slots a source is less than one block from its share.  With integer weights the schedule repeats after
W slots, so one period is scheduled and every block's slot follows by arithmetic.  Sources of equal weight have the same
windows, so the period is a list of runs: stretches of slots that go to sources of one weight in the order of their names.

Slots are those of sources that never end.  When a source has ended, its slots stay empty and the others close up: no
document is lost, and those that are left keep their order and so their shares among each other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, id_key, shared_folder, without, written

#: Documents in a block.
BLOCK = 32
#: Runs of a period that are broadcast at most (24 bytes each); a longer period becomes a table that blocks are joined with.
MOST_RUNS = 1 << 20


class Shares:
    """Weights as integers without a common divisor, and sources in classes of equal weight.

    ``weights`` has any positive numbers by source; a float counts as the nearest fraction with a denominator of up to a
    million.  Sources without one have 1.  Making a period takes time in proportion to ``total``, or to its first slots.
    """

    def __init__(self, sources: list[str], weights: Mapping[str, object] | None = None):
        exact = {s: Fraction(str(w)).limit_denominator(10**6) if isinstance(w, float) else Fraction(w) for s, w in (weights or {}).items()}
        if any(w <= 0 for w in exact.values()):
            raise ValueError("weights are positive")
        mine = {s: exact.get(s, Fraction(1)) for s in sorted(sources)}
        whole = math.lcm(*(w.denominator for w in mine.values()))
        common = math.gcd(*(int(w * whole) for w in mine.values())) or 1
        by: dict[int, list[str]] = {}
        for s, w in mine.items():
            by.setdefault(int(w * whole) // common, []).append(s)
        #: Weight and sources of each class, the heaviest first.
        self.classes = sorted(by.items(), reverse=True)
        self.total = sum(w * len(members) for w, members in self.classes)
        #: Of each source: its weight, the number of its first job in a period, and the step to its next one.
        self.jobs: dict[str, tuple[int, int, int]] = {}
        at = 0
        for w, members in self.classes:
            for m, s in enumerate(members):
                self.jobs[s] = (w, at + m, len(members))
            at += w * len(members)

    def runs(self, slots: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(first job, first slot, length) of the runs of one period, or of its first ``slots``, by earliest deadline
        first among released blocks.  A job is one source's block in the period; jobs that follow each other are those of
        sources of equal weight, for the same block number.  Ties go to the heavier source, then to the earlier name."""
        total, first = self.total, []
        at = 0
        for w, members in self.classes:
            first.append(at)
            at += w * len(members)
        later = [(0, c, 0) for c in range(len(self.classes))]
        ready: list[tuple[int, int, int, int]] = []
        slot, stop = 0, min(total, total if slots is None else slots)
        last: tuple[int, int, int] | None = None
        while slot < stop:
            while later and later[0][0] <= slot:
                _, c, i = heapq.heappop(later)
                w = self.classes[c][0]
                heapq.heappush(ready, (-(-(i + 1) * total // w), c, i, 0))
                if i + 1 < w:
                    heapq.heappush(later, ((i + 1) * total // w, c, i + 1))
            deadline, c, i, done = heapq.heappop(ready)
            size = len(self.classes[c][1])
            n = min(size - done, (later[0][0] if later else total) - slot)
            if slot + n > deadline:
                raise AssertionError("a deadline was missed")
            job = first[c] + i * size + done
            if last and last[0] + last[2] == job and last[1] + last[2] == slot:
                last = (last[0], last[1], last[2] + n)
            else:
                if last:
                    yield last
                last = (job, slot, n)
            slot += n
            if done + n < size:
                heapq.heappush(ready, (deadline, c, i, done + n))
        if last:
            yield last


def _numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by source and id; numbers them within the partition and source."""
    pid, source, n = TaskContext.get().partitionId(), None, 0
    for batch in parts:
        names, numbers = batch.column("source").to_pylist(), np.empty(len(batch), np.int64)
        for i, s in enumerate(names):
            if s != source:
                source, n = s, 0
            numbers[i] = n
            n += 1
        yield pa.record_batch([pa.array(np.full(len(batch), pid, np.int32)), batch.column("source"), batch.column("id"), batch.column("copies"), pa.array(numbers)], ["part", "source", "id", "copies", "number"])


def _placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of the mixture; numbers them within the partition."""
    pid, n = TaskContext.get().partitionId(), 0
    for batch in parts:
        yield pa.record_batch([pa.array(np.full(len(batch), pid, np.int32)), *batch.columns, pa.array(np.arange(n, n + len(batch)))], ["part", *batch.schema.names, "at"])
        n += len(batch)


def _offsets(spark: SparkSession, rows: DataFrame, *by: str) -> tuple[DataFrame, dict[str, int]]:
    """Rows of each part (and source) that come before it, and all rows of each source: one row each reaches the driver."""
    total: dict[str, int] = {}
    out = []
    for *names, part, n in sorted(tuple(r) for r in rows.groupBy(*by, "part").agg(F.count("*")).collect()):
        out.append((part, *names, total.get("".join(names), 0)))
        total["".join(names)] = out[-1][-1] + n
    return spark.createDataFrame(out, f"part int, {'source string, ' if by else ''}before long"), total


def _slots(spark: SparkSession, rows: DataFrame, shares: Shares, need: int) -> DataFrame:
    """``rows`` (with the job and the round of each block) with the slot of each."""
    found, kept, path = shares.runs(need), [], None
    schema = pa.schema([("first", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
    for run in found:
        kept.append(run)
        if len(kept) > MOST_RUNS:  # too many to broadcast: on they go to a table, so many at a time
            path = path or shared_folder(spark)
            some = spark.createDataFrame(pa.table([pa.array(c) for c in zip(*kept)], schema=schema))
            some.write.mode("append").parquet(path)
            kept = []
    if path:
        if kept:
            spark.createDataFrame(pa.table([pa.array(c) for c in zip(*kept)], schema=schema)).write.mode("append").parquet(path)
        every = spark.read.schema("first long, start long, n long").parquet(path)
        every = every.select((F.col("start") - F.col("first")).alias("shift"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("job"))
        return rows.join(every, "job").withColumn("slot", F.col("round") * shares.total + F.col("job") + F.col("shift"))
    runs = np.array(sorted(kept), np.int64).reshape(-1, 3)
    known = spark.sparkContext.broadcast((runs[:, 0].copy(), (runs[:, 1] - runs[:, 0]).copy()))  # MOST_RUNS rows at most

    @F.arrow_udf("long")
    def shift(job: pa.Array) -> pa.Array:
        firsts, shifts = known.value
        return pa.array(shifts[np.searchsorted(firsts, job.to_numpy(), "right") - 1])

    return rows.withColumn("slot", F.col("round") * shares.total + F.col("job") + shift("job"))


def schedule(docs: DataFrame, weights: Mapping[str, object] | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each doc_id and source of ``docs``: doc_id, source, copies, block_id, slot, release, deadline, position.

    Weights are positive numbers by source; sources without one, a missing source among them (it counts as a source of
    its own, named ""), have weight 1.  A source's documents are in the order of doc_id (null last), ``block`` of them
    in a block.  slot is the block's place among the blocks of sources that never end; release and deadline are its
    window: release <= slot < deadline.  position (from 0) is the document's place among all documents, by slot.  Rows
    that repeat a doc_id and source share one row; their number is in ``copies``.  An empty table gives an empty schedule.
    Counts by source and partition reach the driver, and one period of the schedule is made there.
    """
    spark = docs.sparkSession
    rows = docs.select(id_key().alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).groupBy("source", "id").agg(F.count("*").alias("copies"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(rows.repartitionByRange(n, "source", "id").sortWithinPartitions("source", "id").mapInArrow(_numbered, "part int, source string, id long, copies long, number long"))
    before, sizes = _offsets(spark, numbered, "source")
    shares = Shares(list(sizes), weights) if sizes else Shares([""])
    need = max((-(-(-(-c // block)) * shares.total // shares.jobs[s][0]) for s, c in sizes.items()), default=0)
    jobs = spark.createDataFrame([(s, *j) for s, j in shares.jobs.items()], "source string, w long, first long, step long")  # one row for each source
    placed = numbered.join(F.broadcast(before), ["part", "source"]).join(F.broadcast(jobs), "source").withColumn("number", F.col("before") + F.col("number"))
    placed = placed.select("id", "source", "copies", "w", "first", "step", F.expr(f"number div {block}").alias("block_id"), (F.col("number") % block).alias("within"))
    placed = placed.withColumns({"job": F.expr("first + (block_id % w) * step"), "round": F.expr("block_id div w")})
    # Decimals: a block's number times all weights may exceed a long.
    window = {"release": F.expr(f"CAST(block_id AS DECIMAL(19,0)) * {shares.total}BD div w"), "deadline": F.expr(f"((CAST(block_id AS DECIMAL(19,0)) + 1BD) * {shares.total}BD + w - 1BD) div w")}
    timed = _slots(spark, placed, shares, need).withColumns(window).select("id", "source", "copies", "block_id", "slot", "release", "deadline", "within")
    ordered = timed.repartitionByRange(n, "slot", "within").sortWithinPartitions("slot", "within")
    out = written(ordered.mapInArrow(_placed, "part int, id long, source string, copies long, block_id long, slot long, release long, deadline long, within long, at long"))
    before, _ = _offsets(spark, out)
    return out.join(F.broadcast(before), "part").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "source", "copies", "block_id", "slot", "release", "deadline", (F.col("before") + F.col("at")).alias("position")
    )


def mix(docs: DataFrame, weights: Mapping[str, object] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all of them and with all columns, in the order of the mixture: partitions follow each other
    in it, and rows within a partition.  Rows that repeat a doc_id and source stay together."""
    spark = docs.sparkSession
    places = written(schedule(docs, weights, block).select(id_key().alias("__id"), F.col("source").alias("__from"), F.col("position").alias("__position")))
    rows = without(docs, "__key", "__source", "__id", "__from", "__position").withColumns({"__key": id_key(), "__source": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    placed = rows.join(places, (F.col("__key") == F.col("__id")) & (F.col("__source") == F.col("__from"))).drop("__key", "__source", "__id", "__from")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "__position").sortWithinPartitions("__position").drop("__position")
