"""Contexts that grow: by a stream's micro-batches, or by the rows above a high-water mark.

A context's members lie in a folder as parts, one for each batch, named by its number.  Every so many batches all parts
become a base.  A part or base counts once it is whole, so what a failed batch left is not seen, and a batch that is run
again writes its part again.  Which parts there are is read from the folder, so a new session goes on where the last one
stopped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators.contexts import distinct

#: Batches after which parts become a base.
COMPACT = 16


def parts(spark: SparkSession, folder: str, below: int | None = None) -> list[str]:
    """The newest whole base and the whole parts after it, up to the batch before ``below``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"base": {}, "part": {}}
    for status in fs.listStatus(at) if fs.exists(at) else ():
        m = re.fullmatch(r"(base|part)-(\d+)(-erased)?", status.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")) and (below is None or int(m[2]) < below):
            if m[3] or int(m[2]) not in found[m[1]]:  # a part without erased keys counts before the one that had them
                found[m[1]][int(m[2])] = f"{folder}/{m[0]}"
    base = max(found["base"], default=-1)
    return [p for n, p in found["base"].items() if n == base] + [p for n, p in sorted(found["part"].items()) if n > base]


def _add(engine: Engine, name: str, rows: DataFrame, number: int, folder: str) -> None:
    """Writes a batch (__k, __s and what else is to be kept) as a part and lets the context see it."""
    spark = engine.spark
    rows.write.mode("overwrite").parquet(f"{folder}/part-{number}")
    if number % COMPACT == COMPACT - 1:
        every = spark.read.parquet(*parts(spark, folder))
        rest = [F.max(c).alias(c) for c in every.columns if c not in ("__k", "__s")]
        every.where("__k is not null").groupBy("__k").agg(F.max("__s").alias("__s"), *rest).write.mode("overwrite").parquet(f"{folder}/base-{number}")
    engine.catalog.contexts[name].parts = tuple(parts(spark, folder))


def erase(spark: SparkSession, known: tuple[str, ...], keys: DataFrame) -> tuple[str, ...]:
    """Replaces parts, each under its own name, by what they hold besides the keys of a frame's first column.

    The new part is written beside the old one and counts once it is whole, then it takes the old one's place, so numbers
    of batches stay; what failed half-way is gone on with the next time.  Older parts that a base has replaced are deleted."""
    gone = keys.select(F.col(f"`{keys.columns[0]}`").alias("__k"))
    folder, path = known[0].rpartition("/")[0], spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def settle() -> None:
        for p in parts(spark, folder):
            if p.endswith("-erased"):
                fs.delete(path(p.removesuffix("-erased")), True)
                if not fs.rename(path(p), path(p.removesuffix("-erased"))):
                    raise OSError(f"{p} cannot take the old part's place")

    settle()
    now = parts(spark, folder)
    for p in now:
        spark.read.parquet(p).join(gone, "__k", "left_anti").write.mode("overwrite").parquet(f"{p}-erased")
    settle()
    for status in fs.listStatus(path(folder)):
        if f"{folder}/{status.getPath().getName()}" not in now:
            fs.delete(status.getPath(), True)
    return tuple(now)


def resume(engine: Engine, name: str, folder: str) -> None:
    """Lets a context see the members that an earlier session has kept in the folder."""
    engine.catalog.contexts[name].parts = tuple(parts(engine.spark, folder))


def maintain(engine: Engine, name: str, stream: DataFrame, folder: str, interval: str | None = None, ranking: int | None = None, publish: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps the context ``name`` at all members that a stream of (key, score) has brought; a key's score is its
    largest.  ``interval`` such as "1 second" runs on; without, what is there is read once.

    Each batch is reduced to one row for each key and written as a part.  After each batch ``publish`` is given the
    ``ranking`` members with the highest scores (ties by key): a live ranking.
    """
    key, *score = stream.columns
    typed = stream.selectExpr(f"`{key}` AS __k", f"CAST(`{score[0]}` AS DOUBLE) AS __s" if score else "1.0D AS __s")
    resume(engine, name, f"{folder}/members")

    def merge(batch: DataFrame, number: int) -> None:
        _add(engine, name, distinct(batch), number, f"{folder}/members")
        if publish:
            publish(engine.preview(name, ranking or 20))

    writer = typed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def advance(engine: Engine, name: str, rows: DataFrame, mark: str, folder: str) -> int:
    """Adds to the context ``name`` the members among the rows (key, score or not, and the column ``mark``) whose mark is
    above the highest one so far, and returns their number.  Rows of equal mark must come together; null marks never."""
    spark = engine.spark
    key, *score = [c for c in rows.columns if c != mark]
    known = parts(spark, folder)
    highest = spark.read.parquet(*known).agg(F.max("__mark")).first()[0] if known else None
    fresh = rows.where(F.col(mark).isNotNull())
    fresh = fresh if highest is None else fresh.where(F.col(mark) > F.lit(highest))
    new = fresh.select(F.col(f"`{key}`").alias("__k"), (F.col(f"`{score[0]}`").cast("double") if score else F.lit(1.0)).alias("__s"), F.col(mark).alias("__mark"))
    new = new.where("__k is not null").groupBy("__k").agg(F.max("__s").alias("__s"), F.max("__mark").alias("__mark"))
    number = max((int(p.rpartition("-")[2]) for p in known), default=-1) + 1
    _add(engine, name, new, number, folder)
    return spark.read.parquet(f"{folder}/part-{number}").count()
