"""What the operators share: tables that cut lineage, ids, components of a graph."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the bytes 20, 09 to 0D.
WHITE = " \t\n\x0b\f\r"
#: Stands for a missing doc_id, which counts as the largest.
NO_ID = (1 << 63) - 1
#: Lower-cases A to Z and nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Folders that this process has had written, for remove_written.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Where that is unset, a local session gets a folder of this machine, which
    all its threads share; on a cluster that is an error, as no executor could read another's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='situ-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/situ-{uuid.uuid4().hex}")
    return _made[-1]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path objects of a path, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_written(spark: SparkSession) -> None:
    """Deletes all that shared_folder has named so far: for the end of a job, when its results are written elsewhere."""
    while _made:
        fs, at = file_system(spark, _made.pop())
        fs.delete(at, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows, read again from a table in the shared folder: it survives the loss of executors and cuts lineage."""
    path = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_key(column: str = "doc_id") -> Column:
    """A doc_id that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_or_null(key: Column) -> Column:
    """The doc_id of a key."""
    return F.when(key != NO_ID, key)


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers are kept, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The columns that none of the names stands for, in whatever case: operators replace columns of their own names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken])


def join_hot(rows: DataFrame, known: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``known``, whose column ``size`` says how many of the rows have its keys.

    Keys that hold more than a part in ``share`` of these rows are fewer than ``share``, so these rows of ``known`` are
    broadcast; only the others are shuffled, and no key's rows ever meet in one task.
    """
    total = known.agg(F.sum(size)).first()[0] or 0
    least = max(1000, total // share)
    hot = known.where(F.col(size) > least)
    if hot.isEmpty():
        return rows.join(known, keys)
    hot = F.broadcast(hot)  # fewer than ``share`` rows
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(known.where(F.col(size) <= least), keys)
    return rows.join(hot, keys).unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is the smallest node that is reachable.

    Alternates large-star and small-star steps until nothing changes, which takes rounds in the logarithm of the nodes.
    Each step is an aggregation by node that keeps one minimum and joins it back, so no neighbourhood is ever gathered in
    one place; each round is written to the shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        # Large star: every larger neighbour of a node links to the smallest of the node and its neighbours.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small)
        total = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if total == last:
            break
        last = total
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
