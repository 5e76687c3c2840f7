"""Exact duplicates against a persistent index of digests.

The index is a folder: rows bucketed and sorted by digest, and a manifest of the additions that are complete.  It is found
by its path alone, so any session can go on with it.  New rows are reduced to one for each digest by partial aggregation, a
sort-merge anti-join by digest, for which the index is not shuffled, finds those that the index lacks, and these are
appended.  What an addition wrote before it failed is not in the manifest and is never read; an addition that is run again
is known by its batch and changes nothing.  DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, id_key, id_or_null, join_hot, shared_folder, without, written

#: Buckets of an index; a bucket of 100 TB of text has digests of some 30 million documents.
BUCKETS = 1024
_OWN = ("__key", "__sha", "__n", "__id", "__digest", "__chars")
_ROWS = "digest string, id long, n_chars long, batch string, addition string"


def digest(column: str = "text") -> Column:
    """SHA-256 (lowercase hexadecimal) of a text's UTF-8 without ASCII white space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "").cast("binary"), 256)


class DigestIndex:
    """A table (digest, id, n_chars, batch) with one row for each digest, below a folder.

    One writer at a time; readers see whole additions.  ``buckets`` counts for a new index, an old one has its own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path or shared_folder(spark), buckets
        self.table = f"digests_{hashlib.sha1(self.path.encode()).hexdigest()}"

    def exists(self) -> bool:
        """Whether an addition is complete."""
        return bool(self._additions())

    def _additions(self) -> list[tuple[str, str]]:
        """The manifest's (addition, batch), of which there are as many as batches were added."""
        fs, at = file_system(self.spark, f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        found = self.spark.read.schema("addition string, batch string, buckets int").parquet(f"{self.path}/manifest").collect()
        self.buckets = found[0].buckets if found else self.buckets
        return [(r.addition, r.batch) for r in found]

    def _open(self) -> None:
        """Tells this session's catalog of the folder, which has what is known of the index."""
        if not self.spark.catalog.tableExists(self.table):
            self.spark.sql(f"CREATE TABLE {self.table} ({_ROWS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def rows(self) -> DataFrame:
        """The index, bucketed by digest; empty if nothing was added yet."""
        complete = [a for a, _ in self._additions()]
        self._open()
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table).where(F.col("addition").isin(complete)).drop("addition")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Appends the best row (digest, id, n_chars) of each digest that the index lacks: the one with the most code
        points, then the smallest id.  A batch that was added before is left as it is."""
        if batch in {b for _, b in self._additions()}:
            return
        self._open()
        best = rows.groupBy("digest").agg(F.max(F.struct("n_chars", (-F.col("id")).alias("minus"))).alias("b"))
        fresh = best.repartition(self.buckets, "digest").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        addition = uuid.uuid4().hex
        fresh = fresh.select("digest", (-F.col("b.minus")).alias("id"), F.col("b.n_chars").alias("n_chars"), F.lit(batch).alias("batch"), F.lit(addition).alias("addition"))
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/rows").saveAsTable(self.table)
        one = self.spark.createDataFrame([(addition, batch, self.buckets)], "addition string, batch string, buckets int")
        one.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")


def _grouped(docs: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """(id, n_chars, digest, row, group_size, keep, kept) for each row of ``docs``; keep is the id in the index."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark, buckets=max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    batch, text = batch or uuid.uuid4().hex, F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select(id_key().alias("id"), F.char_length(text).cast("long").alias("n_chars"), digest().alias("digest"), F.monotonically_increasing_id().alias("row")))
    # Of equal texts the longest stays, so longer texts are added first and the shorter ones meet an index that has them.
    middle = rows.agg(F.percentile_approx("n_chars", 0.5, 100)).first()[0]
    for part, some in (("long", F.col("n_chars") > middle), ("short", F.col("n_chars") <= middle)) if middle is not None else ():
        index.add(rows.where(some), f"{batch}/{part}")
    here = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("n_chars", (-F.col("id")).alias("minus"), (-F.col("row")).alias("best"))).alias("b"))
    here = here.select("digest", "group_size", (-F.col("b.best")).alias("best")).repartition(index.buckets, "digest")
    known = index.rows().select("digest", F.col("id").alias("keep"), F.col("batch").isin(f"{batch}/long", f"{batch}/short").alias("first"))
    known = written(here.join(known.hint("merge"), "digest"))
    return join_hot(rows, known, ["digest"], "group_size").withColumn("kept", F.col("first") & (F.col("row") == F.col("best")))


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without ASCII white space; of equal texts the one with the most code points stays, then
    the one with the smallest doc_id.  With an index of earlier tables, a text that is in it keeps the earlier row
    (kept is false for all rows of this table), and new ones are appended under the name ``batch``; the same batch again
    gives the same result, as long as its table is the same.  group_size counts this table's rows.  A null doc_id counts
    as the largest.  Of rows that repeat, one stays.  Null texts are empty and equal; other columns are ignored.
    """
    return _grouped(docs, index, batch).select(id_or_null(F.col("id")).alias("doc_id"), id_or_null(F.col("keep")).alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


def exact_deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that exact_groups keeps, with all their columns: one of each set of equal texts, those
    without a doc_id and those that repeat one included; of rows with the same id and length, any."""
    names = [F.col(f"`{c.replace('`', '``')}`") for c in without(docs, *_OWN).columns]
    own = without(docs, *_OWN).withColumns({"__key": id_key(), "__sha": digest(), "__n": F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")})
    # A row is found by its id, digest and length; where several rows have all three, one of them stays.
    same = _grouped(docs, index, batch).groupBy("id", "digest", "n_chars").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    stay = written(same.where("kept").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("n_chars").alias("__chars"), "n"))
    on = (F.col("__key") == F.col("__id")) & (F.col("__sha") == F.col("__digest")) & (F.col("__n") == F.col("__chars"))
    alone = own.join(stay.where("n = 1"), on, "left_semi").select(*names)
    again = stay.where("n > 1")
    return alone if again.isEmpty() else alone.unionByName(own.join(again, on, "left_semi").dropDuplicates(["__key", "__sha", "__n"]).select(*names))
