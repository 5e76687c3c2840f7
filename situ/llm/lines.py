"""Removal of lines that several documents share.

Lines are exploded with their places, as 128-bit hashes of their keys.  Documents are counted once for each hash; a
document's lines whose hash is in enough documents, of which another is the first, come back to it as places, and its
text is put together again from the places that are left, in order.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, id_key, join_hot, without, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), _UPPER, _LOWER)


def _hashes(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text that do not follow from each other."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def line_deduplicate(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and the columns n_lines (before) and n_dropped (long).

    A line's key is the line without ASCII white space at both ends and with A-Z in lower case.  A key of at least
    ``least_chars`` code points in at least ``least_docs`` documents loses all its lines but those in the document with
    the smallest doc_id.  A null text is one empty line.  Rows with the same doc_id are one document; rows without one
    are one document too, whose id is the largest.  Columns n_lines and n_dropped of the input are replaced; others
    stay.  Lines of a document are known by its id and the hashes of its whole text, so rows that share an id, or have
    none, are never gathered; a line that very many documents have is joined by broadcast.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2 = _hashes(text)
    places = docs.select(id_key().alias("id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = places.select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    h1, h2 = _hashes(F.col("key"))
    lines = written(keys.select("id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2")))
    by_doc = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
    shared = by_doc.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n_docs"), F.sum("n").alias("n_rows"))
    shared = written(shared.where(F.col("n_docs") >= least_docs).select("h1", "h2", "first", "n_rows"))
    lost = join_hot(lines, shared, ["h1", "h2"], "n_rows").where("id > first")
    by_row = lost.groupBy(F.col("id").alias("__id"), F.col("t1").alias("__h1"), F.col("t2").alias("__h2")).agg(F.collect_set("pos").alias("__lost"))

    rows = without(docs, "n_lines", "n_dropped", "__id", "__h1", "__h2", "__lost", "__key", "__t1", "__t2", "__lines")
    keyed = rows.withColumns({"__key": id_key(), "__t1": t1, "__t2": t2})
    done = keyed.join(by_row, (F.col("__key") == F.col("__id")) & (F.col("__t1") == F.col("__h1")) & (F.col("__t2") == F.col("__h2")), "left")
    done = done.withColumn("__lines", F.split(text, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))
    kept = F.when(F.col("__lost").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    dropped = F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long")
    names = [F.col(f"`{c.replace('`', '``')}`") if c.lower() != "text" else kept.alias(c) for c in rows.columns]
    return done.select(*names, F.size("__lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"))
