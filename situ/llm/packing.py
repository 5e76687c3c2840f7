"""Packing documents into sequences: concatenate and cut.

The first pass encodes each document where it lies and keeps, for each partition, the number of its tokens; prefix sums
over these totals give each document its place in the one long sequence of all.  The second pass cuts that sequence into
fixed windows; a document that crosses windows becomes several pieces.  No text moves between partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, id_or_null, release, written
from .tokens import BATCH, binary_rows, default_tokenizer, encoder
from .tokens import batches as bounded


def _encoded(path: str, end: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, pid, start, run_now = encoder(path), TaskContext.get().partitionId(), 0, None
        for whole in parts:
            for batch in bounded(whole, "text", BATCH):
                ids, ends = code.encode_array(batch.column("text"))
                n = len(ends) - 1
                ids = np.insert(ids, ends[1:], ids.dtype.type(end))
                ends = ends + np.arange(n + 1)
                runs, at = batch.column("run").to_pylist(), np.empty(n, np.int64)
                for i, (name, a, b) in enumerate(zip(runs, ends.tolist(), ends[1:].tolist())):
                    if name != run_now:
                        run_now, start = name, 0
                    at[i] = start
                    start += b - a
                yield pa.record_batch(
                    [pa.array(np.full(n, pid, np.int32)), batch.column("run"), batch.column("row"), batch.column("id"), pa.array(at), pa.array(np.diff(ends)), binary_rows(ids, ends)],
                    ["part", "run", "row", "id", "at", "n", "ids"],
                )
            release()

    return run


def _pieces(window: int, width: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            starts, sizes, owner = batch.column("start").to_numpy(), batch.column("n").to_numpy(), np.arange(len(batch))
            first = starts // window
            n = (starts + sizes - 1) // window - first + 1  # a document has one id at least
            owner = np.repeat(owner, n)
            sequence = np.repeat(first, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            a = np.maximum(sequence * window, starts[owner])
            b = np.minimum((sequence + 1) * window, (starts + sizes)[owner])
            # A batch's ids follow each other, and so do its pieces'.
            ids = np.concatenate([np.frombuffer(value.as_buffer(), width) for value in batch.column("ids")] or [np.empty(0, width)]).astype("<u4")
            yield pa.record_batch(
                [
                    batch.column("id").take(pa.array(owner)),
                    pa.array(a - starts[owner]),
                    pa.array(b - a),
                    binary_rows(ids, np.concatenate(([0], np.cumsum(b - a)))),
                    pa.array(sizes[owner]),
                    pa.array(sequence),
                    pa.array(a - sequence * window),
                ],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, window: int = 1024, tokenizer: str | None = None, end: int = 0, file_order: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``window`` ids.

    Columns: doc_id, start (the document's ids before the piece), length, ids (unsigned 32-bit little-endian integers),
    doc_tokens (with the end id), sequence_id, offset (in the sequence).  A document is its text's ids and ``end``; null texts are empty.  Documents
    follow each other as partitions read them, or with ``file_order`` (``docs`` is read from files) by the files' names
    and their rows' places; all sequences are full but the last.  Each row is a document, rows that repeat too; a null
    doc_id stays null; columns other than doc_id and text are ignored.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    run, row = (F.col("_metadata.file_path"), F.col("_metadata.row_index")) if file_order else (F.lit(""), F.lit(0).cast("long"))
    rows = docs.select(run.alias("run"), row.alias("row"), id_key().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    encoded = written(rows.mapInArrow(_encoded(path, end), "part int, run string, row long, id long, at long, n long, ids binary"))
    total, offsets = 0, []
    # One row for each partition, or for each file and partition that reads it.
    for name, _, part, n in sorted(tuple(r) for r in encoded.groupBy("run", "part").agg(F.min("row"), F.sum("n")).select("run", "min(row)", "part", "sum(n)").collect()):
        offsets.append((part, name, total))
        total += n
    before = F.broadcast(spark.createDataFrame(offsets, "part int, run string, before long"))
    placed = encoded.join(before, ["part", "run"]).select("id", (F.col("before") + F.col("at")).alias("start"), "n", "ids")
    width = "<u2" if encoder(path).size <= 1 << 16 else "<u4"
    out = placed.mapInArrow(_pieces(window, width), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.select(id_or_null(F.col("id")).alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row for each sequence of the pieces that ``pack`` returns: sequence_id, ids (as in pieces), n_tokens, and
    boundaries, an array of (offset, length, doc_id, start) in the order of the sequence.

    Only ids move, to their sequence; a sequence has as many pieces as ids at most.  No pieces give no sequences.
    """
    record = F.struct("offset", "length", "doc_id", "start", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(record)).alias("all"), F.sum("length").alias("n_tokens"))
    ids = F.unhex(F.array_join(F.transform("all", lambda p: F.hex(p["ids"])), ""))
    bounds = F.transform("all", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p["doc_id"].alias("doc_id"), p["start"].alias("start")))
    return whole.select("sequence_id", ids.alias("ids"), "n_tokens", bounds.alias("boundaries"))
