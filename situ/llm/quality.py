"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs without ASCII white space.  A text's features are its words and word pairs (A-Z in lower case), and runs
of one, two and three word shapes: capital letters X, small letters x, digits 9, signs as they are; a word that repeats
the one before has the shape "=".  A feature's value is its share of the text's words; a score is the logistic function
of the sparse dot product of values and weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, without, written
from .tokens import batches as bounded

#: Weights; features are hashed to these places.
SIZE = 1 << 18
#: Labelled rows that a classifier is fitted on at most, chosen by a hash of their ids: the documented bound.
MOST_ROWS = 6_000
EPOCHS = 2
#: Bytes of text whose features are in memory at once.
BATCH = 1 << 19
#: Follow-the-regularised-leader: learning rate, its offset, and L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 0.1, 0.0, 1e-4

_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * _M + (a << np.uint64(6)))) * _M
    return x ^ (x >> np.uint64(29))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all texts, five for each word, and the number of words of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.split_pattern_regex(texts, "[\\x20\\x09-\\x0D]+")
    words = split.flatten()
    ends = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at the ends makes empty words
    counts = np.add.reduceat(np.concatenate((full, [False])).astype(np.int64), ends[:-1]) if len(ends) > 1 else np.empty(0, np.int64)
    counts[ends[1:] == ends[:-1]] = 0
    coded = words.filter(pa.array(full)).dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(index):
        return np.empty((5, 0), np.int64), counts
    keys = coded.dictionary
    low = pc.ascii_lower(keys)
    hashed = np.array([xxhash.xxh64_intdigest(w, 1) for w in low.to_pylist()], np.uint64)
    shape = keys
    for pattern, sign in (("\\p{Lu}+", "X"), ("[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}\\p{M}]+", "x"), ("\\p{N}+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    kinds = shape.dictionary_encode()
    kind_hash = np.array([xxhash.xxh64_intdigest(w, 2) for w in kinds.dictionary.to_pylist()], np.uint64)
    word, kind = hashed[index], kind_hash[kinds.indices.to_numpy(zero_copy_only=False)][index]
    first = np.zeros(len(index), bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    same = np.zeros(len(index), bool)
    same[1:] = (word[1:] == word[:-1]) & ~first[1:]
    kind[same] = np.uint64(0x3D3D3D3D)
    begin = np.uint64(0x5E5E5E5E)

    def before(a: np.ndarray) -> np.ndarray:
        b = np.empty_like(a)
        b[1:], b[0] = a[:-1], begin
        b[first] = begin
        return b

    kind1 = before(kind)
    pair = _mixed(before(word), word)
    two = _mixed(kind1, kind)
    three = _mixed(before(kind1), two)
    out = np.stack([word, pair, _mixed(np.full_like(kind, 3), kind), _mixed(np.full_like(kind, 4), two), _mixed(np.full_like(kind, 5), three)])
    return ((out >> np.uint64(17)) & np.uint64(SIZE - 1)).astype(np.int64), counts


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """A score from 0 to 1 for each text; the last weight is the bias."""
    places, counts = features(texts)
    z = np.full(len(texts), weights[-1], np.float64)
    some = counts > 0
    if some.any():
        each = weights[places].sum(0)
        starts = (np.cumsum(counts) - counts)[some]
        z[some] += np.add.reduceat(each, starts) / counts[some]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(examples: Iterable[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the bias last) from (places, values, label) of texts, by follow-the-regularised-leader-proximal; the
    examples are used once each, in their order."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for places, values, label in examples:
        w = weight(places)
        p = 1 / (1 + np.exp(-np.clip(float(w @ values), -30, 30)))
        g = (p - label) * values
        s = (np.sqrt(n[places] + g * g) - np.sqrt(n[places])) / ALPHA
        z[places] += g - s * w
        n[places] += g * g
    return weight(np.arange(SIZE + 1)).astype(np.float32)


def _examples(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct places and their shares of its words, with the bias; texts without words teach nothing."""
    for whole in parts:
        for batch in bounded(whole, "text", BATCH):
            places, counts = features(batch.column("text"))
            ends = np.cumsum(counts)
            for a, b, i, label in zip((ends - counts).tolist(), ends.tolist(), batch.column("id").to_pylist(), batch.column("label").to_pylist()):
                if b > a:
                    at, times = np.unique(places[:, a:b], return_counts=True)
                    at, values = np.append(at, SIZE).astype("<i4"), np.append(times / (b - a), 1).astype("<f4")
                    yield pa.record_batch([pa.array([i], pa.int64()), pa.array([label], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["id", "label", "places", "shares"])
    release()


def _fitted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def examples():
        for batch in parts:
            for label, places, values in zip(batch.column("label").to_pylist(), batch.column("places"), batch.column("shares")):
                yield np.frombuffer(places.as_buffer(), "<i4"), np.frombuffer(values.as_buffer(), "<f4"), label

    weights = fit(examples()).tobytes()
    release()
    yield pa.record_batch([pa.array([weights], pa.binary())], ["weights"])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> np.ndarray:
    """Weights from labelled documents that are not held out, at most ``most_rows`` of them by a hash of their ids.

    Labels that are null, and labels and documents without ids, are not used; of several labels for an id the largest
    counts, and of several documents with an id the text that sorts first.  With nothing to learn from, all weights are
    zero, and every score is 0.5.  Features are made where the texts lie.  One task goes through them EPOCHS times in
    the order of the ids' hashes and holds the weights only; a text's features are at most SIZE, however long it is.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    some = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(most_rows))  # bounded by most_rows
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(some, "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    examples = written(texts.mapInArrow(_examples, "id long, label int, places binary, shares binary"))
    epochs = examples.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    row = epochs.repartition(1).sortWithinPartitions("epoch", F.xxhash64("id"), "id").select("label", "places", "shares").mapInArrow(_fitted, "weights binary").first()
    return np.frombuffer(row[0], np.float32) if row else np.zeros(SIZE + 1, np.float32)


def add_score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``docs`` and a column with each text's score (double); null and empty texts get the bias's score.  An input
    column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # SIZE + 1 floats

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts], ["text"])
        found = [scores(b.column(0), shared.value) for b in bounded(batch, "text", BATCH)]
        release()
        return pa.array(np.concatenate(found) if found else np.empty(0))

    return without(docs, name).withColumn(name, scored(F.col("text").cast("string")))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows whose score is at least ``threshold``, with the columns of ``docs``."""
    return add_score(docs, weights, "__score").where(F.col("__score") >= threshold).drop("__score")
