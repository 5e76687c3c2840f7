"""Near-duplicates by SimHash fingerprints, searched with BK-trees.

A BK-tree keys a node's children by their integer Hamming distance to it; a search of radius r follows only the edges
whose distance is within r of the query's distance to the node.  Over all fingerprints one tree could neither be built
nor broadcast, so the fingerprints are dealt to shards first: two fingerprints that differ in at most r bits agree on at
least one of r+1 bands, so a shard for each value of each band holds every link.  Each shard's tree goes to the task that
searches it (it is sent to one task instead of broadcast to all, as its size has no bound that holds for all shards).
Shards with many fingerprints are dealt again by the bands of their remaining bits, so none outgrows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, components, id_key, id_or_null, join_hot, without, written

#: A shard of more distinct fingerprints is dealt again.
SHARD = 2048
#: How often, at most: after three levels at most 19 bits of 64 are free.
LEVELS = 3
#: MinHash bands of a shingle set, and minima in each: by chance, 0.04 % of pairs of similarity 0.8 agree on no band.
BANDS, BAND = 20, 5
_FACTORS, _TERMS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND), np.uint64) | np.array([[1], [0]], np.uint64)
#: Shingles of a chunk of candidates, each text counted as 256 more.
BLOCK = 1 << 21


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included; zero if there is no word.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text of fewer words is one shingle.
    """
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(b" ".join(found), 42)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total, n = np.zeros(64, np.int64), len(found) - words + 1
    for i in range(0, n, 1 << 16):  # bounded memory for very long texts
        j = min(n, i + (1 << 16))
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i:j].tolist(), ends[i + words - 1 : j + words - 1].tolist())], np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


class BKTree:
    """Integers by Hamming distance; ``search`` yields the members within a radius."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        """Adds a value; a value that is there already stays once."""
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def search(self, value: int, radius: int) -> Iterator[int]:
        """Members at most ``radius`` bits from the value."""
        waiting = [self.root] if self.root else []
        while waiting:
            member, children = waiting.pop()
            d = (member ^ value).bit_count()
            if d <= radius:
                yield member
            if len(children) <= 2 * radius + 1:
                waiting += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                waiting += [children[k] for k in range(d - radius, d + radius + 1) if k in children]


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among values: as a value enters the tree, it is joined to groups that it meets."""
    tree, parent = BKTree(), {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        if v in parent:
            continue
        parent[v] = v
        for other in tree.search(v, radius):
            a, b = top(v), top(other)
            if a != b:
                parent[a] = b
                yield v, other
        tree.add(v)


def _bands(free: int, parts: int) -> list[int]:
    """Splits the set bits of a mask into masks of nearly equal size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may go on in the next batch."""
        shard, values = None, []

        def links():
            if len(values) > 1:
                if found := list(shard_links([v & 0xFFFFFFFFFFFFFFFF for v in values], radius)):
                    a, b = np.array(found, np.uint64).view(np.int64).T
                    yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            shards, prints = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            cuts = [0, *(i for i in range(1, len(shards)) if shards[i] != shards[i - 1]), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shards[a] != shard:
                    yield from links()
                    shard, values = shards[a], []
                values += prints[a:b].tolist()
        yield from links()

    return run


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect the distinct values of ``fp`` just as all links at up to ``radius`` bits would."""
    spark = prints.sparkSession
    parts = radius + 1
    level = prints.select("fp", F.lit("").alias("shard"), F.lit(-1).cast("long").alias("free"))
    done = None
    for depth in range(LEVELS):
        # The bits that are free at this depth depend on the bands taken before, of which there are parts ** depth.
        frees = [(1 << 64) - 1]
        for _ in range(depth):
            frees = [f & ~m for f in frees for m in _bands(f, parts)]
        masks = F.lit(None)
        for f in frees:
            options = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(f & ~m)).alias("rest")) for m in _bands(f, parts)])
            masks = F.when(F.col("free") == _signed(f), options).otherwise(masks) if depth else options
        dealt = level.select("fp", "shard", F.posexplode(masks).alias("i", "m")).select(
            "fp", F.concat_ws("/", "shard", F.concat_ws(":", F.col("i").cast("string"), F.hex(F.col("fp").bitwiseAND(F.col("m.mask"))))).alias("shard"), F.col("m.rest").alias("free")
        )
        if depth:
            dealt = dealt.distinct()
        if depth == LEVELS - 1:
            return done.unionByName(dealt)
        dealt = written(dealt)
        large = written(dealt.groupBy("shard").count().where(F.col("count") > SHARD).select("shard"))
        if large.isEmpty():
            return dealt if done is None else done.unionByName(dealt)
        small = dealt.join(large, "shard", "left_anti").select(*dealt.columns)
        done = small if done is None else done.unionByName(small)
        level = dealt.join(large, "shard", "left_semi").select(*dealt.columns)
    raise AssertionError(spark)


def _prints(words: int):
    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return prints


def near_groups(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id that links reach, the
    row's own included.  Null and empty texts have fingerprint zero, which links like any other.  Rows that repeat give
    rows that repeat.  Links hold between fingerprints, whatever ids have them.  A null doc_id counts as the largest one;
    component_id is null where no other is reached.  Other columns are ignored.  An empty table gives an empty result.
    """
    prints = _prints(words)
    rows = written(docs.select(id_key().alias("id"), prints(F.col("text").cast("string")).alias("fp")))
    firsts = written(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    known = written(_grouped(firsts, radius).join(firsts.select("fp", "n"), "fp"))
    return join_hot(rows, known, ["fp"], "n").select(
        id_or_null(F.col("id")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_or_null(F.col("keep_id")).alias("component_id")
    )


def _print_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) among the distinct values of ``fp``, found with the shards' trees."""
    shards = fingerprint_links(prints.select("fp"), radius)
    return written(shards.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(_linked(radius), "a long, b long"))


def _kept(firsts: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """``firsts`` (node, first: its smallest id) with keep_id and keep_node: of the nodes that links reach, those of the smallest (id, node)."""
    groups = components(links)
    known = written(firsts.join(groups.withColumnRenamed("node", node), node, "left").select(node, "first", F.coalesce("component", node).alias("component")))
    best = written(known.groupBy("component").agg(F.min(F.struct("first", node)).alias("best"), F.count("*").alias("n")))
    return join_hot(known, best, ["component"], "n").select(node, F.col("best.first").alias("keep_id"), F.col(f"best.{node}").alias("keep_node"))


def _grouped(firsts: DataFrame, radius: int) -> DataFrame:
    """Fingerprints are the graph's nodes: ids may be missing or used again, and stand for a group only once it is known."""
    return _kept(firsts, "fp", _print_links(firsts, radius))


def _one_of_each(docs: DataFrame, rows: DataFrame, node: str, known: DataFrame, nodes) -> DataFrame:
    """One row of ``docs`` for each group; ``rows`` has (id, node) of each, and ``nodes`` makes a node of texts.

    An id that one row has finds that row.  Rows of other ids are found by node and id, and one of those that agree stays.
    """
    best = known.select(F.col("keep_node").alias("__node"), F.col("keep_id").alias("__id")).distinct()
    shared = written(rows.groupBy(F.col("id").alias("__id")).count().where("count > 1").select("__id"))
    docs = without(docs, "__key", "__node", "__id")
    if shared.isEmpty():
        return docs.join(best.select("__id"), id_key() == F.col("__id"), "left_semi")
    best = written(best)
    alone = docs.join(best.join(shared, "__id", "left_anti").select("__id"), id_key() == F.col("__id"), "left_semi")
    again = docs.withColumn("__key", id_key()).join(shared, F.col("__key") == F.col("__id"), "left_semi").withColumn("__node", nodes(F.col("text").cast("string")))
    again = again.join(best.withColumnRenamed("__node", "__best"), (F.col("__node") == F.col("__best")) & (F.col("__key") == F.col("__id")), "left_semi")
    return alone.unionByName(again.dropDuplicates(["__key", "__node"]).select(*alone.columns))


def near_deduplicate(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """One row of ``docs`` of each component of near_groups, with all its columns: the one with the smallest doc_id.

    Where none has a doc_id, or rows repeat one, the smallest fingerprint and then any row of it stays.
    """

    prints = _prints(words)
    rows = written(docs.select(id_key().alias("id"), prints(F.col("text").cast("string")).alias("fp")))
    known = _grouped(written(rows.groupBy("fp").agg(F.min("id").alias("first"))), radius)
    return _one_of_each(docs, rows, "fp", known, prints)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted; words and shingles are those of ``fingerprint``."""
    found = (text or "").encode().translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))] if found else [], np.uint64))


def set_hash(hashes: np.ndarray) -> int:
    """A 64-bit hash of a whole shingle set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """A set's SimHash fingerprint and the hashes of its MinHash bands; no bands if it is empty."""
    if not len(hashes):
        return 0, np.zeros(0, np.uint64)
    total, least = np.zeros(64, np.int64), np.full(BANDS * BAND, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 4096):  # bounded memory for very long texts
        part = hashes[i : i + 4096]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        least = np.minimum(least, (part[:, None] * _FACTORS + _TERMS).min(0))
    bands = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, BAND))]
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big"), np.array(bands, np.uint64)


def similar_links(sets: list[tuple[int, np.ndarray]], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among (node, hashes) of at least the Jaccard similarity: a set meets groups, not all their members."""
    groups: list[list[tuple[int, np.ndarray]]] = []
    for node, own in sorted(sets, key=lambda x: (len(x[1]), x[0])):
        met, apart = [], []
        for group in groups:
            hit = None
            for other, theirs in reversed(group):
                if len(theirs) < similarity * len(own):
                    break  # groups are sorted by size: the others are smaller
                both = len(np.intersect1d(own, theirs, assume_unique=True))
                if both / max(1, len(own) + len(theirs) - both) >= similarity:
                    hit = other
                    break
            if hit is None:
                apart.append(group)
            else:
                yield node, hit
                met.append(group)
        # The new set is the largest, so it goes last.
        one = met[0] if len(met) == 1 else sorted((x for g in met for x in g), key=lambda x: len(x[1]))
        one.append((node, own))
        groups = [*apart, one]


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, node, hashes) come sorted by block; a block may go on in the next batch."""
        block, sets = None, []

        def links():
            if found := list(similar_links(sets, similarity)):
                a, b = np.array(found, np.int64).T
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for b, node, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != block:
                    yield from links()
                    block, sets = b, []
                sets.append((node, own.values.to_numpy(zero_copy_only=False).view(np.uint64)))
        yield from links()

    return run


def similar_deduplicate(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """One row of ``docs`` of each group that shingle sets of at least the Jaccard similarity link: the one with the smallest doc_id.

    Candidates are sets whose fingerprints differ in at most two bits, by the BK-trees, or that agree on a MinHash band;
    all sets that candidates connect are then compared by their exact similarity.  Texts without words are alike.  Where
    none of a group has a doc_id, or rows repeat one, any row of one of its sets stays.
    """

    def longs(values) -> pa.Array:
        return pa.array(np.array(values, np.uint64).view(np.int64))

    def lists(arrays: list) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)], dtype=np.int32)), longs(np.concatenate([np.zeros(0, np.uint64), *arrays])))

    @F.arrow_udf("struct<node: long, fp: long, size: long, bands: array<long>>")
    def sketches(texts: pa.Array) -> pa.Array:
        done = [(set_hash(s), len(s), *sketch(s)) for s in (shingle_set(t, words) for t in texts.to_pylist())]
        columns = [longs([d[0] for d in done]), longs([d[2] for d in done]), pa.array([d[1] for d in done], pa.int64()), lists([d[3] for d in done])]
        return pa.StructArray.from_arrays(columns, ["node", "fp", "size", "bands"])

    @F.arrow_udf("long")
    def nodes(texts: pa.Array) -> pa.Array:
        return longs([set_hash(shingle_set(t, words)) for t in texts.to_pylist()])

    @F.arrow_udf("array<long>")
    def hashes(texts: pa.Array) -> pa.Array:
        return lists([shingle_set(t, words) for t in texts.to_pylist()])

    rows = written(docs.select(id_key().alias("id"), sketches(F.col("text").cast("string")).alias("s")).select("id", "s.*"))
    firsts = written(rows.groupBy("node").agg(F.min("id").alias("first"), F.max("fp").alias("fp"), F.max("size").alias("size")))
    # Sets that share a band or a fingerprint are linked to the smallest of them.
    buckets = rows.select("node", F.explode("bands").alias("bucket")).distinct()
    least = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    by_band = buckets.join(least, "bucket").select("node", "least")
    prints = written(firsts.groupBy("fp").agg(F.min("node").alias("least")))
    by_print = firsts.join(prints, "fp").select("node", "least")
    at = lambda side: prints.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_node"))
    near = _print_links(prints, 2).join(at("a"), "a").join(at("b"), "b").select("a_node", "b_node")
    edges = by_band.union(by_print).where("node <> least").union(near).toDF("a", "b").distinct()
    found = written(components(edges).join(firsts, "node").select("node", "component", "first", "size"))
    # A large group is cut into chunks, and each two of them meet in a block.
    parts = found.groupBy("component").agg(F.ceil(F.sum(F.col("size") + 256) / BLOCK).cast("long").alias("parts"))
    texts = docs.select(id_key().alias("first"), F.col("text").cast("string").alias("text")).join(found.select("first").distinct(), "first", "left_semi")
    sets = written(texts.select(nodes("text").alias("node"), hashes("text").alias("hashes")).join(found, "node", "left_semi").dropDuplicates(["node"]))
    chunk = F.pmod(F.col("node"), F.col("parts"))
    block = lambda j: F.concat_ws("/", F.col("component").cast("string"), F.least(chunk, j).cast("string"), F.greatest(chunk, j).cast("string"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), block)
    blocks = found.select("node", "component").join(parts, "component").select("node", F.explode(every).alias("block")).join(sets, "node").select("block", "node", "hashes")
    links = written(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_verified(similarity), "a long, b long"))
    return _one_of_each(docs, rows, "node", _kept(firsts.select("node", "first"), "node", links), nodes)
