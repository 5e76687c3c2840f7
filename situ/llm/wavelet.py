"""Token files: one wavelet matrix for each shard of documents.

A shard's ids are numbered by its alphabet and stored as bit-planes from the highest bit down.  At each plane the ids
whose bit is 0 come first on the next plane, in order, then those whose bit is 1; with counts of ones before each block
of a plane, any id is found, counted or looked up.  Planes are compressed in chunks, and only the chunks that a question
touches are unpacked.  Files are held as rows (one binary value
for each file) of a table in the shared folder, which any executor can read whatever store that folder is in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, id_or_null, written
from .tokens import BATCH, default_tokenizer, encoder
from .tokens import batches as bounded

#: Tokens after which a shard is full; it ends with its last document.
SHARD_TOKENS = 1 << 20
#: Bits between two stored ranks.
BLOCK = 512
#: Bytes of a plane that are compressed together.
CHUNK = 1 << 14
_MAGIC = b"SWM2"


class Packed:
    """The bytes of a plane, compressed in chunks; reads like an array and unpacks the chunks that are asked for."""

    def __init__(self, size: int, chunks: list[bytes]):
        self.size, self.chunks, self.open = size, chunks, {}

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice):
        if not isinstance(at, slice):
            return self._chunk(at // CHUNK)[at % CHUNK]
        a, b, _ = at.indices(self.size)
        if a >= b:
            return np.empty(0, np.uint8)
        first = a // CHUNK
        parts = [self._chunk(i) for i in range(first, (b - 1) // CHUNK + 1)]
        return (parts[0] if len(parts) == 1 else np.concatenate(parts))[a - first * CHUNK : b - first * CHUNK]

    def _chunk(self, i: int) -> np.ndarray:
        if i not in self.open:
            self.open[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.chunks[i]), np.uint8)
        return self.open[i]


class WaveletMatrix:
    """A sequence of non-negative integers with access, rank (count) and select (occurrence lookup)."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[np.ndarray] | list[Packed], zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.alphabet, self.planes, self.zeros = n, alphabet, planes, zeros
        self.ranks = ranks or [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        counts = np.bitwise_count(np.concatenate((plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        return np.concatenate(([0], np.cumsum(counts))).astype(np.uint32)

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        """Builds the planes; ``values`` may be of any integer type."""
        if len(values) and int(values.max()) < 1 << 20:
            seen = np.zeros(int(values.max()) + 1, bool)
            seen[values] = True
            alphabet = np.flatnonzero(seen).astype(np.uint32)
            code = np.zeros(len(seen), np.uint32)
            code[alphabet] = np.arange(len(alphabet))
            now = code[values]
        else:
            alphabet, now = np.unique(values, return_inverse=True)
            alphabet = alphabet.astype(np.uint32)
        now = now.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        planes, zeros = [], []
        for b in range(max(1, int(len(alphabet) - 1).bit_length() if len(alphabet) else 1) - 1, -1, -1):
            ones = (now & now.dtype.type(1 << b)) != 0
            planes.append(np.packbits(ones))
            low = now.take(np.flatnonzero(~ones))
            zeros.append(len(low))
            now = np.concatenate((low, now.take(np.flatnonzero(ones))))
        return cls(len(values), alphabet, planes, zeros)

    def values(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for b, (plane, z) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            ones = np.unpackbits(plane[:], count=self.n).view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~ones)] = now[:z]
            above[np.flatnonzero(ones)] = now[z:] | now.dtype.type(1 << b)
            now = above
        return self.alphabet[now] if self.n else np.empty(0, np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        plane, block = self.planes[level], i // BLOCK
        part = plane[block * BLOCK // 8 : i // 8]
        rest = int(plane[i // 8]) >> (8 - i % 8) if i % 8 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, z in enumerate(self.zeros):
            bit, ones = int(self.planes[level][i // 8]) >> (7 - i % 8) & 1, self._rank1(level, i)
            code = code << 1 | bit
            i = z + ones if bit else i - ones
        return int(self.alphabet[code])

    def _code(self, value: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, value))
        return at if at < len(self.alphabet) and self.alphabet[at] == value else None

    def rank(self, value: int, i: int) -> int:
        """How often the value occurs among the first i."""
        if (code := self._code(value)) is None:
            return 0
        a, b, top = 0, max(0, min(i, self.n)), len(self.planes) - 1
        for level, z in enumerate(self.zeros):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (z + x, z + y) if code >> (top - level) & 1 else (a - x, b - y)
        return b - a

    def count(self, value: int) -> int:
        """How often the value occurs."""
        return self.rank(value, self.n)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th bit of this kind (from 0)."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """The place of the value's k-th occurrence (from 0)."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        code, top = self._code(value), len(self.planes) - 1
        a = 0
        for level, z in enumerate(self.zeros):
            x = self._rank1(level, a)
            a = z + x if code >> (top - level) & 1 else a - x
        at = a + k
        for level in range(top, -1, -1):
            bit = code >> (top - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at


def write_shard(ids: list[int], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """A shard file: documents' ids and token counts, and their tokens' wavelet matrix, compressed chunk by chunk."""
    matrix = WaveletMatrix.build(tokens)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [np.array(ids, "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(), matrix.alphabet.astype("<u4").tobytes(), np.array(matrix.zeros, "<u8").tobytes()]
    for plane, ranks in zip(matrix.planes, matrix.ranks):
        parts += [ranks.astype("<u4").tobytes(), *(plane[i : i + CHUNK].tobytes() for i in range(0, len(plane), CHUNK))]
    packed = [pack(p) for p in parts]
    head = struct.pack("<4sQQH", _MAGIC, len(ids), matrix.n, len(matrix.planes))
    return head + struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Documents' ids, their token counts and the matrix of a shard file, whose planes stay compressed."""
    magic, _, n, planes = struct.unpack_from("<4sQQH", data)
    if magic != _MAGIC:
        raise ValueError("no token file")
    size = (n + 7) // 8
    chunks = -(-size // CHUNK)
    sizes = struct.unpack_from(f"<{4 + (1 + chunks) * planes}Q", data, 22)
    at, parts, unpack = 22 + 8 * len(sizes), [], zstandard.ZstdDecompressor().decompress
    for length in sizes:
        parts.append(data[at : at + length])
        at += length
    of = lambda i, kind: np.frombuffer(unpack(parts[i]), kind)
    each = [4 + (1 + chunks) * i for i in range(planes)]
    matrix = WaveletMatrix(n, of(2, "<u4"), [Packed(size, parts[i + 1 : i + 1 + chunks]) for i in each], of(3, "<u8").tolist(), [of(i, "<u4") for i in each])
    return of(0, "<i8"), of(1, "<u8").astype(np.int64), matrix


def _shards(path: str, end: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, pid = encoder(path), TaskContext.get().partitionId()
        if end >= code.size:
            raise ValueError("the end id is not in the vocabulary")
        number = start = 0
        ids, sizes, tokens, held = [], [], [], 0

        def full():
            nonlocal number, start, ids, sizes, tokens, held
            blob = write_shard(ids, np.array(sizes), np.concatenate(tokens) if tokens else np.empty(0, np.uint16))
            row = pa.record_batch([pa.array([pid], pa.int32()), *(pa.array(c) for c in ([number], [start], [held], [blob]))], ["part", "shard", "start", "n_tokens", "file"])
            number, start, ids, sizes, tokens, held = number + 1, start + held, [], [], [], 0
            return row

        for whole in parts:
            for batch in bounded(whole, "text", 2 * BATCH):
                found, ends = code.encode_array(batch.column("text"))
                for i, a, b in zip(batch.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    ids.append(i)
                    sizes.append(b - a + 1)
                    tokens += [found[a:b], np.array([end], found.dtype)]
                    held += b - a + 1
                    if held >= SHARD_TOKENS:
                        yield full()
        if ids:
            yield full()

    return run


def token_files(docs: DataFrame, tokenizer: str | None = None, end: int = 0, partitions: int | None = None, path: str | None = None) -> DataFrame:
    """Writes the texts' ids, each document's followed by ``end``, in ascending doc_id order; returns the files.

    Columns: part, shard (together the files' order), start (ids of the part before the file), n_tokens, file.  Null
    texts are empty; rows without a doc_id come last; rows with the same doc_id, or none, come in the order of their texts'
    hashes, so that however many they are, they share out to partitions; equal rows in any order.  Columns other than doc_id and text are ignored.  No rows give no files.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(id_key().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    sorted_rows = rows.repartitionByRange(n, "id", "hash", "place").sortWithinPartitions("id", "hash", "place").select("id", "text")
    return written(sorted_rows.mapInArrow(_shards(tokenizer or default_tokenizer(), end), "part int, shard long, start long, n_tokens long, file binary"), path)


def _documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for part, start, file in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("file")):
            ids, sizes, matrix = read_shard(file.as_py())
            ends = np.cumsum(sizes)
            values = matrix.values().astype("<u4")
            crcs = [zlib.crc32(values[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            yield pa.record_batch(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(ids), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["part", "id", "at", "n_tokens", "ids_crc32"]
            )


def _before(files: DataFrame) -> DataFrame:
    """Ids in all parts before each one; the token totals of the parts, one row for each partition that wrote files, are
    all that the driver sees."""
    total, offsets = 0, []
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        offsets.append((part, total))
        total += n
    return F.broadcast(files.sparkSession.createDataFrame(offsets, "part int, before long"))


def read_documents(files: DataFrame) -> DataFrame:
    """One row for each document of token files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    found = files.select("part", "start", "file").mapInArrow(_documents, "part int, id long, at long, n_tokens long, ids_crc32 long")
    return found.join(_before(files), "part").select(id_or_null(F.col("id")).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, count) for each of the tokens: how often the files have it, by rank on the compressed planes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for file in batch.column("file"):
                matrix = read_shard(file.as_py())[2]
                yield pa.record_batch([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], ["token", "count"])

    found = files.select("file").mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    every = files.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token long")
    return every.join(F.broadcast(found), "token", "left").select("token", F.coalesce("count", F.lit(0).cast("long")).alias("count"))  # found has a row for each token


def find_token(files: DataFrame, token: int) -> DataFrame:
    """One row for each occurrence of a token, by select: doc_id, offset (in the document), place (in all files)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part, start, file in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("file")):
                ids, sizes, matrix = read_shard(file.as_py())
                places = np.array([matrix.select(token, k) for k in range(matrix.count(token))], np.int64)
                ends = np.cumsum(sizes)
                doc = np.searchsorted(ends, places, "right")
                yield pa.record_batch([pa.array(np.full(len(places), part, np.int32)), pa.array(ids[doc]), pa.array(places - (ends - sizes)[doc]), pa.array(start + places)], ["part", "id", "offset", "at"])

    found = files.select("part", "start", "file").mapInArrow(run, "part int, id long, offset long, at long")
    return found.join(_before(files), "part").select(id_or_null(F.col("id")).alias("doc_id"), "offset", (F.col("before") + F.col("at")).alias("place"))


def tokens_at(files: DataFrame, places: list[int]) -> DataFrame:
    """(place, token) for each of the places in all files, by access; places that no file has are left out."""
    wanted = np.unique(np.array(places, np.int64))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, n, file in zip(batch.column("first").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("file")):
                mine = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, first + n)]
                if len(mine):
                    matrix = read_shard(file.as_py())[2]
                    yield pa.record_batch([pa.array(mine), pa.array([matrix.access(int(p) - first) for p in mine], pa.int64())], ["place", "token"])

    return files.join(_before(files), "part").select((F.col("before") + F.col("start")).alias("first"), "n_tokens", "file").mapInArrow(run, "place long, token long")
