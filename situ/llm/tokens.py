"""Token ids of whole texts, through a public tokenizer file.

The ids are exactly those of ``Tokenizer.encode(text, add_special_tokens=False)``.  A byte-level tokenizer first cuts a
text into parts (a word with the space before it, a number, signs, white space) and merges bytes within each part only.
Here Arrow cuts and numbers the parts of a batch; a worker keeps the ids of parts it has met in a bounded memo of Arrow
arrays, and what is new goes through the library in one call a batch, so that nothing is done part by part.  A text in which a special token is spelled out, and a tokenizer
that is not byte-level, are given to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's memo, some 40 bytes each.
MEMO_ENTRIES = 400_000
#: Bytes of text that are encoded at once; what that needs for a moment is some 30 times as much.
BATCH = 2 << 20
#: Longest part, in bytes, that is worth remembering.
MEMO_BYTES = 64

#: White space in any sense of the word.
_WHITE = "\\t-\\r\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Marks the end of a part; a text that has it, or white space in runs, takes the slower path.
_MARK = "\x01"
_ODD = f"[{_WHITE}]{{2}}|{_MARK}"
#: The pre-tokenizer's parts of a text without runs of white space, where its look-ahead has nothing to decide.
_PART = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\pL+| ?\\pN+| ?[^{_WHITE}\\pL\\pN]+|[{_WHITE}]"
#: A part that begins with a space and has no other white space there.
_SPACED = f"^ [^{_WHITE}\\x1c-\\x1f]"


def default_tokenizer() -> str:
    """The path of the default public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    """The pre-tokenizer's pattern, as the vocabulary's package states it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Memo:
    """Parts and their ids, as many as ``entries`` at most: the newest."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        self.entries = entries
        self.keys, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def add(self, keys: pa.Array, values: pa.Array) -> None:
        """Adds entries; the oldest go."""
        start = max(0, len(self.keys) + len(keys) - self.entries)
        self.keys, self.values = pa.concat_arrays([self.keys, keys]).slice(start), pa.concat_arrays([self.values, values]).slice(start)


class Encoder:
    """Encodes texts; ``dtype`` is the width in which ids are returned."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self._special = [t["content"] for t in spec.get("added_tokens") or []]
        self._splits = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and spec.get("post_processor") is None
        )
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        if self._splits:
            self._spaced = np.zeros(self.size, bool)  # tokens that begin with a space, which byte-level files spell as U+0120
            self._spaced[[i for token, i in vocab.items() if token[0] == "\u0120"]] = True
            self._words = regex.compile(default_pattern())
        self._memo = Memo()

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and each text's first place in it (one place more than texts)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self._splits:
            return _joined(self._library(texts.to_pylist()), self.dtype)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for special in self._special:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        ids, ends = self._regular(texts.filter(pa.array(~odd)))
        if not odd.any():
            return ids, ends
        others, other_ends = _joined(self.encode(texts.filter(pa.array(odd)).to_pylist()), self.dtype)
        lengths = np.empty(len(texts), np.int64)
        lengths[~odd], lengths[odd] = np.diff(ends), np.diff(other_ends)
        at = np.concatenate(([0], np.cumsum(lengths)))
        out = np.empty(at[-1], self.dtype)
        for where, source, begins in ((~odd, ids, ends), (odd, others, other_ends)):
            for i, a, b in zip(at[:-1][where].tolist(), begins[:-1].tolist(), begins[1:].tolist()):
                out[i : i + b - a] = source[a:b]
        return out, at

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode_array, of texts without runs of white space."""
        if not len(texts):
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        split = pc.split_pattern(pc.replace_substring_regex(texts, _PART, f"\\0{_MARK}"), _MARK)
        first = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        got = self._known(coded.dictionary).take(coded.indices.cast(pa.int64()))
        ids, ends = self._ids(got)
        return ids, ends[first]

    def _ids(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of binary values in one array, and each one's first place."""
        _, offsets, data = values.buffers()
        ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
        ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(self.dtype) if data else np.empty(0, self.dtype)
        return ids, (ends - ends[0]) // self.dtype.itemsize

    def _values(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The ids between each start and the next as binary values."""
        offsets = np.append(starts, len(ids)).astype(np.int64) * self.dtype.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])

    def _known(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts, from the memo or made now."""
        memo = self._memo
        at = pc.index_in(parts, value_set=memo.keys)
        lost = pc.is_null(at)
        missing = parts.filter(lost)
        fresh = self._fresh(missing)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[lost.to_numpy(zero_copy_only=False)] = len(memo.keys) + np.arange(len(missing))
        got = pa.concat_arrays([memo.values, fresh]).take(pa.array(place))
        short = pc.less_equal(pc.binary_length(missing), MEMO_BYTES)
        memo.add(missing.filter(short), fresh.filter(short))
        return got

    def _fresh(self, parts: pa.Array) -> pa.Array:
        """The ids of parts, through the library: those that begin with a space and have no other as one text, which is
        cut where a token begins with a space."""
        spaced = pc.match_substring_regex(parts, _SPACED)
        together, others = parts.filter(spaced), parts.filter(pc.invert(spaced))
        ids = np.empty(0, self.dtype)
        if len(together):
            _, offsets, data = together.buffers()
            ends = np.frombuffer(offsets, np.int64)[together.offset : together.offset + len(together) + 1]
            text = memoryview(data)[ends[0] : ends[-1]]
            ids = np.array(self._tokenizer.encode_batch_fast([str(text, "utf-8")], add_special_tokens=False)[0].ids, self.dtype)
        starts = np.flatnonzero(self._spaced[ids])
        if len(starts) != len(together):
            raise AssertionError("tokens do not begin where parts do")
        rest, rest_ends = _joined(self._library(others.to_pylist()), self.dtype)
        place = np.empty(len(parts), np.int64)
        mask = spaced.to_numpy(zero_copy_only=False)
        place[mask], place[~mask] = np.arange(len(together)), len(together) + np.arange(len(others))
        return pa.concat_arrays([self._values(ids, starts), self._values(rest, rest_ends[:-1])]).take(pa.array(place))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, ``dtype.itemsize`` bytes an id, little-endian."""
        if not self._splits:
            return self._library(texts)
        out: list = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self._special)]
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        cut = [(i, self._words.findall(t)) for i, t in enumerate(texts) if t and not out[i]]
        parts = list(dict.fromkeys(p for _, found in cut for p in found))
        ids = dict(zip(parts, self._known(pa.array(parts, pa.large_string())).to_pylist()))
        for i, found in cut:
            out[i] = b"".join([ids[p] for p in found])
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]


def _joined(parts: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // dtype.itemsize
    return np.frombuffer(b"".join(parts), dtype), np.concatenate(([0], np.cumsum(sizes)))


def binary_rows(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each text as a binary value."""
    offsets = (ends * ids.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept while the worker lives."""
    return Encoder(path)


def batches(batch: pa.RecordBatch, column: str, most_bytes: int = 16 << 20):
    """Zero-copy parts of a batch of bounded text size; a single longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(batch):
        yield batch.slice(start)
