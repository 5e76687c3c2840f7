"""Media columns: AVI files of motion JPEG.

A reader parses RIFF lists and the index, decodes each intra frame and cuts the frames into shots where the change of
the grey histogram exceeds what the frames before it led to expect.  A writer stores bytes as the samples of lossless
JPEG frames (process 14 of the JPEG standard: one component, predictor 1), so whatever is stored can be read back.

The writer's Huffman table gives difference category k a code of 9-k bits; with the k bits that follow, each sample
takes nine bits, so frames are packed and unpacked as arrays.  Frames with other tables are decoded bit by bit, as are
baseline frames, of which the first component's DCT blocks are decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, without
from .tokens import batches as bounded

#: Payloads are filled up with spaces to a multiple of this many bytes.
UNIT = 192
#: Samples in a row, and units in a frame at most.
WIDTH, FRAME_UNITS = 64, 16
#: Frames a second of stored payloads.
RATE = 25
#: Codes of categories 0 to 8 by length: one of each from 1 bit (category 8) to 9 bits (category 0).
_COUNTS, _SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))


def _codes() -> np.ndarray:
    """The nine bits of each difference from -255 to 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code = (1 << (9 - k)) - 2 if k else (1 << 9) - 2
        out[d + 255] = code << k | ((d if d > 0 else d + (1 << k) - 1) if k else 0)
    return out


_CODE = _codes()
_VALUE = np.zeros(512, np.int16)
_VALUE[_CODE] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode_frame(samples: np.ndarray) -> bytes:
    """A lossless JPEG image of 8-bit samples (rows, columns)."""
    rows, columns = samples.shape
    wide = samples.astype(np.int16)
    diff = np.empty_like(wide)
    diff[:, 1:] = wide[:, 1:] - wide[:, :-1]
    diff[1:, 0] = wide[1:, 0] - wide[:-1, 0]
    diff[0, 0] = wide[0, 0] - 128
    codes = _CODE[diff.ravel() + 255]
    fill = -len(codes) % 8
    v = np.concatenate((codes, np.full(fill, 511, np.uint16))).reshape(-1, 8).astype(np.uint32)
    packed = np.empty((len(v), 9), np.uint8)
    packed[:, 0] = v[:, 0] >> 1
    for i in range(1, 8):
        packed[:, i] = (v[:, i - 1] << (8 - i) | v[:, i] >> (i + 1)) & 255
    packed[:, 8] = v[:, 7] & 255
    flat = packed.ravel()[: (len(codes) * 9 + 7) // 8]
    data = flat.tobytes().replace(b"\xff", b"\xff\x00")
    head = _segment(0xC3, struct.pack(">BHHBBBB", 8, rows, columns, 1, 1, 0x11, 0)) + _segment(0xC4, b"\0" + _COUNTS + _SYMBOLS) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    return b"\xff\xd8" + head + data + b"\xff\xd9"


def _standard() -> dict[int, tuple[bytes, bytes]]:
    """Tables of images without any, as is the custom in AVI files: those of the JPEG standard's annex K, by class and place."""
    # Numbers of codes by length, then the symbols by their codes.
    dc0, dc1 = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])
    ac0 = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
    ac1 = bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119])
    symbols0 = bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )
    symbols1 = bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a43444546474849"
        "4a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
        "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    )
    return {0: (dc0, bytes(range(12))), 1: (dc1, bytes(range(12))), 16: (ac0, symbols0), 17: (ac1, symbols1)}


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 255
            out = out << 1 | byte >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("bad Huffman code")

    def signed(self, k: int) -> int:
        v = self.take(k) if k else 0
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


def _table(counts: bytes, symbols: bytes) -> dict:
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _zigzag() -> list[int]:
    return [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def decode_frame(data: bytes) -> np.ndarray:
    """The samples (rows, columns) of a JPEG image's first component.

    Reads lossless images of one component with predictor 1, and baseline images.  Raises ValueError for others.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    at, tables, quant, frame, restart = 2, _standard(), {}, None, 0
    while True:
        if at + 4 > len(data) or data[at] != 255:
            raise ValueError("bad JPEG segment")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker in (0xC0, 0xC3):
            precision, rows, columns, n = struct.unpack_from(">BHHB", body)
            frame = (marker, rows, columns, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
            if precision != 8:
                raise ValueError("samples of other than 8 bits")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("progressive or arithmetic JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                step = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = [int.from_bytes(body[1 + i * step : 1 + (i + 1) * step], "big") for i in range(64)]
                body = body[1 + 64 * step :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame header")
    end = data.rfind(b"\xff\xd9")
    coded = data[at : end if end >= at else len(data)]
    scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if frame[0] == 0xC3:
        if len(frame[3]) != 1 or body[1 + 2 * body[0]] != 1 or restart:
            raise ValueError("lossless image of another kind")
        return _lossless(coded.replace(b"\xff\x00", b"\xff"), frame[1], frame[2], tables[scan[frame[3][0][0]] >> 4])
    return _baseline(coded, frame, tables, quant, scan, restart)


def _lossless(coded: bytes, rows: int, columns: int, table: tuple[bytes, bytes]) -> np.ndarray:
    n = rows * columns
    if n > 8 * len(coded):  # a sample takes a bit at least
        raise ValueError("image data end too soon")
    if table == (_COUNTS, _SYMBOLS):
        raw = np.frombuffer(coded, np.uint8)
        if len(raw) < (n * 9 + 7) // 8:
            raise ValueError("image data end too soon")
        raw = np.concatenate((raw, np.full(-len(raw) % 9, 255, np.uint8))).reshape(-1, 9).astype(np.uint16)
        v = np.empty((len(raw), 8), np.uint16)
        for i in range(8):
            v[:, i] = (raw[:, i] << (i + 1) | raw[:, i + 1] >> (7 - i)) & 511
        diff = _VALUE[v.ravel()[:n]].astype(np.int32)
    else:
        bits, codes = _Bits(coded), _table(*table)
        diff = np.array([bits.signed(bits.symbol(codes)) for _ in range(n)], np.int32)
    diff = diff.reshape(rows, columns)
    first = 128 + np.cumsum(diff[:, 0])
    diff[:, 0] = first
    return (np.cumsum(diff, axis=1) & 255).astype(np.uint8)


def _baseline(coded: bytes, frame: tuple, tables: dict, quant: dict, scan: dict, restart: int) -> np.ndarray:
    _, rows, columns, parts = frame
    tall, wide = max(p[2] for p in parts), max(p[1] for p in parts)
    across, down = -(-columns // (8 * wide)), -(-rows // (8 * tall))
    if len(parts) == 1:
        tall = wide = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        across, down = -(-columns // 8), -(-rows // 8)
    if across * down * sum(p[1] * p[2] for p in parts) * 2 > 8 * len(coded):  # a block takes two bits at least
        raise ValueError("image data end too soon")
    codes = {k: _table(*v) for k, v in tables.items()}
    pieces, start = [], 0
    for i in range(len(coded) - 1):
        if coded[i] == 255 and 0xD0 <= coded[i + 1] <= 0xD7:
            pieces.append(coded[start:i])
            start = i + 2
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in [*pieces, coded[start:]]]
    zigzag, (_, h, v, q) = _zigzag(), parts[0]
    plane = np.zeros((down * v * 8, across * h * 8))
    bits, last = _Bits(pieces[0]), [0] * len(parts)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            bits, last = _Bits(pieces[unit // restart]), [0] * len(parts)
        for c, (name, ch, cv, _) in enumerate(parts):
            dc, ac = codes[scan[name] >> 4], codes[16 | scan[name] & 15]
            for y in range(cv):
                for x in range(ch):
                    last[c] += bits.signed(bits.symbol(dc))
                    block, k = [0] * 64, 1
                    block[0] = last[c]
                    while k < 64:
                        run, size = divmod(bits.symbol(ac), 16)
                        if not size:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise ValueError("bad block")
                        block[k] = bits.signed(size)
                        k += 1
                    if c == 0:
                        square = np.zeros(64)
                        square[zigzag] = np.multiply(block, quant[q])
                        top, left = (unit // across * v + y) * 8, (unit % across * h + x) * 8
                        plane[top : top + 8, left : left + 8] = _DCT.T @ square.reshape(8, 8) @ _DCT
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: -(-rows * v // tall), : -(-columns * h // wide)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def padded(text: str | None) -> bytes:
    """A text's bytes, filled up with spaces to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of motion JPEG whose samples are the payload, a positive multiple of UNIT bytes.

    All frames but the last hold FRAME_UNITS units; the last is filled with its last sample, and the list of information
    holds the payload's length.
    """
    full = WIDTH * 3 * FRAME_UNITS
    size = min(full, len(payload))
    samples = np.frombuffer(payload, np.uint8)
    samples = np.concatenate((samples, np.full(-len(samples) % size, samples[-1], np.uint8))).reshape(-1, size // WIDTH, WIDTH)
    frames = [_chunk(b"00dc", encode_frame(s)) for s in samples]
    n, rows, largest = len(frames), size // WIDTH, max(map(len, frames))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 16, at, struct.unpack_from("<I", f, 4)[0]))
        at += len(f)
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 16, n, 0, 1, largest, WIDTH, rows, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, rows)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, rows, 1, 8, b"MJPG", size, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload)))
    movi = _chunk(b"LIST", b"movi" + b"".join(frames))
    return _chunk(b"RIFF", b"AVI " + head + info + movi + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[float, int | None, list[bytes]]:
    """Frames a second, the payload's length if the file states it, and the first video stream's frames.

    Frames are found by the index if there is one (its offsets may count from the list of frames or from the file's
    start), else by going through the list.  Raises ValueError for what is no such file.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, length, handler, movi, index = None, None, None, None, None
    waiting = [(12, len(media))]
    while waiting:
        a, b = waiting.pop()
        if a + 8 > b:
            continue
        name, size = media[a : a + 4], struct.unpack_from("<I", media, a + 4)[0]
        body, end = a + 8, min(a + 8 + size, b)
        waiting.append((body + size + (size & 1), b))  # what follows the chunk comes after what is in it
        if name == b"LIST":
            if media[body : body + 4] == b"movi":
                movi = (body, end)
            else:
                waiting.append((body + 4, end))
        elif name == b"avih" and rate is None:
            rate = 1e6 / max(1, struct.unpack_from("<I", media, body)[0])
        elif name == b"strh" and handler is None and media[body : body + 4] == b"vids":
            handler = media[body + 4 : body + 8]
            scale, per = struct.unpack_from("<II", media, body + 20)
            rate = per / scale if scale and per else rate
        elif name == b"ICMT" and (text := media[body:end].rstrip(b"\0")).startswith(b"payload_bytes="):
            length = int(text[14:])
        elif name == b"idx1":
            index = (body, end)
    if movi is None or handler is None:
        raise ValueError("no frames or no video stream")
    frames = []
    if index:
        entries = [struct.unpack_from("<4sIII", media, i) for i in range(index[0], index[1] - 15, 16)]
        entries = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        base = movi[0] if entries and media[movi[0] + entries[0][2] : movi[0] + entries[0][2] + 4] == entries[0][0] else 0
        for _, _, at, size in entries:
            frames.append(media[base + at + 8 : base + at + 8 + size])
    else:
        a = movi[0] + 4
        while a + 8 <= movi[1]:
            size = struct.unpack_from("<I", media, a + 4)[0]
            if media[a + 2 : a + 4] in (b"dc", b"db"):
                frames.append(media[a + 8 : a + 8 + size])
            a += 8 + size + (size & 1)
    return rate or float(RATE), length, frames


def shots(frames: list[np.ndarray], bins: int = 16, window: int = 8, factor: float = 2.0, least: float = 0.1, most: float = 0.6) -> list[tuple[int, int]]:
    """First and last frame of each shot.

    Two frames differ by half the summed difference of their histograms (0 to 1).  A cut is where that exceeds ``factor``
    times the mean of the last ``window`` differences that were no cuts, but at least ``least``, and ``most`` suffices.
    Before the first difference the mean is taken to be ``least``.
    """
    cuts, recent, last = [0], [least], None
    for i, f in enumerate(frames):
        now = np.bincount(f.ravel().astype(np.uint16) * bins >> 8, minlength=bins) / max(1, f.size)
        if last is not None:
            d = float(np.abs(now - last).sum() / 2)
            if d > min(most, max(least, factor * sum(recent) / len(recent))):
                cuts.append(i)
            else:
                recent = [*recent[-window + 1 :], d]
        last = now
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(frames)])] if frames else []


def store_texts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of ``docs`` and ``media``: the text's padded bytes as an AVI file; null is empty."""

    @F.arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        made = [pa.array([write_avi(padded(t.as_py())) for t in b.column(0)], pa.binary()) for b in bounded(pa.record_batch([texts], ["text"]), "text", 4 << 20)]
        release()
        return pa.concat_arrays(made) if made else pa.array([], pa.binary())

    return docs.select(*(keep or ["doc_id"]), stored(F.col("text").cast("string")).alias("media"))


def read_payload(media: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """What write_avi stored, the decoded frames and the frames a second."""
    rate, length, coded = read_avi(media)
    frames = [decode_frame(f) for f in coded]
    payload = b"".join(f.tobytes() for f in frames)
    return payload if length is None else payload[:length], frames, rate


_PROBE = (
    "struct<payload: binary, n_frames: long, error: string, "
    "clips: array<struct<start_s: double, end_s: double, first_frame: long, last_frame: long, mean: double>>>"
)


def probe_media(df: DataFrame, column: str = "media", payload: bool = False) -> DataFrame:
    """Adds ``probe`` to a table with a binary column: frame count, timed clips (one for each shot) and, if asked for,
    the stored payload.  Null and damaged media have null fields and say why in ``error``; no row is lost.  A column
    ``probe`` of the input is replaced.
    """

    @F.arrow_udf(_PROBE)
    def probed(media: pa.Array) -> pa.Array:
        return pa.array([_probe(m.as_py(), payload) for m in media], _TYPE)

    return without(df, "probe").withColumn("probe", probed(F.col(column)))


def media_clips(df: DataFrame, column: str = "media") -> DataFrame:
    """One row for each clip of each row of ``df``, without the media: the other columns, clip (its number from 0),
    start_s, end_s, first_frame, last_frame, mean, error.  Null, damaged and empty media have one row without a clip, and
    say why in ``error``.  Columns of these names are replaced.
    """
    names = ["clip", "start_s", "end_s", "first_frame", "last_frame", "mean", "error"]
    rows = probe_media(without(df, *(n for n in names if n != column.lower())), column)
    kept = without(rows, column, "probe").columns
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.posexplode_outer("probe.clips").alias("clip", "__c"), F.col("probe.error").alias("error")).select(
        *[F.col(f"`{c}`") for c in kept], "clip", *[F.col(f"__c.{n}").alias(n) for n in names[1:-1]], "error"
    )


_CLIP = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("first_frame", pa.int64()), ("last_frame", pa.int64()), ("mean", pa.float64())])
_TYPE = pa.struct([("payload", pa.binary()), ("n_frames", pa.int64()), ("error", pa.string()), ("clips", pa.list_(_CLIP))])


def _clips(frames: list[np.ndarray], rate: float) -> list[dict]:
    return [
        {"start_s": a / rate, "end_s": (b + 1) / rate, "first_frame": a, "last_frame": b, "mean": float(np.mean([f.mean() for f in frames[a : b + 1]]))} for a, b in shots(frames)
    ]


def _probe(media: bytes | None, payload: bool) -> dict:
    if media is None:
        return {"error": "no media"}
    try:
        raw, frames, rate = read_payload(media)
    except (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error) as e:
        return {"error": f"{type(e).__name__}: {e}"}
    return {"payload": raw if payload else None, "n_frames": len(frames), "clips": _clips(frames, rate), "error": None}


def media_digests(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its text is stored as an AVI file, which is read back.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes,
    media_sha256, feature (the clips as ``first-last@mean`` with seconds).  Null texts are empty, and an empty text is
    one unit of spaces.  The length without filling comes from the text, all else from the file.
    """
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for batch in bounded(whole, "media", 8 << 20):
                rows = []
                for m in batch.column("media"):
                    media = m.as_py()
                    payload, frames, rate = read_payload(media)
                    feature = f"{len(frames)} frames; " + ", ".join(f"{c['start_s']:.2f}-{c['end_s']:.2f}s@{c['mean']:.3f}" for c in _clips(frames, rate))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                release()
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types))],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return store_texts(rows, ["doc_id", "n_bytes"]).mapInArrow(digests, out)
