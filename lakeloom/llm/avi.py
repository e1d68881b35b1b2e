"""Media columns: AVI files of motion JPEG, and the shots in them.

Bytes become 24 x 24 frames of 8-bit samples, each frame a lossless JPEG (process 14, predictor 1), one after another in
an AVI file with its index. The Huffman table gives category s a code of 9 - s bits, so that every sample, with its s
further bits, takes exactly nine bits; whole files are then coded and decoded as arrays. The reader takes the frames that
the RIFF index names, and decodes any other table bit by bit.

Shots: frames whose histogram differs from the one before by more than twice the mean of the differences around, plus a
floor, begin a shot; clips are timed rows.

A media column is stored as a table in the shared folder, and everything is read back from there.

Defined results: a null text is empty; a text of n bytes is padded with bytes 255 to a positive multiple of 576; equal
texts give equal values; equal or null doc_ids keep a row each; an empty table gives no rows; other columns are left alone.
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

from .common import pieces, written

WIDE = HIGH = 24
FRAME = WIDE * HIGH
MS_PER_FRAME = 40
BINS, AROUND, FLOOR = 16, 4, 96
#: Bytes of payload that are coded at once.
AT_ONCE = FRAME * 4096

# Codes: category 8 is 0, 7 is 10, ..., 0 is 111111110; then the category's bits of the difference (less one if negative).
CATEGORY = np.array([int(abs(d)).bit_length() for d in range(-255, 256)])
DIFFERENCES = np.arange(-255, 256)
CODES = ((512 - (2 << CATEGORY)) | np.where(DIFFERENCES < 0, DIFFERENCES + (1 << CATEGORY) - 1, DIFFERENCES)).astype(np.uint16)
DECODED = np.zeros(512, np.int16)
DECODED[CODES] = DIFFERENCES

HEAD = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB16B9B", 28, 0, *([1] * 9 + [0] * 7), *range(8, -1, -1))
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HIGH, WIDE, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)
TAIL = b"\xff\xd9"


def packed(frames: np.ndarray) -> list[bytes]:
    """The entropy-coded data of frames (n, 24, 24), not yet stuffed."""
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    w = CODES[d + 255].reshape(len(x), FRAME // 8, 8)
    out = np.empty((len(x), FRAME // 8, 9), np.uint8)
    out[:, :, 0] = w[:, :, 0] >> 1
    for j in range(1, 8):
        out[:, :, j] = (w[:, :, j - 1] << (8 - j)) | (w[:, :, j] >> (j + 1))
    out[:, :, 8] = w[:, :, 7]
    return [row.tobytes() for row in out.reshape(len(x), -1)]


def unpacked(data: bytes, n: int) -> np.ndarray:
    """Frames (n, 576) from their data, one after another."""
    b = np.frombuffer(data, np.uint8).reshape(n, FRAME // 8, 9).astype(np.uint16)
    w = np.empty((n, FRAME // 8, 8), np.uint16)
    for j in range(8):
        w[:, :, j] = (b[:, :, j] << (j + 1)) | (b[:, :, j + 1] >> (7 - j))
    d = DECODED[w.reshape(n, HIGH, WIDE) & 511]
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8).reshape(n, FRAME)


def decoded(jpeg: bytes) -> np.ndarray:
    """Samples of a lossless JPEG of one component with predictor 1 and any Huffman table, bit by bit."""
    at, codes, size = 2, {}, (0, 0)
    while at < len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker, length = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            counts, symbols, code, k = body[1:17], body[17:], 0, 0
            for bits, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[bits, code] = symbols[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xC3:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("not one component of 8 bits")
            size = struct.unpack_from(">HH", body, 1)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a lossless frame")
        elif marker == 0xDA:
            if body[3] != 1 or body[5]:
                raise ValueError("not predictor 1")
            break
    bits = "".join(f"{b:08b}" for b in jpeg[at : jpeg.rindex(TAIL)].replace(b"\xff\x00", b"\xff"))
    rows, at = np.zeros(size, np.int64), 0
    for r in range(size[0]):
        for c in range(size[1]):
            n = 1
            while (n, int(bits[at : at + n], 2)) not in codes:
                n += 1
                if n > 16:
                    raise ValueError("no such code")
            s = codes[n, int(bits[at : at + n], 2)]
            more = int(bits[at + n : at + n + s] or "0", 2)
            at += n + s
            if s and more < 1 << (s - 1):
                more -= (1 << s) - 1
            rows[r, c] = more + (rows[r, c - 1] if c else rows[r - 1, 0] if r else 128)
    return (rows & 255).astype(np.uint8)


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def written_media(payload: bytes, n_bytes: int) -> bytes:
    """An AVI file of a payload whose length is a positive multiple of 576; n_bytes of it are the text's own."""
    n = len(payload) // FRAME
    frames = []
    for at in range(0, len(payload), AT_ONCE):
        part = np.frombuffer(payload, np.uint8, min(AT_ONCE, len(payload) - at), at).reshape(-1, HIGH, WIDE)
        frames += [HEAD + x.replace(b"\xff", b"\xff\x00") + TAIL for x in packed(part)]
    largest = max(map(len, frames))
    lengths = np.fromiter(map(len, frames), np.int64, n)
    index = np.zeros(n, np.dtype([("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")]))
    index["id"], index["flags"], index["size"] = b"00dc", 16, lengths
    index["offset"] = 4 + np.cumsum(lengths + (lengths & 1) + 8) - (lengths + (lengths & 1) + 8)
    main = struct.pack("<14I", MS_PER_FRAME * 1000, largest * 25, 0, 16, n, 0, 1, largest, WIDE, HIGH, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, MS_PER_FRAME, 1000, 0, n, largest, 10_000, 0, 0, 0, WIDE, HIGH)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDE, HIGH, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    streams = chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", f"bytes={n_bytes}".encode()))
    movie = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", x) for x in frames))
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + streams) + info + movie + chunk(b"idx1", index.tobytes()))


def read_media(media: bytes) -> tuple[int, np.ndarray, int]:
    """(n_bytes, samples of each frame, ms a frame) of an AVI file, by its index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    n_bytes, index, movie, ms = 0, None, 0, MS_PER_FRAME
    todo = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movie = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                ms = struct.unpack_from("<I", media, at + 8)[0] // 1000
            elif name == b"ICMT":
                n_bytes = int(media[at + 8 : at + 8 + size].partition(b"=")[2])
            elif name == b"idx1":
                index = np.frombuffer(media, np.dtype([("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")]), size // 16, at + 8)
            at += 8 + size + (size & 1)
    if index is None or not movie:
        raise ValueError("no index or no frames")
    out, quick, at_once = [], [], AT_ONCE // FRAME

    def settle() -> None:
        if quick:
            out.append(unpacked(b"".join(quick), len(quick)))
            quick.clear()

    for offset, size in zip((index["offset"].astype(np.int64) + movie + 8).tolist(), index["size"].tolist(), strict=True):
        jpeg = media[offset : offset + size]
        if jpeg.startswith(HEAD):
            quick.append(jpeg[len(HEAD) : -2].replace(b"\xff\x00", b"\xff"))
            if len(quick) >= at_once:
                settle()
        else:
            settle()
            out.append(decoded(jpeg).reshape(1, -1))
    settle()
    return n_bytes, np.concatenate(out), ms


def cuts(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first frame of each shot, histogram differences). Whole numbers only, so equal on every machine."""
    n = len(frames)
    which = np.arange(n, dtype=np.int64)[:, None] * BINS + (frames >> 4)
    bins = np.bincount(which.ravel(), minlength=n * BINS).reshape(n, BINS)
    apart = np.abs(np.diff(bins, axis=0)).sum(axis=1)
    if not len(apart):
        return np.zeros(1, np.int64), apart
    sums = np.r_[0, np.cumsum(apart)]
    at = np.arange(len(apart))
    lo, hi = np.maximum(at - AROUND, 0), np.minimum(at + AROUND + 1, len(apart))
    count = hi - lo - 1
    near = sums[hi] - sums[lo] - apart
    return np.r_[0, np.flatnonzero(apart * count > 2 * near + FLOOR * count) + 1], apart


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            media = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                media.append(written_media(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """encoded(docs) as a table: what is read of it comes from its files."""
    # frames repeat their headers, and their nine-bit codes hide repeats from quick compressors
    return written(encoded(docs), "media", **{"parquet.compression.codec.zstd.level": 6, "parquet.block.size": 32 << 20})


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_ms, end_ms, frames of each shot of a media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows = []
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, frames, ms = read_media(raw)
                edges = [*cuts(frames)[0].tolist(), len(frames)]
                rows += [(doc_id, k, a * ms, b * ms, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "clip", "start_ms", "end_ms", "frames"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, start_ms long, end_ms long, frames long")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shots long, clips array<struct<start_ms: bigint, end_ms: bigint>>"


def digests(media: DataFrame) -> DataFrame:
    """What a media column holds, read back from its bytes, and its clips in order."""
    kind = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    names = [x.split()[0] for x in DIGEST.split(", clips")[0].split(", ")] + ["clips"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows, edges, counts = [], [], [0]
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_bytes, frames, ms = read_media(raw)
                payload = frames.tobytes()
                first, apart = cuts(frames)
                feature = f"{len(frames)}f-{len(first)}s-{zlib.crc32(first.astype('<i8').tobytes()):08x}-{zlib.crc32(apart.astype('<i8').tobytes()):08x}"
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, len(first)))
                edges.append(np.stack([first, np.r_[first[1:], len(frames)]]) * ms)
                counts.append(counts[-1] + len(first))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            start, end = np.concatenate(edges, axis=1)
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, DIGEST)
