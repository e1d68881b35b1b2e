"""Packing by sum of squares: documents become tokens, tokens become sequences of a fixed length with little padding.

A document longer than a sequence gives whole sequences and a rest. Rests are placed online: into the fill level that
leaves the smallest sum of squared counts of partially filled windows; the counts by level are an array, and with it a
change of level from a to b costs 2 * (n[b] - n[a]) + 2 (a full window leaves the array).

Documents are dealt to buckets by their row, and only their numbers of tokens and the checksums of their pieces go there: the
texts stay where they are. What a bucket still has open at its end is handed on to the buckets of the next round, a few of
the round before in each, until one bucket is left. Only what that one leaves open, a number of windows that doesn't grow
with the documents, is cut again, into full sequences and, at last, powers of two, which need no padding.

Defined results: a null or empty text is the end token alone; equal doc_ids are documents of their own; an empty table
gives no pieces; other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, written
from .tokens import TOKENIZER, Encoder

LENGTH = 2048
END = 1
ROWS_PER_BUCKET = 8_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SIZES = "row long, doc_id long, h long, n long, crcs array<long>"


class Levels:
    """Open windows by fill level, and the counts of them that decide."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int, new) -> tuple[int, int]:
        """(window, offset) for a rest of size < length. new() names an empty window."""
        n, limit = self.counts, self.length - size
        # From level h to h + size: counts change by one down at h (h > 0) and one up at h + size (unless full).
        here, there = n[: limit + 1], n[size : self.length + 1].copy()
        cost = 2 * (there - here) + 2
        cost[limit] = 1 - 2 * here[limit]
        cost[0] = 2 * there[0] + 1
        cost[1:][here[1:] == 0] = np.iinfo(np.int64).max
        level = int(cost.argmin())
        if cost[limit] == cost[level] and limit and here[limit]:
            level = limit
        window = self.open[level].pop() if level else new()
        if level:
            n[level] -= 1
        if level + size < self.length:
            n[level + size] += 1
            self.open[level + size].append(window)
        return window, level

    def left(self) -> list[tuple[int, int]]:
        return [(w, h) for h, ws in enumerate(self.open) for w in ws]


def powers(total: int, length: int) -> list[int]:
    """total as full lengths and then falling powers of two."""
    out = [length] * (total // length)
    rest, bit = total % length, 1 << (length.bit_length() - 1)
    while rest:
        if rest >= bit:
            out.append(bit)
            rest -= bit
        bit >>= 1
    return out


def placed(sizes: list[int], length: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(rest, window, offset) of rests of these sizes in the windows that get full, and the rests in those that don't."""
    out: list[tuple[int, int, int]] = []
    held: dict[int, list[tuple[int, int]]] = {}
    levels, names = Levels(length), iter(range(1 << 62))
    new = lambda: next(names)
    for rest, size in enumerate(sizes):
        window, offset = levels.place(size, new)
        held.setdefault(window, []).append((rest, offset))
        if offset + size == length:
            out.extend((r, window, o) for r, o in held.pop(window))
    return out, sorted(r for parts in held.values() for r, _ in parts)


def cut_anew(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) of documents of these sizes, end to end, in full lengths and then powers of two."""
    out = []
    cuts = iter(powers(sum(sizes), length))
    room, window, at = 0, -1, 0
    for doc, size in enumerate(sizes):
        start = 0
        while size:
            if not room:
                room, window, at = next(cuts), window + 1, 0
            take = min(room, size)
            out.append((doc, start, take, window, at))
            start, size, room, at = start + take, size - take, room - take, at + take
    return out


def measured(docs: DataFrame, name: str, length: int, end: int) -> DataFrame:
    """row, doc_id, h (of the text), n (tokens), crcs (of each sequence's length of them, and of the rest), written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = Encoder(name), np.array([end], np.uint32)
        for batch in pieces(batches, 3):
            n, crcs = [], []
            for text in batch.column(3).to_pylist():
                ids = np.concatenate([encoder.encode(text), stop])
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[at : at + length].astype("<u4").tobytes()) for at in range(0, len(ids), length)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["row", "doc_id", "h", "n", "crcs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return written(rows.mapInArrow(run, SIZES), "token-numbers")


PLACED = "row long, doc_id long, h long, n long, start long, length long, crc long, sequence_id long, offset long"


def one_round(rows: DataFrame, first: bool, buckets: int, numbered: int, length: int, rows_per_bucket: int) -> DataFrame:
    """Pieces of rows (row, doc_id, h, n, crcs) by buckets, in the first round whole sequences too; what is left open has no sequence_id."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket, number, count = None, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            sizes, crcs = t["n"].to_pylist(), t["crcs"].to_pylist()
            base = (numbered + bucket << 40) + number
            doc, start, lengths, crc, sequence, offset = [], [], [], [], [], []
            rests, windows = [], 0
            for i, n in enumerate(sizes):
                if first:
                    for k in range(n // length):
                        doc.append(i), start.append(k * length), lengths.append(length), crc.append(crcs[i][k]), sequence.append(base + windows), offset.append(0)
                        windows += 1
                if n % length:
                    rests.append(i)
            full, left = placed([sizes[i] % length for i in rests], length)
            for r, window, at in [*full, *((r, None, None) for r in left)]:
                i = rests[r]
                doc.append(i), start.append(sizes[i] - sizes[i] % length), lengths.append(sizes[i] % length), crc.append(crcs[i][-1]), sequence.append(None if window is None else base + windows + window), offset.append(at)
            number += windows + len(rests)
            own = t.select(["row", "doc_id", "h", "n"]).take(pa.array(doc, pa.int64())).combine_chunks()
            columns = [c.combine_chunks() for c in own.columns] + [pa.array(c, pa.int64()) for c in (start, lengths, crc, sequence, offset)]
            yield from pa.Table.from_arrays(columns, names=[x.split()[0] for x in PLACED.split(", ")]).to_batches(max_chunksize=65_536)

        for batch in batches:
            b = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if len(b) else ():
                if held and (int(b[lo]) != bucket or count >= 4 * rows_per_bucket):
                    yield from flush()
                    held, count = [], 0
                if int(b[lo]) != bucket:
                    bucket, number = int(b[lo]), 0
                held.append(batch.slice(lo, hi - lo))
                count += hi - lo
        if held:
            yield from flush()

    # the session says how many partitions there are: a partition may have many buckets, which are packed one after another
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "row")
    return written(dealt.select("bucket", "row", "doc_id", "h", "n", "crcs").mapInArrow(place, PLACED), "packed")


def recut(docs: DataFrame, left: DataFrame, n_left: int, numbered: int, name: str, length: int, end: int, rows_per_bucket: int) -> DataFrame:
    """Pieces of rests whose windows stayed open, cut anew. Their tokens are made again: of a bounded number of documents, unless most rests fit no other."""
    buckets = max(1, -(-n_left // rows_per_bucket))
    known = left.select("doc_id", "h").distinct()
    # rows of one id and text are alike, so one of them stands for all
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").alias("d")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    texts = texts.join((F.broadcast(known) if n_left <= 4 * rows_per_bucket else known).alias("k"), same("d", "k"), "left_semi").dropDuplicates(["doc_id", "h"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stop = Encoder(name), np.array([end], np.uint32)
        for batch in pieces(batches, 2):
            ids = [np.concatenate([encoder.encode(t), stop]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x[len(x) - len(x) % length :].astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "h", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for i, at, size, window, offset in cut_anew([r[4] for r in held], length):
                bucket, doc_id, n, start, _, raw = held[i]
                rows.append((doc_id, start + at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n, (numbered + bucket << 40) + window, offset))
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 10_000], strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in pieces(batches, 5):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(r[5]) != 4 * r[4]:
                    raise ValueError("the documents changed while they were packed")
                if held and held[0][0] != r[0]:
                    yield from flush()
                    held = []
                held.append(r)
        if held:
            yield from flush()

    again = texts.mapInArrow(rest, "doc_id long, h long, ids binary").alias("t")
    rows = left.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("long")).alias("l").join(again, same("l", "t"))
    dealt = rows.select("l.bucket", "l.row", "l.doc_id", "l.n", "l.start", "l.length", "t.ids").repartition("bucket").sortWithinPartitions("bucket", "row")
    return dealt.select("bucket", "doc_id", "n", "start", "length", "ids").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = docs.select("doc_id", "text")
    name = tokenizer or TOKENIZER
    rows = measured(docs, name, length, end)
    count, numbered, first, out = rows.count(), 0, True, []
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-count // rows_per_bucket))
    while True:
        done = one_round(rows, first, buckets, numbered, length, rows_per_bucket)
        out.append(done.filter("sequence_id is not null").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset"))
        left = done.filter("sequence_id is null")
        n_left, numbered = left.count(), numbered + buckets
        # Fewer and fewer are handed on; where they aren't, because rests fit no other, another round wouldn't help.
        if buckets == 1 or n_left == 0 or not first and n_left > 0.75 * count:
            break
        rows, count, first, buckets = left.select("row", "doc_id", "h", "n", F.array("crc").alias("crcs")), n_left, False, -(-n_left // rows_per_bucket)
    if n_left:
        out.append(recut(docs, left, n_left, numbered, name, length, end, rows_per_bucket))
    return reduce(DataFrame.unionByName, out)
