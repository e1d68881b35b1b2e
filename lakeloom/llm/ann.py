"""Nearest neighbours by a block matrix join.

Rows become blocks of 8-bit vectors, each with a scale, the norm of its residue and its own norm. Every tile of a query
block and a candidate block is one row of an equality join. In a tile the product of the 8-bit blocks (exact: sums stay
below 2**24, so float32 products hold them) gives each inner product within an error that follows from the norms. A pair
whose upper bound reaches the k-th lower bound of its query survives, in the tile and then over all tiles; only survivors
meet the original vectors again, are recomputed in double precision, and are merged by heaps of k.

Of equal vectors only the k + 1 smallest ids are candidates: ties go to the smaller id and a query leaves out one row at
most, its own, so no other copy can be among its k.

Defined results: vectors that are null or zero, or hold null or non-finite values, take no part; vectors of different
lengths don't meet; a null vec_id takes no part; rows with equal vec_id are rows of their own, as queries too; fewer than
k candidates are all returned; ties go to the smaller vec_id; scores that overflow are infinite, or NaN and last; an empty
table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
QUERY_ROWS, CANDIDATE_ROWS = 1_024, 4_096
#: Queries of a tile that are multiplied at once.
SLICE = 256
#: Dimensions whose 8-bit products float32 adds exactly.
EXACT = 1_024
#: Pairs recomputed at once.
PAIRS = 4_096
RESULT = "query_id long, rank int, vec_id long, score double"
PAIR = "q long, c long, low double, up double"


def usable(vectors: DataFrame, asked: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """row, vec_id, v, dim, asked of the rows that take part."""
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"), "asked")


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit values, scale, norm of the residue and norm of the vector, by row."""
    scale = np.maximum(np.abs(m).max(axis=1) / 127.0, np.finfo(np.float64).tiny)
    even = m / scale[:, None]
    q = np.rint(even)
    # norms of scaled values, whose squares neither vanish nor overflow
    return q.astype(np.int8), scale, np.linalg.norm(even - q, axis=1) * scale, np.linalg.norm(even, axis=1) * scale


def blocks(rows: DataFrame, side: str, per_block: int, total: int) -> DataFrame:
    """dim, <side>, ids, bytes, stats: 8-bit blocks of about per_block rows; stats are scales, residue norms and norms."""
    count = max(1, -(-total // per_block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")).repartition(count, "dim", "block").sortWithinPartitions("dim", "block", "row")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, stats, held = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(ids).tobytes(), np.concatenate(parts).tobytes(), np.concatenate(stats, axis=1).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], names=["dim", side, "ids", "bytes", "stats"])

        for batch in batches:
            row, v, dim, block = batch.columns
            d, b = dim.to_numpy(), block.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (b[1:] != b[:-1]), True]) if len(d) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = (int(d[lo]), int(b[lo]))
                if key is not None and (now != key or held >= 2 * per_block):
                    yield flush()
                    ids, parts, stats, held = [], [], [], 0
                key = now
                q, *s = quantised(v.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, now[0]))
                ids.append(row.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                parts.append(q)
                stats.append(np.array(s))
                held += hi - lo
        if held:
            yield flush()

    return dealt.select("row", "v", "dim", "block").mapInArrow(pack, f"dim int, {side} int, ids binary, bytes binary, stats binary")


def unpacked(dim: int, ids: bytes, values: bytes, stats: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, np.int8).reshape(-1, dim), np.frombuffer(stats, np.float64).reshape(3, -1)


def bounds(q8: np.ndarray, q: np.ndarray, c8: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of two blocks. q, c: scales, residue norms, norms."""
    near = np.zeros((len(q8), len(c8)))
    for at in range(0, q8.shape[1], EXACT):
        near += q8[:, at : at + EXACT].astype(np.float32) @ c8[:, at : at + EXACT].astype(np.float32).T
    with np.errstate(over="ignore", invalid="ignore"):
        near *= q[0][:, None]
        near *= c[0][None, :]
        # x.y - x'.y' = x'.(y - y') + (x - x').y, so at most |x'||y - y'| + |x - x'||y|; a little more for rounding
        wide = (q[2] + q[1])[:, None] * c[1][None, :] + q[1][:, None] * c[2][None, :]
        wide += 1e-9 * q[2][:, None] * c[2][None, :]
        low, up = near - wide, near + wide
    # where a bound overflows nothing is known
    low[np.isnan(low)], up[np.isnan(up)] = -np.inf, np.inf
    return low, up


def survivors(qi: np.ndarray, ci: np.ndarray, low: np.ndarray, up: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) of the pairs whose upper bound reaches the k-th lower bound of their query."""
    own = qi[:, None] == ci[None, :]
    low[own] = up[own] = -np.inf
    bar = np.partition(low, len(ci) - k, axis=1)[:, len(ci) - k] if len(ci) > k else np.full(len(qi), -np.inf)
    return np.nonzero((up >= bar[:, None]) & ~own)


def exactly(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products by row in double precision, added in order of the dimensions."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            out += x[:, j] * y[:, j]
    return out


def nearest(vectors: DataFrame, asked: Column, k: int = K, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product for each row where `asked` holds."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, asked), "vectors")
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    # cut before the shuffle too (WindowGroupLimit), so a vector that a third of the rows share stays small
    ids = written(rows.withColumn("copy", first).filter(F.col("copy") <= k + 1).select("row"), "candidates")
    asking = rows.filter("asked")
    n, m = ids.count(), asking.count()
    down, across = max(1, -(-m // query_rows)), max(1, -(-n // candidate_rows))
    # Each side is packed once; a tile's key is (dim, r, c).
    c_blocks = written(blocks(rows.join(ids, "row", "left_semi"), "c", candidate_rows, n), "candidate-blocks").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    q_blocks = written(blocks(asking, "r", query_rows, m), "query-blocks").withColumnsRenamed({x: f"q_{x}" for x in ("ids", "bytes", "stats")}).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    tiles = c_blocks.repartition(down * across, "dim", "r", "c").join(q_blocks.repartition(down * across, "dim", "r", "c"), ["dim", "r", "c"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, *parts = (batch.column(j)[i].as_py() for j in range(7))
                (ci, c8, c), (qi, q8, q) = unpacked(dim, *parts[:3]), unpacked(dim, *parts[3:])
                for s in range(0, len(qi), SLICE):
                    cut = slice(s, s + SLICE)
                    low, up = bounds(q8[cut], q[:, cut], c8, c)
                    a, b = survivors(qi[cut], ci, low, up, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[cut][a]), pa.array(ci[b]), pa.array(low[a, b]), pa.array(up[a, b])], names=["q", "c", "low", "up"])

    pairs = tiles.select("dim", "ids", "bytes", "stats", "q_ids", "q_bytes", "q_stats").mapInArrow(multiply, PAIR)
    tasks = max(down, spark.sparkContext.defaultParallelism)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of a query that survive over all tiles; they come one query after another."""
        held: list[pa.RecordBatch] = []

        def settled() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            low, up = t["low"].to_numpy(), t["up"].to_numpy()
            bar = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            return t.select(["q", "c"]).filter(pa.array(up >= bar)).combine_chunks().to_batches()[0]

        for batch in batches:
            q = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]) if len(q) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != int(q[lo]):
                    yield settled()
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield settled()

    left = pairs.repartition(tasks, "q").sortWithinPartitions("q").mapInArrow(whole, "q long, c long")
    left = written(left, "survivors")
    # Both joins are by row: a survivor's vectors come from the table, and no tile carries them.
    met = left.join(rows.select(F.col("row").alias("c"), "vec_id", F.col("v").alias("y")).hint("merge"), "c")
    met = met.join(asking.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("x")).hint("merge"), "q")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple[float, int, int]] = []
        now = None

        def ranked() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([now[1]] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-v for _, v, _, _ in best], pa.int64()), pa.array([s for *_, s in best], pa.float64())],
                names=["query_id", "rank", "vec_id", "score"],
            )

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, PAIRS):
                batch = whole_batch.slice(at, PAIRS)
                if not batch.num_rows:
                    continue
                x, y = batch.column(4), batch.column(5)
                lengths = np.diff(x.offsets.to_numpy())
                flat = [z.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for z in (x, y)]
                starts = np.r_[0, np.cumsum(lengths)]
                score = np.empty(batch.num_rows)
                for d in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == d)
                    places = starts[own][:, None] + np.arange(d)
                    score[own] = exactly(flat[0][places], flat[1][places])
                for q, query_id, c, vec, s in zip(*(batch.column(j).to_pylist() for j in range(4)), score.tolist(), strict=True):
                    if now != (q, query_id):
                        if now is not None:
                            yield ranked()
                        heap, now = [], (q, query_id)
                    (heapq.heappushpop if len(heap) >= k else heapq.heappush)(heap, (-math.inf if math.isnan(s) else s, -vec, -c, s))
        if now is not None:
            yield ranked()

    return met.select("q", "query_id", "c", "vec_id", "x", "y").repartition(tasks, "q").sortWithinPartitions("q").mapInArrow(merge, RESULT)
