"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays in the shared folder.

Words are the XXH64 of their bytes; the sorted hashes of the training words, cut into buckets by their first bits, are the
vocabulary, and a word's place in them is its id. Bigrams are pairs of ids in one 64-bit key, counted in sorted arrays for
each bucket of contexts (a context with more than its share of tokens is dealt by the pair, so no bucket grows with it).
Tasks count what they read in arrays, and one row for each bucket goes through the shuffle. Per-word arrays hold the
continuation count and the numbers of followers seen once, twice, and more often; the discounts follow from the counts of
counts. Workers look up the sorted keys of a batch at a time, bucket by bucket, in files that they map into memory when
they are asked for, and let go of again.

Tokens of a text: its words, A-Z in lower case, and one end. An unknown word takes the share of one more word.

Defined results: a null or empty text is its end alone; a null doc_id isn't held out; equal doc_ids keep a row each;
without training texts every base and score is that of an empty model (log10 of 1); other columns are left alone.
"""

from __future__ import annotations

import json
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, lower_words, pieces, scratch
from .files import mapped, put

#: The end of a text; no word has white space in it.
END = xxhash.xxh64_intdigest(b" ")
#: Tokens that a task counts before it hands its counts on, and characters of text a bucket stands for.
TOKENS_AT_ONCE = 4_000_000
CHARS_PER_BUCKET = 16_000_000
COUNTED = "bucket int, keys binary, counts binary"
#: Buckets at most (bits of them), and files that a worker maps at once.
MOST_BITS, MAPPED = 22, 8_192


#: The kind of a row that holds a bucket's counts of counts.
COUNTS = -1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc32_of(doc_id), F.lit(7)) == 2, F.lit(False))


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token of all texts, tokens of each text)."""
    h, all_words, lengths = xxhash.xxh64_intdigest, [], np.empty(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        words = lower_words(text)
        lengths[i] = len(words) + 1
        all_words = list(map(h, words))
        all_words.append(END)
        parts.append(np.array(all_words, np.uint64))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), lengths


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def dealt(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, its keys in order."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in cut], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in cut], pa.binary())], names=["bucket", "keys", "counts"])


class Counter:
    """Counts of 64-bit keys, handed on by bucket when there are many."""

    def __init__(self, bucket_of) -> None:
        self.bucket_of, self.parts, self.n = bucket_of, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.n += len(keys)
        if self.n >= TOKENS_AT_ONCE:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            keys, counts = np.unique(np.concatenate(self.parts), return_counts=True)
            self.parts, self.n = [], 0
            yield dealt(keys, counts, self.bucket_of(keys))


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The summed counts of each bucket of a partition."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, []).append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32)))
    out = {}
    for bucket in sorted(held):
        parts = held.pop(bucket)
        out[bucket] = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64))
    return out


class Files(OrderedDict):
    """Arrays of numbered files, mapped when they are asked for; those asked for longest ago are let go of."""

    def __init__(self, names, dtype: str, most: int = MAPPED) -> None:
        super().__init__()
        self.names, self.dtype, self.most = names, dtype, most

    def __missing__(self, number: int) -> np.ndarray:
        while len(self) >= self.most:
            self.popitem(last=False)
        self[number] = out = mapped(self.names(number), self.dtype)
        return out


class Vocabulary:
    """The sorted hashes of training words and their counts."""

    def __init__(self, folder: str, sizes: list[int], bits: int) -> None:
        self.bits = bits
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.hashes = Files(lambda b: f"{folder}/words-{b}.bin", "<u8")
        self.counts = Files(lambda b: f"{folder}/counts-{b}.bin", "<i8")

    def find(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each of these sorted hashes."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        n = len(self.starts) - 1
        edges = np.searchsorted(sorted_hashes, np.array([b << (64 - self.bits) for b in range(n)], np.uint64)).tolist() + [len(sorted_hashes)]
        for b in range(n):
            own = sorted_hashes[edges[b] : edges[b + 1]]
            if not len(own) or self.starts[b] == self.starts[b + 1]:
                continue
            known = self.hashes[b]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            ids[edges[b] : edges[b + 1]] = np.where(hit, at + self.starts[b], -1)
            counts[edges[b] : edges[b + 1]] = np.where(hit, self.counts[b][at], 0)
        return ids, counts


def bucketing(bits: int, hot: int, start: int):
    """The bucket of bigram keys, given the counts of their contexts: by context, or by the pair for frequent ones and the start."""

    def of(keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        context = keys >> np.uint64(32)
        frequent = (context_counts > hot) | (context == np.uint64(start))
        return (spread(np.where(frequent, keys * np.uint64(0x9E3779B97F4A7C15), context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)

    return of


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more from n[1..4], the numbers of items seen so often."""
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    ratio = lambda k, a, b, other: min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a and b else other
    return [0.0, ratio(1, n1, n2, 0.5), ratio(2, n2, n3, 1.0), ratio(3, n3, n4, 1.5)]


def trained(docs: DataFrame, folder: str) -> dict:
    """Counts docs (text) into a model in folder; returns its description, which is in folder/model.json too."""
    spark = docs.sparkSession
    texts = docs.select("text")
    size, n_texts = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    bits = min(MOST_BITS, max(3, (size // CHARS_PER_BUCKET).bit_length()))
    n_buckets = 1 << bits

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64))
        for batch in pieces(batches, 0):
            yield from counter.add(hashed(batch.column(0).to_pylist())[0])
        yield from counter.flush()

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for bucket, (keys, counts) in gathered(batches).items():
            put(f"{folder}/words-{bucket}.bin", keys.astype("<u8").tobytes())
            put(f"{folder}/counts-{bucket}.bin", counts.astype("<i8").tobytes())
            rows.append((bucket, len(keys), int(counts.sum())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["bucket", "n", "total"])

    stored = texts.mapInArrow(count_words, COUNTED).repartition(n_buckets, "bucket").mapInArrow(store_words, "bucket long, n long, total long").collect()
    sizes = [0] * n_buckets
    for r in stored:
        sizes[r["bucket"]] = r["n"]
    v, total = sum(sizes), sum(r["total"] for r in stored)
    if v >= (1 << 32) - 2:
        raise ValueError("ids of more than 32 bits")
    start, hot = v, max(1, total // (4 * n_buckets))
    bucket_of = bucketing(bits, hot, start)
    width = -(-(v + 1) // n_buckets)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(folder, sizes, bits)
        all_counts = Lookup(words.counts, words.starts)
        counter = Counter(lambda keys: bucket_of(keys, all_counts.of((keys >> np.uint64(32)).astype(np.int64))))
        for batch in pieces(batches, 0):
            h, lengths = hashed(batch.column(0).to_pylist())
            u, back = np.unique(h, return_inverse=True)
            yield from counter.add(pairs(words.find(u)[0][back], lengths, start))
        yield from counter.flush()

    def store_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (keys, counts) in gathered(batches).items():
            put(f"{folder}/pairs-{bucket}.bin", keys.astype("<u8").tobytes())
            put(f"{folder}/times-{bucket}.bin", np.minimum(counts, 255).astype(np.uint8).tobytes())
            often = np.flatnonzero(counts >= 255)
            put(f"{folder}/often-{bucket}.bin", np.concatenate([often, counts[often]]).astype("<i8").tobytes())
            counted = zlib.compress(np.bincount(np.minimum(counts, 5), minlength=6).astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([COUNTS], pa.int32()), pa.array([counted], pa.binary()), pa.array([None], pa.binary())], names=["part", "kind", "ids", "n"])
            context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for kind, ids in ((0, word), (1, context[counts == 1]), (2, context[counts == 2]), (3, context[counts >= 3])):
                u, n = np.unique(ids, return_counts=True)
                for part in np.unique(u // width).tolist():
                    own = slice(*np.searchsorted(u, [part * width, (part + 1) * width]).tolist())
                    packed = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in (np.diff(u[own], prepend=part * width), n[own])]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["part", "kind", "ids", "n"])

    def store_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        by_count: dict[int, list[int]] = {}
        for batch in batches:
            for part, kind, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == COUNTS:
                    by_count[part] = np.frombuffer(zlib.decompress(ids), "<i8").tolist()
                    continue
                out = held.setdefault(part, np.zeros((4, width), np.uint32))
                out[kind][np.cumsum(np.frombuffer(zlib.decompress(ids), np.uint32).astype(np.int64))] += np.frombuffer(zlib.decompress(n), np.uint32)
        for part in sorted(held.keys() | by_count.keys()):
            n, total = None, 0
            if part in held:
                out = held[part]
                put(f"{folder}/ids-{part}.bin", out.astype("<u4").tobytes())
                n, total = np.bincount(np.minimum(out[0], 5), minlength=6).tolist(), int(out[0].sum(dtype=np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], kind), pa.array([total], pa.int64()), pa.array([by_count.get(part)], kind)], names=["part", "counted", "total", "pairs"])

    # A row for each bucket is all that the driver sees.
    counted = texts.mapInArrow(count_pairs, COUNTED).repartition(n_buckets, "bucket").mapInArrow(store_pairs, "part int, kind int, ids binary, n binary")
    parts = counted.repartition(n_buckets, "part").mapInArrow(store_ids, "part long, counted array<bigint>, total long, pairs array<bigint>").collect()
    none = np.zeros(6, np.int64)
    exists = sorted(r["part"] for r in parts if r["pairs"])
    by_count = sum((np.array(r["pairs"]) for r in parts if r["pairs"]), none)
    continued = sum((np.array(r["counted"]) for r in parts if r["counted"]), none)
    model = {"bits": bits, "sizes": sizes, "v": v, "total": int(total), "texts": int(n_texts), "hot": hot, "width": width, "pairs": exists, "parts": sorted(r["part"] for r in parts if r["counted"]), "types": int(sum(r["total"] for r in parts)), "d": discounts(by_count.tolist()), "d1": discounts(continued.tolist()), "continued": [0, int(continued[1]), int(continued[2]), int(continued[3:].sum())]}
    put(f"{folder}/model.json", json.dumps(model).encode())
    return model


class Lookup:
    """Values by id from the arrays of buckets of ids."""

    def __init__(self, arrays: Files, starts: np.ndarray) -> None:
        self.arrays, self.starts = arrays, starts

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        which = np.searchsorted(self.starts, ids, side="right") - 1
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(len(self.starts)))
        for b in range(len(self.starts) - 1):
            own = order[edges[b] : edges[b + 1]]
            if len(own) and self.starts[b] < self.starts[b + 1]:
                out[own] = self.arrays[b][ids[own] - self.starts[b]]
        return out


def pairs(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """Keys of (token before, token) for the tokens of texts of these lengths."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = start
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


class Model:
    """The arrays of a model, mapped into memory as they are asked for."""

    def __init__(self, folder: str, model: dict) -> None:
        self.m = model
        self.words = Vocabulary(folder, model["sizes"], model["bits"])
        self.pairs, self.parts = set(model["pairs"]), set(model["parts"])
        self.keys = Files(lambda b: f"{folder}/pairs-{b}.bin", "<u8")
        self.times = Files(lambda b: f"{folder}/times-{b}.bin", "u1")
        self.often = Files(lambda b: f"{folder}/often-{b}.bin", "<i8")
        self.ids = Files(lambda p: f"{folder}/ids-{p}.bin", "<u4")
        self.d, self.d1 = np.array(model["d"]), np.array(model["d1"])
        self.bucket_of = bucketing(model["bits"], model["hot"], model["v"])
        self.rest = float(self.d1 @ np.array(model["continued"])) / max(1, model["types"])

    def by_id(self, ids: np.ndarray) -> np.ndarray:
        """(4, n): continuation count and followers seen once, twice, more often; zero for unknown ids."""
        out = np.zeros((4, len(ids)), np.float64)
        part = np.where(ids < 0, -1, ids // self.m["width"])
        for p in np.unique(part).tolist():
            if p in self.parts:
                own = np.flatnonzero(part == p)
                out[:, own] = self.ids[p].reshape(4, -1)[:, ids[own] - p * self.m["width"]]
        return out

    def times_of(self, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        """Counts of sorted bigram keys."""
        out, bucket = np.zeros(len(keys), np.int64), self.bucket_of(keys, context_counts)
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        edges = np.searchsorted(bucket[order], np.arange((1 << self.m["bits"]) + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            if b not in self.pairs:
                continue
            table = self.keys[b]
            at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
            n = self.times[b][at].astype(np.int64)
            big = np.flatnonzero(n == 255)
            if len(big):
                often = self.often[b].reshape(2, -1)
                n[big] = often[1][np.searchsorted(often[0], at[big])]
            out[own] = np.where(table[at] == keys[own], n, 0)
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base log10, model log10) of each text."""
        m, (h, lengths) = self.m, hashed(texts)
        first = np.cumsum(lengths) - lengths
        u, back = np.unique(h, return_inverse=True)
        ids_u, counts_u = self.words.find(u)
        base = np.log10((counts_u + 1.0) / (m["total"] + m["v"] + 1.0))[back]
        cc = self.by_id(ids_u)[0]
        one_u = np.maximum(cc - self.d1[np.minimum(cc, 3).astype(np.int64)], 0) / max(1, m["types"]) + (self.rest if m["types"] else 1.0) / (m["v"] + 1)
        before = np.empty(len(h), np.int64)
        before[1:] = back[:-1]
        before[first] = len(u)
        # contexts: the words of the batch, and the start of a text
        ctx_ids, ctx_n = np.r_[ids_u, m["v"]], np.r_[counts_u, m["texts"]]
        followers = self.by_id(ctx_ids)
        gamma = (self.d[1] * followers[1] + self.d[2] * followers[2] + self.d[3] * followers[3]) / np.maximum(ctx_n, 1)
        p = one_u[back]
        known = np.flatnonzero((ctx_ids[before] >= 0) & (ctx_n[before] > 0))
        if len(known):
            seen = known[ids_u[back[known]] >= 0]
            keys = ctx_ids[before[seen]].astype(np.uint64) << np.uint64(32) | ids_u[back[seen]].astype(np.uint64)
            ku, at, kb = np.unique(keys, return_index=True, return_inverse=True)
            times = np.zeros(len(h))
            times[seen] = self.times_of(ku, ctx_n[before[seen[at]]])[kb] if len(seen) else 0
            c = times[known]
            p[known] = np.maximum(c - self.d[np.minimum(c, 3).astype(np.int64)], 0) / ctx_n[before[known]] + gamma[before[known]] * one_u[back[known]]
        return lengths, np.add.reduceat((counts_u > 0).astype(np.int64)[back], first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


def scored(docs: DataFrame, folder: str, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every text, by a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = Model(folder, model)
        for batch in pieces(batches, 1):
            n, known, base, score = lm.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, known, np.full(len(n), model["total"]), base, score, 10 ** (-score / n)))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return rows.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out."""
    folder = scratch(docs.sparkSession, "kneser-ney")
    return scored(docs, folder, trained(docs.filter(~held_out()), folder))
