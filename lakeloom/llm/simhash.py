"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into few segments, so few that of at most `bits` differing bits one segment gets at most
one: bits // 2 + 1 segments. Each segment is indexed with one position deleted, for every position; two fingerprints within
the distance share a variant for sure. Equal variants meet in an equality join (a sort-merge shuffle on the variant), are
verified there, and leave only the edges that connect them, at most one a row. Components of the edges come from
alternating large-star and small-star steps.

A run of equal variants longer than RUN isn't held by a task: its rows are handed on, keyed by the variant and a variant of
the next segment too, and so on to the last segment; what even then is one run is compared block by block.

Links between documents can ask for a Jaccard similarity of their shingles. Their fingerprints are then of two words: variants
of either lead documents together, and both words, read loosely, leave out what is far apart. What the variants miss
meets under an equal MinHash of the shingles, where odd sketches of the sets are read as loosely. The components of all
that are settled by the exact similarity, each text in one of them.

Defined results: a null text, or one without words, has fingerprint zero, and links like any other; a text of fewer words
than a shingle is one shingle; equal doc_ids keep a row each and one component; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_words, pieces, scratch, written

SHINGLE, BITS, SEED = 3, 3, 42
#: Rows with one key that a task compares at once; longer runs are split further, then compared in blocks of this size.
RUN = 8_192
#: How often a run that is too long gets a finer key before it falls into blocks.
LEVELS = 2
#: Rows of a run up to which all its pairs are looked at side by side.
SIDE = 1_024
#: Near-duplicate stages: words of a shingle, least similarity, MinHash anchors a document.
STAGE_SHINGLE, SIMILARITY, ANCHORS = 5, 0.8, 8
#: Near-duplicate stages: differing bits of a word of the fingerprint at which a variant is shared for sure (four segments of 16
#: bits), and of both at which documents that share one are compared exactly (of 128 bits 19 differ at 0.8 on average, 64 of unrelated ones).
STAGE_BITS, APART = 7, 26
SKETCH_BITS = 4_096
#: Least similarity by sketches at which documents are compared exactly; an estimate for a pair at 0.8 has a deviation of 0.01 at most.
LOOSE = 0.7
#: Documents under one anchor that a task compares by sketches at once; more are cut into bands of sizes, then into blocks.
STAGE_RUN = 2_048
#: Documents whose shingle sets a task holds at once, twice at most.
MEMBERS = 1_024
#: Shingles up to which a sketch takes all of them; a longer text's sketches take a half, a quarter, ... of its shingles.
SKETCHED = 16_384


def hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles, repeats included."""
    h = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    if size == 1:
        return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))
    rows = zip(*(words[k:] for k in range(size)), strict=False)
    return np.fromiter((h(s, seed) for s in map(b" ".join, rows)), np.uint64, len(words) - size + 1)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """64-bit names of the shingles, repeats included: the words' hashes, mixed one after another. For sets only; fingerprints take hashes()."""
    if not words:
        return np.empty(0, np.uint64)
    own, size = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), min(size, len(words))
    n = len(own) - size + 1
    out = own[:n]
    for k in range(1, size):
        out = mixed(out) + own[k : n + k]
    return mixed(out)


def majority(values: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half the values."""
    n = len(values)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = values[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def set_prints(values: np.ndarray) -> tuple[int, int]:
    """The two words of the fingerprint of a set (sorted, not empty). In sets of an even size the smallest votes twice, so small sets have as many bits set as large ones."""
    odd = values if len(values) % 2 else np.append(values, values[0])
    return majority(odd), majority(mixed(odd + np.uint64(SEED)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            fps = [majority(hashes(lower_words(t), shingle, seed)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(bits: int, used: int = 0) -> list[list[int]]:
    """The bits that are not used yet, in bits // 2 + 1 segments."""
    free = [b for b in range(64) if not used >> b & 1]
    n = bits // 2 + 1
    edges = [len(free) * k // n for k in range(n + 1)]
    return [free[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def variants(key: np.ndarray, fp: np.ndarray, used: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, used) of all one-deletion variants of the segments of bits that the keys don't hold yet."""
    rows, keys, masks = [], [], []
    at = np.arange(len(fp), dtype=np.int64)
    for segment in segments(bits, used):
        whole = sum(1 << b for b in segment)
        for position in segment:
            rows.append(at)
            keys.append(mixed(mixed(fp & np.uint64(whole & ~(1 << position))) + key + np.uint64(position)))
            masks.append(np.full(len(fp), used | whole, np.uint64))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(masks)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def prints_of(t: pa.Table) -> np.ndarray:
    """Fingerprints: of one word (fp), or of two side by side (fp, fq)."""
    words = [t[c].to_numpy().view(np.uint64) for c in ("fp", "fq") if c in t.column_names]
    return words[0] if len(words) == 1 else np.stack(words, axis=1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ."""
    out = popcount(a ^ b)
    return out if out.ndim == 1 else out.sum(axis=1)


def similarity(a: dict, i: int, js: np.ndarray) -> np.ndarray:
    """Jaccard of row i to rows js from odd sketches: n shingles in all; sketch k takes those of 2 ** -k.

    Grades two apart mean sets of which one has twice the other's shingles and more: their similarity is below a half, and zero here.
    """
    n, m = float(a["n"][i]), a["n"][js].astype(float)
    grade = np.maximum(a["grade"][i], a["grade"][js])
    out = np.zeros(len(js))
    for g in np.unique(grade):
        at = np.flatnonzero(grade == g)
        mine, theirs = a["sketches"], js[at]  # a sketch that sketched() left out is for pairs whose sizes are too far apart
        pick = lambda r: mine[r, int(g) - int(a["grade"][r])] if 0 <= int(g) - int(a["grade"][r]) < 2 else None
        own = pick(i)
        if own is None:
            continue
        ok = np.array([0 <= int(g) - int(a["grade"][r]) < 2 for r in theirs])
        other = mine[theirs, np.where(ok, g - a["grade"][theirs], 0)]
        z = popcount(own[None, :] ^ other).sum(axis=1, dtype=np.int64) / SKETCH_BITS
        both = n + m[at]
        apart = np.where(z < 0.499, -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * z, 1e-9)) * 2.0 ** int(g), both)
        out[at] = np.where(ok, (both - apart) / (both + apart), 0)
    return out


def candidates(a: dict, i: int, js: np.ndarray, least: float) -> np.ndarray:
    """Which of rows js the sketches can't tell from a similarity of SIMILARITY to row i; the first two steps are proven bounds."""
    n, m = int(a["n"][i]), a["n"][js]
    near = np.minimum(m, n) >= least * np.maximum(m, n)
    # Bits that differ are never more than shingles that differ; of a similarity of `least` those are (1 - least) / (1 + least) of both.
    at = np.flatnonzero(near & (a["grade"][js] == 0)) if not a["grade"][i] else np.empty(0, np.int64)
    apart = popcount(a["few"][js[at]] ^ a["few"][i]).sum(axis=1, dtype=np.int64)
    near[at] = apart <= (1 - least) / (1 + least) * (m[at] + n) + 1e-6
    at = np.flatnonzero(near)
    near[at] = similarity(a, i, js[at]) >= least
    return near


def connected(a: dict, bits: int, least: float | None) -> list[tuple[int, int]]:
    """Edges (row, row) that connect what is linked among the rows of a run: each new row is met by the rows still outside. With `least` sketches tell, without it fingerprints."""
    fp, todo, edges = a.get("fp"), np.arange(len(a["fp"] if least is None else a["n"])), []
    while len(todo) > 1:
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            i = queue.pop()
            near = differing(fp[todo], fp[i]) <= bits if least is None else candidates(a, i, todo, least)
            if near.any():
                found = todo[near]
                edges.extend((i, int(j)) for j in found)
                queue.extend(int(j) for j in found)
                todo = todo[~near]
    return edges


def pairs_in_runs(keys: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked neighbours in sorted runs of two (the usual ones), at once; the starts and lengths of the longer runs that have links, or more than SIDE rows."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    two = starts[lengths == 2]
    near = two[differing(fp[two], fp[two + 1]) <= bits]
    starts, lengths = starts[lengths > 2], lengths[lengths > 2]
    linked = lengths > SIDE
    run = np.repeat(np.flatnonzero(~linked), lengths[~linked])
    row = starts[run] + np.arange(len(run)) - np.repeat(np.cumsum(lengths[~linked]) - lengths[~linked], lengths[~linked])
    after = starts[run] + lengths[run] - row
    for step in range(1, SIDE):
        on = after > step
        row, run, after = row[on], run[on], after[on]
        if not len(row):
            break
        linked[run[differing(fp[row], fp[row + step]) <= bits]] = True
    return near, starts[linked], lengths[linked]


SKETCH_FIELDS = ["n", "grade", "sketches"]


def linked(rows: DataFrame, bits: int, least: float | None = None, most: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) among rows (key, node, fp, used) with equal keys, and the rows of runs too long for a task (of more than `most`, RUN if not given). With `least`, rows have sketches for fingerprints."""
    most = most or RUN
    full = rows.columns
    kind = rows.schema.simpleString().removeprefix("struct<")[:-1]
    sketched = "sketches" in full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count, skipping, names = 0, None, ["a", "b", *full]

        def edges(a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), t) for t in types)], names=names)

        def handed_on(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for x in t.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([pa.nulls(x.num_rows, pa.int64()), pa.nulls(x.num_rows, pa.int64()), *x.columns], names=names)

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole runs."""
            keys, node = (t[c].to_numpy() for c in ("key", "node"))
            out_a, out_b = [], []
            if sketched:
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                lengths = np.diff(np.r_[starts, len(keys)])
                starts, lengths = starts[lengths > 1], lengths[lengths > 1]
            else:
                fp = prints_of(t)
                two, starts, lengths = pairs_in_runs(keys, fp, bits)
                out_a.append(node[two])
                out_b.append(node[two + 1])
            for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                found = connected(columns_of(t.slice(s, n)) if sketched else {"fp": fp[s : s + n]}, bits, least)
                # all to the smallest node, which runs of one group have in common: their edges are mostly the same
                root: dict[int, int] = {}
                for i, j in found:
                    root[j] = root.setdefault(i, i)
                out_a.append(node[s + np.array(list(root.values()), np.int64)])
                out_b.append(node[s + np.array(list(root), np.int64)])
            if sum(map(len, out_a)):
                yield edges(np.concatenate(out_a), np.concatenate(out_b))

        types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = batch.schema.types
            t = pa.Table.from_batches([batch])
            keys = batch.column(0).to_numpy()
            if skipping is not None:
                other = keys != skipping
                same = int(other.argmax()) if other.any() else len(keys)
                if same:
                    yield from handed_on(t.slice(0, same))
                t, keys = t.slice(same), keys[same:]
                if not len(keys):
                    continue
                skipping = None
            held.append(t)
            count += len(keys)
            if count < max(most, RUN) * 4:
                continue
            t = pa.concat_tables(held).combine_chunks()
            keys = t["key"].to_numpy()
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if last:
                yield from settle(t.slice(0, last), work, handed_on, most)
            rest = t.slice(last)
            if rest.num_rows > most:
                yield from handed_on(rest)
                skipping, held, count = keys[-1], [], 0
            else:
                held, count = [rest], rest.num_rows
        if count:
            yield from settle(pa.concat_tables(held).combine_chunks(), work, handed_on, most)

    done = rows.repartition("key").sortWithinPartitions("key", "node").select(*full).mapInArrow(run, f"a long, b long, {kind.replace(':', ' ')}")
    done = written(done, "linked")
    return done.filter("a is not null").select("a", "b"), done.filter("a is null").select(*full)


def settle(t: pa.Table, work, handed_on, most: int) -> Iterator[pa.RecordBatch]:
    """Runs up to `most` rows are worked on; longer ones are handed on."""
    keys = t["key"].to_numpy()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    if (lengths <= most).all():
        yield from work(t)
        return
    keep = np.repeat(lengths <= most, lengths)
    yield from handed_on(t.filter(pa.array(~keep)))
    if keep.any():
        yield from work(t.filter(pa.array(keep)).combine_chunks())


def varied(rows: DataFrame, bits: int) -> DataFrame:
    """Rows (key, node, fp, used, ...) with their variants for keys."""
    names = rows.columns
    kind = rows.schema.simpleString().removeprefix("struct<")[:-1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                key, fp, used = (batch.column(names.index(c)).to_numpy().view(np.uint64) for c in ("key", "fp", "used"))
                for mask in np.unique(used):
                    own = np.flatnonzero(used == mask)
                    row, keys, masks = variants(key[own], fp[own], int(mask), bits)
                    for cut in range(0, len(row), 16_384):
                        part = batch.take(pa.array(own[row[cut : cut + 16_384]]))
                        new = {"key": pa.array(keys[cut : cut + 16_384].view(np.int64)), "used": pa.array(masks[cut : cut + 16_384].view(np.int64))}
                        yield pa.RecordBatch.from_arrays([new.get(c, part.column(k)) for k, c in enumerate(names)], names=names)

    return rows.mapInArrow(run, kind)


def blockwise(rows: DataFrame, bits: int) -> DataFrame:
    """The exact way for runs that no key splits any more: blocks of a run, as many as its length asks for, each against itself and the others."""

    def run(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        found = connected({"fp": prints_of(t)}, bits, None)
        return pa.table({"a": pa.array([int(node[i]) for i, _ in found], pa.int64()), "b": pa.array([int(node[j]) for _, j in found], pa.int64())})

    return in_blocks(rows, max(1, RUN // 2)).groupBy("key").applyInArrow(run, "a long, b long")


def columns_of(t: pa.Table) -> dict:
    both = np.zeros((t.num_rows, 2, SKETCH_BITS // 64), np.uint64)
    for k, x in enumerate(t["sketches"].to_pylist()):
        own = np.frombuffer(x, np.uint64).reshape(-1, SKETCH_BITS // 64)
        both[k, : len(own)] = own
    return {"n": t["n"].to_numpy(), "grade": t["grade"].to_numpy(), "sketches": both, "few": np.ascontiguousarray(both[:, 0, : SKETCH_BITS // 256])}


def edges_of(rows: DataFrame, bits: int) -> DataFrame:
    """All edges of rows (key, node, fp, used) with equal keys. Runs too long for a task get finer keys, and in the end meet in blocks."""
    edges, rest = linked(rows, bits)
    for _ in range(LEVELS):
        if rest.isEmpty():
            return edges
        more, rest = linked(varied(rest, bits), bits)
        edges = edges.unionByName(more)
    return edges if rest.isEmpty() else edges.unionByName(blockwise(rest, bits))


def closely_printed(features: DataFrame, within: int = APART, bits: int = STAGE_BITS) -> DataFrame:
    """Edges (a, b) that connect the nodes of features (node, n, fp, fq) that share a variant of fp or of fq and differ in `within` bits of both at most. Runs too long for a task are compared block by block."""
    word = lambda k, own, other: F.struct(F.lit(k).cast("long").alias("key"), F.col(own).alias("fp"), F.col(other).alias("fq"))
    words = features.filter("n > 0").select("node", F.explode(F.array(word(0, "fp", "fq"), word(1, "fq", "fp"))).alias("word"))
    rows = varied(words.select("word.key", "node", "word.fp", F.lit(0).cast("long").alias("used"), "word.fq"), bits)
    edges, rest = linked(rows.drop("used"), within)
    return edges if rest.isEmpty() else edges.unionByName(blockwise(rest, within))


def loosely_linked(features: DataFrame, similar: float, least: float, most: int = 0) -> DataFrame:
    """Edges (a, b) that connect the nodes of features (node, n, grade, sketches, anchors) that share an anchor and that sketches put at `least` or more.

    Anchors are counted before anything is dealt by them, so no task is given a run of more than `most` rows: the ids of a
    longer one are cut by size first (sets of a Jaccard similarity of `similar` differ in size by that factor at most, so
    each is with its own band of sizes and the next one), and what is too long even then is compared block by block.
    """
    most = most or STAGE_RUN
    keyed = written(features.select("node", "n", F.explode("anchors").alias("key")), "anchors")
    counts = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "anchor-counts")
    rows = keyed.join(counts.filter(F.col("times") <= most).select("key"), "key", "left_semi").select("key", "node")
    often = counts.filter(F.col("times") > most).select("key")
    if not often.isEmpty():
        band = F.floor(F.log(F.col("n").cast("double")) / -math.log(similar * 0.999)).cast("long")
        banded = keyed.join(often, "key", "left_semi").select(F.explode(F.array(F.xxhash64("key", band), F.xxhash64("key", band + 1))).alias("key"), "node")
        rows = rows.unionByName(in_blocks(written(banded, "bands"), most // 4))
    rows = rows.join(features.select("node", *SKETCH_FIELDS), "node").select("key", "node", *SKETCH_FIELDS)
    edges, rest = linked(rows, 0, least, most)
    if rest.isEmpty():
        return edges

    def run(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        found = connected(columns_of(t), 0, least)
        return pa.table({"a": pa.array([int(node[i]) for i, _ in found], pa.int64()), "b": pa.array([int(node[j]) for _, j in found], pa.int64())})

    return edges.unionByName(rest.groupBy("key").applyInArrow(run, "a long, b long"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of the nodes that edges (a, b) name, by large-star and small-star steps."""
    spark = edges.sparkSession
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign, last = None, None
    for _ in range(rounds):
        # Large star: of each node, the larger neighbours are tied to the smallest of its neighbours and itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: of each node, the smaller neighbours and itself are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        path = scratch(spark, "edges")
        small.write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if last:
            discard(spark, last)
        last = path
        if seen == sign:
            break
        sign = seen
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: smallest doc_id that links of at most `bits` differing bits reach."""
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    # Copies are one node: the links are between different fingerprints, each named by its smallest doc_id.
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"), "nodes")
    rows = varied(nodes.select(F.lit(0).cast("long").alias("key"), "node", "fp", F.lit(0).cast("long").alias("used")), bits)
    found = components(edges_of(rows, bits))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    joined = prints.join(classes, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketched(docs: DataFrame, shingle: int, anchors: int, seed: int = SEED) -> DataFrame:
    """node, digest (of the words), n (distinct shingles), grade, sketches (the second only where a similar text can have a higher grade), anchors (none without words), and the fingerprint's words fp and fq of texts (node, text)."""
    salts = np.array([xxhash.xxh64_intdigest(bytes([k]), seed) | 1 for k in range(anchors)], np.uint64)
    places = np.arange(anchors, dtype=np.uint64)

    def sketch(values: np.ndarray, grade: int) -> np.ndarray:
        kept = values[(values >> np.uint64(40)) % np.uint64(1 << grade) == 0] if grade else values
        out = np.bincount((kept % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        return np.packbits(out.astype(np.uint8), bitorder="little").view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            digests, n, grades, sketches, keys, counts, prints = [], [], [], [], [], [0], []
            for text in batch.column(1).to_pylist():
                words = lower_words(text)
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                counts.append(counts[-1] + (anchors if words else 0))
                if not words:
                    n.append(0)
                    grades.append(0)
                    sketches.append(b"")
                    prints.append((0, 0))
                    continue
                values = np.unique(shingles(words, shingle))
                grade = max(0, (len(values) - 1) // SKETCHED).bit_length()
                both = sketch(values, grade).tobytes()
                if len(values) >= SKETCHED // 4:
                    both += sketch(values, grade + 1).tobytes()
                least = np.array([mixed(values * salt).min() for salt in salts], np.uint64)
                n.append(len(values))
                grades.append(grade)
                sketches.append(both)
                keys.append(mixed(least + places).view(np.int64))
                prints.append(set_prints(values))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(flat))
            fps = [pa.array(x) for x in np.array(prints, np.uint64).view(np.int64).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(grades, pa.int64()), pa.array(sketches, pa.binary()), lists, *fps], names=["node", "digest", *SKETCH_FIELDS, "anchors", "fp", "fq"])

    return docs.mapInArrow(run, "node long, digest binary, n long, grade long, sketches binary, anchors array<long>, fp long, fq long")


def in_blocks(rows: DataFrame, most: int, alone: str | None = None) -> DataFrame:
    """Rows (key, node, ...); those of a key with more than `most` rows in blocks of about so many, with a key for each two blocks and each block. alone: a column that tells keys of one block."""
    out = rows.join(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks")), "key")
    out = out.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    finer = F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))
    out = out.withColumn("key", F.when(F.col("blocks") == 1, F.col("key")).otherwise(finer))
    return out.select(*rows.columns, *([(F.col("blocks") == 1).alias(alone)] if alone else []))


def exactly_linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges (i, j) that connect the sets of a Jaccard similarity of `least` or more."""
    sizes = np.array([len(x) for x in sets])
    places = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(places), np.int64)
    todo, edges = np.arange(1, len(sets)), []
    queue = [0]
    while len(todo):
        if not queue:
            queue, todo = [int(todo[0])], todo[1:]
            continue
        i = queue.pop()
        own = places[starts[i] : starts[i + 1]]
        alike = todo[np.minimum(sizes[todo], sizes[i]) >= least * np.maximum(sizes[todo], sizes[i]) - 1]
        mark[own] = 1
        both = np.array([mark[places[starts[j] : starts[j + 1]]].sum() for j in alike])
        mark[own] = 0
        found = alike[both / (sizes[alike] + sizes[i] - both) >= least] if len(alike) else alike
        edges.extend((i, int(j)) for j in found)
        queue.extend(found.tolist())
        todo = np.setdiff1d(todo, found, assume_unique=True)
    return edges


def verified(classes: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """node, component by the exact similarity of the texts of loose classes (node, component).

    A class of one block is settled where its texts meet; the links of larger ones, found block by block, are put together.
    """

    def run(t: pa.Table) -> pa.Table:
        node, alone = t["node"].to_pylist(), t["alone"][0].as_py()
        found = exactly_linked([np.unique(shingles(lower_words(x.as_py()), shingle)) for x in t["text"]], least)
        if alone:
            # links come as they are reached: the first of them is known or starts a component
            root: dict[int, int] = {}
            for i, j in found:
                root[j] = root.setdefault(i, i)
            pairs = [(node[i], node[j]) for j, i in root.items()]
        else:
            pairs = [(node[i], node[j]) for i, j in found]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([x for _, x in pairs], pa.int64()), "alone": pa.array([alone] * len(pairs), pa.bool_())})

    dealt = written(in_blocks(classes.select(F.col("component").alias("key"), "node"), MEMBERS, "alone"), "members")
    texts = rows.select(F.col("row").alias("node"), "doc.text").join(dealt, "node").select("key", "node", "alone", "text")
    found = written(texts.groupBy("key").applyInArrow(run, "a long, b long, alone boolean"), "verified")
    settled, links = found.filter("alone").select(F.col("b").alias("node"), F.col("a").alias("component")), found.filter("not alone")
    return settled if links.isEmpty() else settled.unionByName(classes_of(links.select("a", "b")))


def classes_of(edges: DataFrame) -> DataFrame:
    """node, component of all nodes that edges name, a component's own node too."""
    found = components(edges)
    return written(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "classes")


def one_of_each_group(docs: DataFrame, shingle: int = STAGE_SHINGLE, least: float = SIMILARITY, anchors: int = ANCHORS, within: int = APART) -> DataFrame:
    """docs with one document (the smallest doc_id) of each group of near copies.

    Texts link when their sets of shingles have a Jaccard similarity of `least` or more. Texts of equal words are one node;
    others meet under a shared deletion variant of their SimHash fingerprints, which must differ in `within` bits at most.
    Pairs whose fingerprints are too far apart for that meet under a shared MinHash anchor (at a similarity of 0.8 all eight
    miss once in 390,000 pairs), where the sketches of their shingles must be roughly similar. Then the sets of shingles
    themselves decide. Texts without words are one group. Whether a table of ids is broadcast to the documents or merged with them is left to its written size.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    # one pass over the texts; all that follows reads ids and hashes, but for the texts that may have near copies
    every = written(sketched(rows.select(F.col("row").alias("node"), "doc.text"), shingle, anchors), "features")
    named = every.select(F.col("node").alias("row"), "digest").join(rows.select("row", "doc.doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    texts = written(named.groupBy("digest").agg(first).select("digest", "first.*").withColumnRenamed("row", "node"), "texts")
    features = every.join(texts.select("node"), "node", "left_semi")
    loose = classes_of(closely_printed(features, within).unionByName(loosely_linked(features, least, min(LOOSE, least - 0.1))))
    classes = verified(loose, rows, shingle, least)
    best = classes.join(texts.select("node", "no_id", "doc_id"), "node").groupBy("component").agg(F.min_by("node", F.struct("no_id", "doc_id", "node")).alias("node"))
    near = classes.select("node").join(best.select("node"), "node", "left_anti").select(F.col("node").alias("row"))
    copies = every.select(F.col("node").alias("row")).join(texts.select(F.col("node").alias("row")), "row", "left_anti")
    dropped = written(near.unionByName(copies), "dropped")
    return rows.join(dropped, "row", "left_anti").select("doc.*")
