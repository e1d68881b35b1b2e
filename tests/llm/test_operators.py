"""Each operator on awkward rows against a plain computation; empty tables, nulls, repeats, ties and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lakeloom.llm import ann, avi, html_extract, mixing, ngram_lm, packing, simhash, tokens, toxicity, warc
from lakeloom.llm.common import ship

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(12_000))
NEAR = " ".join(f"k{i}" for i in range(300))
ROWS = [
    (1, "the cat sat on the mat and looked at the dog", "a"), (2, "the cat sat on the mat and looked at the dog", "a"),
    (3, None, None), (4, "", "b"), (5, "  \t\n ", "b"), (6, LONG, "a"), (7, "Ünïcode ÀÉ words here, naïve", "c"),
    (8, "one", "c"), (9, NEAR, "a"), (10, NEAR.replace("k150 ", "changed "), "b"), (11, "<|endoftext|> is text", "a"),
    (11, "same id, other text", "a"), (12, "I'll say  it's fine\n\n\nok   ", "a"),
]
KIND = "doc_id long, text string, source string, row string, size int, node int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(*r, "x", 1, 2, "k") for r in ROWS], KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], KIND)


def words(t):
    return (t or "").encode().lower().split()


def test_mix(docs, none):
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len(words(t))) for i, t, _ in ROWS)
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = sum(r.taken for r in out)
    assert sum(len(words(r.text)) for r in mixed.collect()) == taken


def sources(spark, sizes):
    ship(spark)
    rows = [(100 * k + j, " ".join(["w"] * part), f"s{k:03}") for k, n in enumerate(sizes) for j, part in enumerate((n // 3, n - n // 3))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def water_level(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    """Targets by the stated rule: the excess over a stop goes to the others by weight, until none is above."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    target = {}
    while True:
        left, over = sum(sizes) - sum(target.values()), [k for k in range(len(sizes)) if k not in target]
        share = {k: left * w[k] / sum(w[j] for j in over) for k in over}
        if not (stopped := [k for k in over if share[k] > cap * sizes[k]]):
            return [target.get(k, share.get(k)) for k in range(len(sizes))]
        target |= {k: float(cap * sizes[k]) for k in stopped}


def test_small_sources_reach_their_targets(spark):
    """Sources of 1 to 100 words beside a large one, and single short sources: taken words are the target's."""
    for sizes in ([*range(1, 101), 20_000], [7]):
        out = mixing.mix(sources(spark, sizes)).collect()
        taken, want = Counter(), water_level(sizes)
        for r in out:
            taken[r.doc_id // 100] += r.taken
            assert r.taken <= 3 * r["size"] and abs(r.target - want[r.doc_id // 100]) < 1e-6
        assert all(abs(taken[k] - want[k]) <= 0.5 + 1e-6 for k in range(len(sizes)))


def test_shard_counts_are_a_multinomial_draw_that_the_mix_is_made_of(spark, monkeypatch):
    from lakeloom.llm.common import written

    docs = sources(spark, [40_000, 20_000, 10_000])
    plan = written(mixing.targets(mixing.sized(docs)), "targets")
    slots = {r.place: r.slots for r in plan.collect()}
    counts = mixing.shard_counts(plan, per_shard=50).collect()
    shards = -(-sum(slots.values()) // 50)
    for place, n in slots.items():
        mine = np.zeros(shards)
        for r in counts:
            if r.place == place:
                mine[r.shard] = r.n
        assert mine.sum() == n
        # each count is binomial: chi-square over the shards within five deviations of its mean
        chi = ((mine - n / shards) ** 2 / (n / shards)).sum()
        assert abs(chi - (shards - 1)) < 5 * (2 * (shards - 1)) ** 0.5
    drawn = mixing.drawn(plan, per_shard=50).collect()
    assert Counter((r.place, r.shard) for r in drawn) == Counter({(r.place, r.shard): r.n for r in counts})
    whole = sum(r.taken for r in mixing.mix(docs, per_shard=50).collect())
    real = mixing.shard_counts
    monkeypatch.setattr(mixing, "shard_counts", lambda *a, **k: real(*a, **k).filter("shard % 2 = 0"))
    assert sum(r.taken for r in mixing.mix(docs, per_shard=50).collect()) < 0.7 * whole


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 100, 4099):
        got = mixing.permuted(spark.range(n).withColumn("n", F.lit(n).cast("long")), "p", "id", "n", F.lit(5)).collect()
        assert sorted(r.p for r in got) == list(range(n))


def plain_components(prints, bits=3):
    """(id, smallest id reachable over links of at most so many differing bits) of rows (id, fingerprint), by brute force."""
    least = {i: i for i, _ in prints}
    same = {}
    for i, f in prints:
        same.setdefault(f, set()).add(i)
    links = [(i, j) for f in same for g in same if (f ^ g).bit_count() <= bits for i in same[f] for j in same[g]]
    while True:
        before = dict(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            return [(i, least[i]) for i, _ in prints]


def test_components_of_the_documents(spark):
    """The query on a small table against brute force."""
    ship(spark)
    out = simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted(plain_components([(r.doc_id, int(r.fingerprint, 16)) for r in out]))


def test_fingerprints_and_components(docs, none):
    def fp(t):
        w = words(t)
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    out = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{fp(t):016x}") for i, t, _ in ROWS)
    found = [(r.doc_id, r.component_id) for r in out]
    assert Counter(found) == Counter(plain_components([(i, fp(t)) for i, t, _ in ROWS]))
    assert {r.component_id for r in out if r.doc_id in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_group(docs, none):
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect())
    assert kept == [1, 3, 6, 7, 8, 9, 11, 11, 12]
    assert simhash.one_of_each_group(none).count() == 0


def test_near_copies_are_told_by_the_exact_similarity(spark):
    """Pairs at exactly 0.8 link, pairs just under it don't, however sketches estimate them."""
    ship(spark)
    rows, kept = [], set()
    for k in range(40):
        w = [f"t{k}x{i}" for i in range(9)]
        rows += [(4 * k, " ".join(w)), (4 * k + 1, " ".join(w[:8]))]  # 4 of 5 shingles
        w = [f"u{k}x{i}" for i in range(803)]
        rows += [(4 * k + 2, " ".join(w)), (4 * k + 3, " ".join(w[: 642 + k % 2]))]  # 638 or 639 of 799: below 0.8
        kept |= {4 * k, 4 * k + 2, 4 * k + 3}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each_group(df, anchors=12).collect()}
    assert got == kept


def test_near_copies_whose_words_differ_much_are_found(spark, monkeypatch):
    """Short texts with a tail: 0.8 and more by shingles, more than 11 bits apart by words."""
    ship(spark)
    monkeypatch.setattr(simhash, "MEMBERS", 2)
    far, k = [], 0
    while len(far) < 25:
        w = [f"a{k}b{i}" for i in range(24)]
        one, other = w[:20], w  # 16 of 20 shingles
        k += 1
        if (simhash.majority(simhash.hashes([x.encode() for x in one], 1)) ^ simhash.majority(simhash.hashes([x.encode() for x in other], 1))).bit_count() > 11:
            far += [(one, other)]
    rows = [(3 * i + j, " ".join(w)) for i, (a, b) in enumerate(far) for j, w in enumerate((a, b, [*b, "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each_group(df).collect()) == [3 * i for i in range(25)]


def plain_set_prints(text):
    """128 bits, each the vote of the distinct five-word shingles; the smallest shingle breaks ties."""
    v = np.unique(simhash.shingles(words(text), 5)).tolist()
    v = v if len(v) % 2 else [*v, v[0]]
    other = [int(simhash.mixed(np.array([x], np.uint64) + np.uint64(simhash.SEED))[0]) for x in v]
    return [sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) for h in (v, other)]


def near_copies(n):
    """(doc_id, text): texts 3k, a near copy 3k + 1 with some words changed, and 3k + 2, a copy too far off."""
    rows = []
    for k in range(n):
        w = [f"c{k}d{i}" for i in range(100 + k)]
        near, far = list(w), list(w)
        for j in range(1 + k % 2):
            near[20 + 30 * j] = "near"
        for j in range(5):
            far[10 + 14 * j] = "far"
        rows += [(3 * k + j, " ".join(x)) for j, x in enumerate((w, near, far))]
    return rows


@pytest.mark.parametrize("most", [simhash.RUN, 2])
def test_near_copies_come_by_their_fingerprints(spark, monkeypatch, most):
    """Without an anchor: what shares a deletion variant and is near enough by all bits links if it is similar, and only then."""
    ship(spark)
    monkeypatch.setattr(simhash, "RUN", most)
    rows = near_copies(30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = {i: plain_set_prints(t) for i, t in rows}
    sets = {i: set(simhash.shingles(words(t), 5).tolist()) for i, t in rows}
    segments = [sum(1 << b for b in range(16 * s, 16 * s + 16)) for s in range(4)]
    want = set()
    for i in prints:
        for j in prints:
            apart = [a ^ b for a, b in zip(prints[i], prints[j], strict=True)]
            meet = any((x & s).bit_count() <= 1 for x in apart for s in segments) and sum(x.bit_count() for x in apart) <= simhash.APART
            if i < j and meet and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want.add(j)
    got = {r.doc_id for r in simhash.one_of_each_group(df, anchors=0).collect()}
    assert got == {i for i, _ in rows} - want and len(want) >= 27
    assert {r.doc_id for r in simhash.one_of_each_group(df, anchors=0, within=-1).collect()} == {i for i, _ in rows}


def test_fingerprints_of_many_rows_with_one_variant(spark):
    """Runs with and without links, of two rows, of some, and of more than are looked at side by side."""
    rng = np.random.default_rng(3)
    for n in (2, 3, 40, simhash.SIDE + 5):
        fp = rng.integers(1 << 63, size=(3 * n, 2), dtype=np.uint64)
        keys = np.repeat(np.arange(3), n)
        fp[n] = fp[2 * n - 1] ^ np.uint64(5)  # the second run holds a link
        two, starts, lengths = simhash.pairs_in_runs(keys, fp, 26)
        long = [0, n, 2 * n] if n > simhash.SIDE else [n] if n > 2 else []
        assert starts.tolist() == long and lengths.tolist() == [n] * len(long)
        assert two.tolist() == ([n] if n == 2 else [])
        assert all(simhash.connected({"fp": fp[s : s + n]}, 26, None) == ([(0, n - 1)] if s == n else []) for s in long)


def test_long_runs_of_sketches_keep_their_groups(spark):
    from pyspark.sql import functions as F

    ship(spark)
    n = simhash.RUN + 200
    df = spark.range(n).selectExpr("id AS node", "concat_ws(' ', transform(sequence(0, 11), i -> concat('x', CASE WHEN id % 100 = 7 AND i < 11 THEN 0 ELSE id END, 'y', i))) AS text").repartition(4)
    rows = simhash.sketched(df, 5, 1).withColumn("anchors", F.array(F.lit(1).cast("long")))
    found = {x for r in simhash.loosely_linked(rows, 0.8, 0.7, most=1_000).collect() for x in r}
    assert found >= set(range(7, n, 100)) and len(found) < 200


def test_long_runs_go_through_finer_keys(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    near = [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))]
    far = [int(x) for x in rng.integers(1 << 62, size=40)]
    rows = spark.createDataFrame([(0, i, f, 0) for i, f in enumerate(near + far)], "key long, node long, fp long, used long")
    monkeypatch.setattr(simhash, "RUN", 4)
    edges = simhash.edges_of(simhash.varied(rows, 3), 3)
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    parent = list(range(100))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = near + far
    for i in range(100):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert all(found.get(i, i) == root(i) for i in range(100))


def packed_well(out, rows, length=2048):
    """Every id of every document in exactly one piece, with its checksum, and sequences gapless and unpadded."""
    e = tokens.Encoder()
    ids = Counter()
    for doc_id, text in rows:
        ids[doc_id, np.append(e.encode(text), 1).astype("<u4").tobytes()] += 1
    sequences, by_doc = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at < length and at & (at - 1) == 0
    for (doc_id, raw), times in ids.items():
        n = len(raw) // 4
        alike = [(x, k) for (d, x), k in ids.items() if d == doc_id and len(x) == len(raw)]
        assert sum(p[1] for p in by_doc[doc_id, n]) == n * sum(k for _, k in alike)
        if len(alike) == 1:
            covered = Counter()
            for start, size, check in by_doc[doc_id, n]:
                assert check == zlib.crc32(raw[4 * start : 4 * (start + size)])
                covered.update(range(start, start + size))
            assert set(covered) == set(range(n)) and set(covered.values()) == {times}
    assert len(out) >= sum(ids.values()) and {d for d, _ in by_doc} == {d for d, _ in ids}


def test_packing(docs, none):
    packed_well(packing.pack(docs).collect(), [(i, t) for i, t, _ in ROWS])
    packed_well(packing.pack(docs, rows_per_bucket=2).collect(), [(i, t) for i, t, _ in ROWS])
    assert packing.pack(none).count() == 0


def test_packing_in_rounds(spark):
    """Many buckets hand on what they leave open; of many documents few are cut anew, and rests that fit no other are packed too."""
    ship(spark)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(1, 200, 1_500))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = packing.pack(df, length=128, rows_per_bucket=150).collect()
    packed_well(out, rows, 128)
    pieces = Counter(r.doc_id for r in out)
    cut = sum(pieces[i] > -(-len(t.split()) // 128) + 1 for i, t in rows)
    assert cut < 40
    alike = [(i, " ".join(["word"] * 69)) for i in range(300)]
    packed_well(packing.pack(spark.createDataFrame(alike, "doc_id long, text string"), length=128, rows_per_bucket=40).collect(), alike, 128)


def test_packing_holds_a_bounded_number_of_equal_rows(spark):
    ship(spark)
    same = spark.createDataFrame([(None, "the same few words")] * 60 + [(None, f"text {i}") for i in range(40)], "doc_id long, text string")
    out = packing.pack(same, rows_per_bucket=1).collect()
    e = tokens.Encoder()
    assert sum(r.length for r in out) == 60 * (len(e.encode("the same few words")) + 1) + sum(len(e.encode(f"text {i}")) + 1 for i in range(40))
    places = [(r.sequence_id, r.offset) for r in out]
    assert len(set(places)) == len(places)
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in ends.values())


def test_tokens(docs, none):
    full = tokens.loaded(tokens.TOKENIZER)[0]
    for _, t, _ in ROWS:
        assert tokens.Encoder().encode(t).tolist() == full.encode(t or "", add_special_tokens=False).ids
    out = tokens.token_counts(docs, block_bytes=64).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((i, len(tokens.Encoder().encode(t))) for i, t, _ in ROWS)
    assert tokens.token_counts(none).count() == 0


def test_token_files_roll(docs, spark, tmp_path):
    """Documents over several files of a task, blocks that hold no separator and blocks that hold many."""
    files = tokens.write_token_files(docs, str(tmp_path), roll_bytes=60)
    assert files.select("file").distinct().count() > 5
    for block_bytes in (2, 34, 1 << 20):
        found = files.join(tokens.separator_scan(spark, str(tmp_path), files, block_bytes=block_bytes), ["file", "ordinal"]).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((i, len(tokens.Encoder().encode(t))) for i, t, _ in ROWS)


def plainly_read(media):
    """Samples of each frame of an AVI file: its movi list walked chunk by chunk, every frame decoded bit by bit."""
    at, frames = media.index(b"movi") + 4, []
    while media[at : at + 4] == b"00dc":
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        frames.append(avi.decoded(media[at + 8 : at + 8 + size]).tobytes())
        at += 8 + size + size % 2
    return frames


def plain_feature(frames):
    bins = [Counter(b >> 4 for b in f) for f in frames]
    apart = [sum(abs(x[k] - y[k]) for k in range(16)) for x, y in zip(bins, bins[1:], strict=False)]
    first = [0]
    for i, x in enumerate(apart):
        near = [y for j, y in enumerate(apart) if j != i and abs(i - j) <= 4]
        if x * len(near) > 2 * sum(near) + 96 * len(near):
            first.append(i + 1)
    packed = lambda xs: zlib.crc32(b"".join(x.to_bytes(8, "little") for x in xs))
    return f"{len(frames)}f-{len(first)}s-{packed(first):08x}-{packed(apart):08x}", first


def test_media(docs, none):
    """Every column from the stored bytes, against a plain reader of them; repeated ids too."""
    media = avi.stored(docs)
    got = Counter()
    for r in avi.digests(media).collect():
        got[(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.shots, tuple((c.start_ms, c.end_ms) for c in r.clips))] += 1
    want, held = Counter(), Counter()
    for r in media.collect():
        held[r.doc_id, bytes(r.media)] += 1
    for (doc_id, raw), times in held.items():
        frames = plainly_read(raw)
        payload = b"".join(frames)
        text = next(t for i, t, _ in ROWS if i == doc_id and payload.startswith((t or "").encode()) and set(payload[len((t or "").encode()) :]) <= {255})
        own = (text or "").encode()
        assert len(payload) == max(1, -(-len(own) // 576)) * 576
        feature, first = plain_feature(frames)
        clips = tuple((a * 40, b * 40) for a, b in zip(first, [*first[1:], len(frames)], strict=True))
        want[(doc_id, len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, len(first), clips)] += times
    assert got == want and Counter(i for i, *_ in want.elements()) == Counter(i for i, *_ in ROWS)
    assert avi.digests(avi.stored(none)).count() == 0
    calm = np.full((6, 576), 20, np.uint8)
    assert avi.cuts(np.concatenate([calm, calm + 150]))[0].tolist() == [0, 6]
    rows = avi.clips(media).collect()
    assert sum(r.frames for r in rows) == sum(k * n for (*_, n), k in Counter((*x, x[2] // 576) for x in want.elements()).items())


def plain_kneser_ney(train):
    """The model by its definition: (log10 probability of the tokens of a text, its counts) over token lists."""
    pairs, words = Counter(), Counter()
    for text in train:
        words.update(text)
        pairs.update(zip([None, *text], text, strict=False))
    contexts = words + Counter({None: len(train)})
    continued = Counter(w for _, w in pairs)

    def discounts(values):
        n = [sum(v == k for v in values) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), float(k)) if n[k] and n[k + 1] else other for k, other in ((1, 0.5), (2, 1.0), (3, 1.5)))]

    d2, d1, types, v = discounts(pairs.values()), discounts(continued.values()), len(pairs), len(words)
    rest = sum(d1[min(n, 3)] for n in continued.values()) / max(1, types) if types else 1.0
    followers = {}
    for (c, _), n in pairs.items():
        followers.setdefault(c, []).append(min(n, 3))

    def one(w):
        n = continued[w]
        return max(n - d1[min(n, 3)], 0) / max(1, types) + rest / (v + 1)

    def two(c, w):
        if not contexts[c]:
            return one(w)
        n = pairs[c, w]
        return max(n - d2[min(n, 3)], 0) / contexts[c] + sum(d2[k] for k in followers[c]) / contexts[c] * one(w)

    return (lambda text: sum(math.log10(two(c, w)) for c, w in zip([None, *text], text, strict=False))), words


def test_language_model(docs, none, spark):
    """Every column against the model by its definition; awkward rows, repeated and null ids, no training rows."""
    end = b" "
    rng = np.random.default_rng(7)
    made = [(100 + i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) % 50)) for i in range(60)]
    rows = [(i, t) for i, t, _ in ROWS] + made + made[:4] + [(None, "w1 w2 Unseen"), (None, None)]
    out = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ngram_lm.language_model_scores(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")).collect())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    token_lists = [[*words(t), end] for _, t in rows]
    model, counts = plain_kneser_ney([t for (i, _), t in zip(rows, token_lists, strict=True) if not held(i)])
    total, v, want = counts.total(), len(counts), Counter()
    for (i, _), t in zip(rows, token_lists, strict=True):
        base = sum(math.log10((counts[w] + 1) / (total + v + 1)) for w in t)
        want[(i, held(i), len(t), sum(counts[w] > 0 for w in t), total, round(base, 6), round(model(t), 6))] += 1
    assert {x[:5] for x in out} == {x[:5] for x in want}
    assert sorted(map(str, out.elements())) == sorted(map(str, want.elements()))
    assert ngram_lm.language_model_scores(none).count() == 0
    only = next(i for i in range(100) if held(i))
    alone = ngram_lm.language_model_scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.score) == (3, 0, 0, 0.0)


def test_files_are_let_go_of(tmp_path):
    for k in range(5):
        np.arange(k, k + 3, dtype="<i8").tofile(tmp_path / f"{k}.bin")
    files = ngram_lm.Files(lambda k: f"{tmp_path}/{k}.bin", "<i8", most=2)
    assert [int(files[k][0]) for k in (0, 1, 2, 0, 3, 4, 0)] == [0, 1, 2, 0, 3, 4, 0] and len(files) == 2


def plain_sum(values):
    out = 0.0  # sum() compensates
    for x in values:
        out += x
    return out


def test_nearest(spark):
    """Against brute force, by row: repeated ids and vectors, ties, odd rows, extra columns, few candidates."""
    from pyspark.sql import functions as F

    ship(spark)
    rng = np.random.default_rng(1)
    good = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(30)]
    good += good[:5] + [(40, [5.0] + [0.0] * 7), (41, [5e-324] * 8), (42, [1e200] * 8), (44, [1.0, 2.0])]
    odd = [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (420, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in good + odd], "vec_id long, embedding array<double>, row int, q string, dim int").repartition(3)
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, query_rows=4, candidate_rows=64).collect())
    want = Counter()
    for i, (q, v) in enumerate(good):
        if q % 20 == 0:
            scores = sorted((-plain_sum(x * y for x, y in zip(v, w, strict=True)), c) for j, (c, w) in enumerate(good) if j != i and len(w) == len(v))
            want.update((q, k, c, -s) for k, (s, c) in enumerate(scores[:20], 1))
    assert {x[:3] for x in got} == {x[:3] for x in want} and got == want
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    few = ann.nearest(df.filter("vec_id in (1, 2, 3)"), F.col("vec_id") == 1)
    assert few.count() == 2 * 5


def test_nearest_among_many_equal_vectors(spark):
    """Equal vectors leave k + 1 candidates, and no tie is lost."""
    from pyspark.sql import functions as F

    ship(spark)
    df = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [2.0, float(i % 2)]) for i in range(900)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 5, query_rows=3, candidate_rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    equal = [i for i in range(900) if i % 3]
    assert [v for _, v in sorted(got[100])] == [i for i in equal if i != 100][:5]


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 1500)) * 10.0 ** rng.integers(-200, 100, (40, 1)), rng.standard_cauchy(size=(60, 1500))
    (x8, *xs), (y8, *ys) = ann.quantised(x), ann.quantised(y)
    low, up = ann.bounds(x8, np.array(xs), y8, np.array(ys))
    assert ((low <= x @ y.T) & (x @ y.T <= up)).all()


def test_html(spark):
    ship(spark)
    page = "<html><nav>menu</nav><div class='cookie-notice'>we use</div><article><h1>T &amp; U</h1><p>One,  two.\n three<p>Four<script>x</p></script> five.</article><div id=comments>nice</div><footer>f</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>un<b>closed"), (5, "u", "plain &lt; text"), (6, "u", "<p>" + "a b. " * 50_000)], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert out[1].text == "T & U\nOne, two. three\nFour five." and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[4].text, out[5].text) == ("", "", "unclosed", "plain < text")
    assert out[6].n_chars == 249_999
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_rows(spark):
    """Repeated ids, and columns whose names the operator uses."""
    ship(spark)
    df = spark.createDataFrame([(1, "u", "<p>One, two.</p>", "x", 7), (1, "u", "<p>Three, four.</p>", "y", 8), (None, None, "<p>Five.</p>", None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(df).collect()) == [(0, "Five.", 5), (1, "One, two.", 9), (1, "Three, four.", 12)]


def test_html_keeps_heading_and_lead_beside_a_long_body():
    lead, body = "The lead, in short, says it all. " * 9, "A paragraph, with commas, of the body. " * 10
    page = f"<html><body><div class=story><h1>Title</h1><p>{lead}</p><div class=body>" + f"<p>{body}</p>" * 10 + "</div></div></body></html>"
    assert html_extract.main_text(page) == "\n".join(["Title", lead.strip(), *[body.strip()] * 10])


def test_html_keeps_parts_of_an_article_whose_names_sound_like_others():
    parts = ["<div class='post-header'><h1>Title</h1></div>", "<p id='share-price'>The share price fell.</p>", "<p>So <math><mi>x</mi></math> and <object>a figure</object> hold.</p>", "<h2 id='related-work'>Related work</h2><p>Others did.</p>", "<section id='discussion'><p>It was found.</p></section>"]
    junk = "<div class='share-buttons'>Share me</div><p hidden>unseen</p><div role='navigation'>Next</div>"
    page = "<html><div class='site-header'>Site</div><article>" + "".join(parts) + junk + "</article></html>"
    assert html_extract.main_text(page) == "Title\nThe share price fell.\nSo x and a figure hold.\nRelated work\nOthers did.\nIt was found."


def plain_page(k, wrap="div", junk=True):
    """A page of a known article: lists, a table, code and a quotation in it, boilerplate around it."""
    word = lambda n: " ".join(f"word{(i * 7 + k) % 31}" for i in range(n))
    parts = [("h1", f"Title {k}"), *[("p", f"{word(30)}, {word(12)}. {word(9)}; {word(20)}.") for _ in range(4 + k % 3)], ("h2", "A part"), ("li", "one"), ("li", "two"), ("td", "1"), ("td", "2"), ("pre", "x = 1"), ("p", f"{word(25)}: {word(8)}, {word(9)}.")]
    inside = "".join({"li": f"<ul><li>{t}</li></ul>", "td": f"<table><tr><td>{t}</td></tr></table>"}.get(tag, f"<{tag}>{t}</{tag}>") for tag, t in parts)
    around = ("<nav><a href=/>Home</a></nav><div class=sidebar><p>" + word(30) + ", and, so, on.</p></div>", "<div class='related-posts'><ul><li><a href=a>Other</a></li></ul></div><div id=comments><p>" + word(40) + ". Nice, I say.</p></div><footer>Us</footer>") if junk else ("", "")
    return f"<html><body>{around[0]}<{wrap}>{inside}</{wrap}>{around[1]}</body></html>", "\n".join(t for _, t in parts)


def test_html_without_article_or_main():
    for k in range(12):
        for wrap in ("div", "section", "article", "td"):
            page, want = plain_page(k, wrap)
            assert html_extract.main_text(page) == want


def test_html_is_chosen_by_the_ratios(monkeypatch):
    """With every path taken for a content path, boilerplate comes out; with none, nothing does."""
    pages = [plain_page(k) for k in range(5)]
    monkeypatch.setattr(html_extract, "content_paths", lambda blocks: {b.element.path for b in blocks})
    assert all(html_extract.main_text(p) != want for p, want in pages)
    monkeypatch.setattr(html_extract, "content_paths", lambda blocks: set())
    assert all(html_extract.main_text(p) == "" for p, _ in pages)


def test_html_agrees_with_a_parser_on_the_pages(spark):
    """The article element, read by another parser, on the tables' pages, whose ratios know nothing of it."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.on, self.parts = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.on += tag == "article"
            if tag in html_extract.BLOCK:
                self.parts.append("")

        def handle_endtag(self, tag):
            self.on -= tag == "article"
            if tag in html_extract.BLOCK:
                self.parts.append("")

        def handle_data(self, data):
            if self.on:
                self.parts[-1] += data

    ship(spark)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        parser = Article()
        parser.feed(r.html or "")
        assert texts[r.page_id] == "\n".join(x for x in (" ".join(p.split()) for p in parser.parts) if x)
        unmarked = (r.html or "").replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_extract.main_text(unmarked) == texts[r.page_id]


def test_html_of_hostile_pages_takes_linear_time():
    import time

    began = time.perf_counter()
    for page in ('<a "' * 20_000, "<div>x" * 20_000, '<a ="x>' * 20_001 + '"', "<title>" * 20_000 + "x", "<b><p></b>" * 20_000, "<i>" * 20_000 + "</b>" * 20_000, "<!--" * 20_000, "<" * 50_000 + ">"):
        html_extract.main_text(page)
    assert time.perf_counter() - began < 15
    assert html_extract.main_text("<title>one<p>two") == "one\ntwo"
    assert html_extract.main_text("<form><p>All of the page, in a form.</p></form>") == "All of the page, in a form."


def test_warc(spark):
    ship(spark)
    big = "é" * 600
    df = spark.createDataFrame([(1, "u", big), (2, "v w", big), (3, None, big), (4, "x", "small"), (5, "y", "small"), (6, "z", None), (3, None, big)], "page_id long, url string, html string")
    out = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest) for r in warc.archived(df).collect())
    d = hashlib.sha1(big.encode()).hexdigest()
    assert [x for x in out if x[0] < 4] == [(1, "revisit", 3, 1200, d), (2, "revisit", 3, 1200, d), (3, "response", 0, 1200, d), (3, "revisit", 3, 1200, d)]
    assert all(x[1] == "response" for x in out if x[0] > 3)
    assert warc.archived(df.limit(0)).count() == 0


def test_warc_files_are_equal_however_they_are_written(spark, tmp_path):
    """Equal bytes over reruns, partitions, order and session settings; very long and empty texts, ids of all kinds, clashing columns."""
    ship(spark)
    ids = [None, None, -(1 << 63), -5, 0, 0, 0, 1, (1 << 63) - 1, *range(10, 400)] + [77] * 300
    rows = [(k, f"u{i % 3}", None if i % 50 == 0 else f"text {i % 290} " * (1 + 20_000 * (i == 30)), i, 1) for i, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int, range int")
    found = []
    for n, (parts, settings) in enumerate(((1, {}), (7, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "13"}), (3, {"spark.sql.shuffle.partitions": "2"}))):
        before = {k: spark.conf.get(k) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        folder = f"{tmp_path}/{n}"
        manifest = warc.write_archive(df.orderBy("url").repartition(parts), folder, least=5, roll_bytes=2_000, ranges=16, range_least=4_000)
        found.append(sorted(map(tuple, manifest.collect())))
        back = warc.read_archive(spark, folder).collect()
        for k, v in before.items():
            spark.conf.set(k, v)
        assert Counter((r.page_id, r.payload_digest) for r in back) == Counter((k, hashlib.sha1((t or "").encode()).hexdigest()) for k, _, t, *_ in rows)
    assert found[0] == found[1] == found[2] and len(found[0]) > 10
    names = [x[0] for x in found[0]]
    assert len(set(names)) == len(names)
    raw = {n: warc.get(f"{tmp_path}/0/{n}") for n in names}
    assert all(hashlib.sha256(raw[n]).hexdigest() == h for n, _, _, h in found[0])
    records = [re.search(rb"WARC-Record-ID: (\S+)", x)[1] for n in names for x in warc.members(*warc.opened(f"{tmp_path}/0/{n}"))]
    assert len(set(records)) == len(records) == len(rows)


def test_ranges_follow_the_data(spark):
    """No range but those of one heavy id and digest holds much more than its share, however ids lie."""
    ship(spark)
    rng = np.random.default_rng(3)
    for ids in (np.arange(5_000), rng.integers(-(1 << 62), 1 << 62, 5_000), np.r_[np.arange(2_500), (1 << 60) + np.arange(2_500)], np.r_[np.full(2_000, 9), np.arange(3_000)]):
        df = spark.createDataFrame([(int(k), 488) for k in ids], "page_id long, bytes long")
        starts = warc.range_starts(df, ranges=20, least=1)
        assert starts == sorted(set(starts)) and 20 <= len(starts) <= 45
        which = warc.range_of(starts)(ids.astype(np.int64), rng.integers(0, 1 << 32, len(ids)))
        assert np.bincount(which).max() <= 330
        order = np.lexsort((which, ids))
        assert (np.diff(which[order]) >= 0).all()


def test_toxicity(spark):
    ship(spark)
    rows = [(i, ("you are an idiot and a fool " if i % 3 == 0 else "a nice day in town ") + f"n{i}", "s") for i in range(120)] + [(500, "such an idoit", "s"), (501, None, None), (502, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, labels)
    out = {r.doc_id: r for r in toxicity.scored(df, lexicon).collect()}
    assert all(out[i].predicted == int(i % 3 == 0) for i in range(120))
    assert out[501].predicted == out[502].predicted == 0 and 0 <= out[501].score <= 1
    assert toxicity.Automaton(["idiot"]).look("idoit") == (1, "idiot")
    assert toxicity.scored(df.limit(0), lexicon).count() == 0
    again = spark.createDataFrame([(7, "you are an idiot", 1.0, 2), (7, "you are an idiot", 1.0, 2), (7, "a nice day " * 40_000 + "idiot", 1.0, 2), (None, "idiot", 1.0, 2)], "doc_id long, text string, score double, predicted int")
    rows = toxicity.scored(again, lexicon).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 7}) == 2 and all(r.n_matches >= 1 for r in rows)
    assert toxicity.without_toxic(again, lexicon).columns == again.columns
    assert toxicity.learn(df, labels.limit(0)).terms == []
    assert {r.doc_id for r in toxicity.without_toxic(df, lexicon).collect()} >= {i for i in range(120) if i % 3}


def test_context_tells_quotation_from_abuse(spark):
    """Quoted and reported abuse labelled clean gives the context its weight; held-out rows are told apart by it alone."""
    ship(spark)
    town = "the town has a market and a river and people walk along it in the evening"
    abuse = [f"{town} n{{}} along {w} the evening and a river" for w in ("idiot", "moron", "scumbag")]
    quoted = [f'{town} n{{}} along said "{w}" the evening and a river' for w in ("idiot", "moron", "scumbag")]
    rows, labels = [], []
    for i in range(600):
        kind = i % 4
        rows.append((i, (abuse[i % 3] if kind == 0 else quoted[i % 3] if kind == 1 and i % 3 else f"{town} n{{}}").format(i)))
        labels.append((i, int(kind == 0)))
    held = [(10_000 + i, (abuse if i % 2 else quoted)[i % 3].format(i)) for i in range(30)]
    df = spark.createDataFrame(rows + held, "doc_id long, text string")
    lexicon = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert lexicon.weights[3] < toxicity.PRIOR[3] - 0.5
    out = {r.doc_id: r for r in toxicity.scored(df, lexicon).collect()}
    assert all(out[10_000 + i].predicted == i % 2 for i in range(30))
    same = toxicity.Lexicon(lexicon.terms, lexicon.exceptions, [*lexicon.weights[:3], 0.0, 0.0])
    blind = {r.doc_id: r for r in toxicity.scored(df, same).collect()}
    assert any(blind[10_000 + i].predicted != i % 2 for i in range(30))


def test_misspelled_terms_are_met(spark):
    """Levenshtein distances by a plain computation: what the automaton accepts is what lies near a term, first letters equal."""
    import itertools
    import random

    def near(a, b):
        d = {(i, j): i + j if not i or not j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    random.seed(6)
    terms = ["idiot", "worthless", "pathetic", "scum"]
    automaton = toxicity.Automaton(terms)
    for _ in range(3_000):
        word = list(random.choice(terms))
        for _ in range(random.randint(0, 3)):
            k = random.randrange(1, len(word) + 1)
            word[k : k + random.randint(0, 1)] = random.choices("abcdeiost", k=random.randint(0, 1))
        word = "".join(word)
        want = min(((near(t, word), t) for t in terms if near(t, word) <= toxicity.errors_allowed(len(t), False) and t[0] == word[0]), default=None)
        assert automaton.match(word) == want


def test_chosen_terms_keep_what_stands_alone_and_leave_what_rides_along():
    """Terms: both words of mixed texts, not the word that only copies of one text carry, nor one too rare to tell."""
    # places: 0 main, 1 other (seen with and without main), 2 rider (always with main), 3 rare
    members = [[0, 1]] * 20 + [[0]] * 20 + [[1]] * 20 + [[0, 2]] * 20 + [[0, 3]] * 2
    counts = [("main", 62, 0), ("other", 40, 0), ("rider", 20, 0), ("rare", 2, 0)]
    assert toxicity.chosen_terms(counts, len(members), 300, members) == ["main", "other"]
    assert toxicity.chosen_terms([], 5, 5, [[]] * 5) == []


def test_terms_that_allow_no_errors():
    """A term with = is met letter by letter only."""
    assert toxicity.Automaton(["nonsense"]).match("nonsensse") == (1, "nonsense")
    strict = toxicity.Automaton(["nonsense="])
    assert strict.match("nonsensse") is None and strict.match("nonsense") == (0, "nonsense")
