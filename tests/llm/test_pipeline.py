"""The pipeline on a small table, stage by stage against plain computations, and on awkward rows."""

from collections import Counter

import pytest
from test_operators import packed_well, water_level, words

import corpus_pipeline
from lakeloom.llm import toxicity
from lakeloom.llm.common import ship, table, written

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def kept_by_brute_force(rows):
    """The smallest id of each component of documents whose sets of shingles are similar at 0.8 and more."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, (i, _) in zip(group, rows, strict=True):
        best[g] = min(best.get(g, i), i)
    return sorted(best.values())


def stages(spark, docs, folder):
    out = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), f"test-{name}")
        out.append(docs)
    return [*out, corpus_pipeline.STAGES[-1][1](spark, docs, folder)]


def test_stages(spark):
    ship(spark)
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    clean, unique, mixed, packed = stages(spark, docs, FOLDER)
    assert all(d.columns == docs.columns for d in (clean, unique, mixed))
    lexicon = toxicity.learn(docs, labels)
    automaton = lexicon.automaton()
    score = lambda t: sum(w * x for w, x in zip(lexicon.weights, toxicity.features(t, automaton, lexicon.exceptions), strict=True))
    calm = sorted((r.doc_id, r.text) for r in docs.collect() if score(r.text) < -0.8472978603872034)
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == calm and len(calm) > 150
    kept = kept_by_brute_force(calm)
    assert sorted(r.doc_id for r in unique.collect()) == kept and len(kept) < len(calm)
    taken, sizes = Counter(), Counter()
    whole = {r.doc_id: r for r in unique.collect()}
    names = sorted({r.source for r in whole.values()})
    for r in whole.values():
        sizes[r.source] += len(words(r.text))
    for r in mixed.collect():
        assert r.source == whole[r.doc_id].source and r.n_chars == len(r.text)
        taken[r.source] += len(words(r.text))
        there = iter(words(whole[r.doc_id].text))
        assert all(w in there for w in words(r.text))
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in zip(names, water_level([sizes[s] for s in names]), strict=True))
    packed_well(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()])
    row = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    again = corpus_pipeline.run(spark, FOLDER).collect()
    total = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert total(again) == total(packed.collect()) and len({row(r) for r in again}) > 0


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, tmp_path, empty):
    """Nulls, repeats, empty and very long texts, an empty table, extra columns whose names the operators use."""
    ship(spark)
    long = " ".join(f"w{i % 911}" for i in range(60_000))
    rows = [] if empty else [(1, long, "a", None, 5, 1), (1, long, "a", None, 5, 1), (None, None, None, None, None, None), (None, "no id", "b", "en", 5, 2), (2, "", "b", "en", 0, 3), (3, " \n ", None, "en", 3, 4), (4, "one", "c", "en", 3, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, row int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, 0), (None, 1), (9, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean, unique, mixed, packed = stages(spark, docs, str(tmp_path))
    assert clean.count() == len(rows)
    kept = unique.collect()
    assert len(kept) == (0 if empty else 4) and unique.columns == docs.columns == mixed.columns
    packed_well(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()])
