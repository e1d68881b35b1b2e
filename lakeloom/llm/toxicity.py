"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and the context of what they find.

The lexicon is learned from labelled rows: words and word stems that tell toxic texts from others, chosen one after another
by how many toxic texts they explain that earlier ones don't; clean texts speak against a term only where they don't quote
it. Words and stems form a trie. A word is walked through the
intersection of the trie with the Levenshtein automata of its edges: a state is the set of (trie node, errors) that can
be reached, made when first needed; long terms allow one error (longer ones two), never in the first letter. Words of
clean training texts that lie that near are kept as exceptions; terms with more of those than of misspellings in toxic
texts are matched letter by letter.

Each match is seen in a window of words: quotation marks and reporting words speak for a quotation, a second person for
abuse. Counts of the kinds of matches go into a logistic model, fitted to the same sample under a prior that stands where
the sample says nothing.

SAMPLE_TOXIC and SAMPLE_CLEAN bound the labelled rows that the fit uses (those of the smallest hashes), and with them the
terms and exceptions; scoring reads every text whole.

Defined results: a null or empty text scores as one without matches; labels that are null, or whose doc_id is null or
unknown, are left out; a doc_id labelled more than once is toxic if one label says so; without toxic (or clean) training
rows the prior holds, with the lexicon empty; equal doc_ids keep a row each; other columns are left alone.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, pieces, written

SAMPLE_TOXIC, SAMPLE_CLEAN = 3_000, 6_000
CLEAN_WEIGHT = 5
THRESHOLD = 0.3
#: The share of a word's toxic texts that another term may also explain.
RIDES = 0.8
#: Letters of a stem: shorter ones are parts of too many words.
STEM = range(5, 9)
WINDOW = 6
#: Words whose matches a worker remembers.
REMEMBERED = 200_000

# Characters that stand for letters, marks of quotation, words that report speech or name words, second persons.
LOOKALIKES = str.maketrans("0134579@$!|€", "oieastgasiie")
QUOTES = frozenset("\"'“”„«»‚‘’")
REPORTING = frozenset("said says say called calls quoted quote quotes wrote writes word words term terms insult insults slur slurs sagte schrieb wort dit écrit mot dijo escribió palabra".split())
SECOND_PERSON = frozenset("you your youre you're yourself u ur du dich dein ihr tu te toi vous tú usted eres".split())
#: The model where no data speaks: bias, exact matches, near matches, quoted, addressed (the counts as log2(1 + n)).
PRIOR = np.array([-2.5, 4.0, 3.0, -1.0, 0.5])
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")
RUNS = re.compile(r"(.)\1{2,}")


@dataclass
class Lexicon:
    """Terms (a stem ends in *, a term that allows no errors in =) with exceptions, and the automaton over them."""

    terms: list[str]
    exceptions: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: PRIOR.tolist())

    def automaton(self) -> Automaton:
        return Automaton(self.terms)


def errors_allowed(length: int, stem: bool) -> int:
    return 0 if length < 5 or stem else 1 if length < 8 else 2


class Automaton:
    """The trie met with Levenshtein automata, determinised as words need it.

    A state holds (node, errors, swapped) triples: errors made so far, and the letter that a transposition still owes.
    """

    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.limit, self.word, self.stem, self.allowed = [0], [""], [False], [0]
        for term in terms:
            stem, text = term.endswith("*"), term.rstrip("*=")
            at = 0
            allowed = 0 if term.endswith("=") else errors_allowed(len(text), stem)
            self.limit[0] = max(self.limit[0], allowed)
            for letter in text:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    self.limit.append(0)
                    self.word.append("")
                    self.stem.append(False)
                    self.allowed.append(0)
                at = self.next[at][letter]
                self.limit[at] = max(self.limit[at], allowed)
            self.word[at], self.stem[at] = text, stem or self.stem[at]
            self.allowed[at] = 0 if self.stem[at] else allowed
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = [frozenset({(0, 0, "")})]
        self.ids = {self.states[0]: 0}
        self.ends: list[tuple[int, str] | None] = [None]
        self.found: dict[str, tuple[int, str] | None] = {}

    def end_of(self, state: frozenset) -> tuple[int, str] | None:
        """(errors, term) of the nearest term that a word ending in this state spells."""
        best = None
        for node, errors, owed in state:
            if owed:
                continue
            todo = [(node, errors)]
            while todo:
                n, e = todo.pop()
                if self.word[n] and e <= self.allowed[n] and (best is None or (e, self.word[n]) < best):
                    best = (e, self.word[n])
                todo.extend((m, e + 1) for m in self.next[n].values() if e < self.limit[m])
        return best

    def step(self, state: int, letter: str, first: bool) -> int:
        key = (state, letter)
        if key in self.steps:
            return self.steps[key]
        out = set()
        for node, errors, owed in self.states[state]:
            if owed:
                if letter == owed:
                    out.add((node, errors, ""))
                continue
            # letters of the term left out before this one
            todo = [(node, errors)]
            while todo:
                n, e = todo.pop()
                if letter in self.next[n]:
                    out.add((self.next[n][letter], e, ""))
                if first:
                    continue
                for other, m in self.next[n].items():
                    if e < self.limit[m]:
                        todo.append((m, e + 1))
                        out.add((m, e + 1, ""))
                        for after, mm in self.next[m].items():
                            if after == letter != other and e < self.limit[mm]:
                                out.add((mm, e + 1, other))
                if e < self.limit[n]:
                    out.add((n, e + 1, ""))
        new = frozenset(out)
        if new not in self.ids:
            self.ids[new] = len(self.states)
            self.states.append(new)
            self.ends.append(self.end_of(new))
        self.steps[key] = self.ids[new]
        return self.ids[new]

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the nearest term or stem for a word, or nothing."""
        state, stem = 0, None
        for k, letter in enumerate(word):
            state = self.steps.get((state, letter), -1) if (state, letter) in self.steps else self.step(state, letter, k == 0)
            if not self.states[state]:
                return stem
            if stem is None:
                for node, errors, owed in self.states[state]:
                    if self.stem[node] and not owed and errors == 0:
                        stem = (0, self.word[node] + "*")
        return self.ends[state] if stem is None else stem

    def look(self, token: str) -> tuple[int, str] | None:
        """match() for a token of a text: punctuation around it goes, look-alikes and stretched letters are read as letters."""
        if token in self.found:
            return self.found[token]
        core = EDGE.sub("", token)
        best = self.match(core) if core else None
        if core and not core.isalpha() and (best is None or best[0]):
            others = [RUNS.sub(r"\1", core.translate(LOOKALIKES)), *INNER.split(core)]
            hits = [x for x in (self.match(o) for o in others if o and o != core) if x]
            best = min([*hits, *([best] if best else [])], default=None)
        if core and best is None and RUNS.search(core):
            best = self.match(RUNS.sub(r"\1", core))
        if len(self.found) < REMEMBERED:
            self.found[token] = best
        return best


def is_quoted(tokens: list[str], i: int) -> bool:
    """Whether the window of a token speaks for a quotation: marks before and after it, or a word of reporting."""
    t, before, after = tokens[i], tokens[max(0, i - WINDOW) : i], tokens[i : i + WINDOW + 1]
    opened = t[0] in QUOTES or any(w[:1] in QUOTES for w in before)
    closed = t[-1] in QUOTES or any(w[-1:] in QUOTES or w[-2:-1] in QUOTES for w in after)
    return opened and closed or any(EDGE.sub("", w) in REPORTING for w in (*before, *after))


def features(text: str | None, automaton: Automaton, exceptions: frozenset[str]) -> list[float]:
    """Counts of exact, near, quoted and addressed matches, as log2(1 + n), after a one for the bias."""
    tokens = (text or "").lower().split()
    hits = {t: x for t in set(tokens) if (x := automaton.look(t)) and (x[0] == 0 or EDGE.sub("", t) not in exceptions)}
    if not hits:
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    exact = near = quoted = addressed = 0
    for i, t in enumerate(tokens):
        if t not in hits:
            continue
        exact, near = exact + (hits[t][0] == 0), near + (hits[t][0] > 0)
        quoted += is_quoted(tokens, i)
        addressed += any(EDGE.sub("", w) in SECOND_PERSON for w in tokens[max(0, i - WINDOW) : i + WINDOW + 1])
    return [1.0, *(math.log2(1 + n) for n in (exact, near, quoted, addressed))]


def candidates(text: str | None, unquoted: bool = False) -> set[str]:
    """Words of a text, and their stems (with *); only of words outside quotations, if so asked."""
    out = set()
    tokens = (text or "").lower().split()
    if unquoted and (not QUOTES.isdisjoint(text or "") or any(EDGE.sub("", t) in REPORTING for t in set(tokens))):
        tokens = [t for i, t in enumerate(tokens) if not is_quoted(tokens, i)]
    for token in set(tokens):
        word = EDGE.sub("", token)
        if 3 <= len(word) <= 40 and word.isalpha():
            out.add(word)
            out.update(word[:k] + "*" for k in STEM if k <= len(word))
    return out


def counted(rows: DataFrame, wanted=None) -> DataFrame:
    """term, n: in how many of the texts each candidate term is. wanted: a broadcast set of terms, to be met outside quotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            for at in range(0, len(items), 10_000):
                terms, n = zip(*items[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n, pa.int64())], names=["term", "n"])
            counts.clear()

        only = wanted.value if wanted is not None else None
        for batch in pieces(batches, "text"):
            for text in batch.column("text").to_pylist():
                counts.update(candidates(text) if only is None else candidates(text, True) & only)
            if len(counts) > 400_000:
                yield from flush()
        yield from flush()

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fitted(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to the prior."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + strength / 2 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step, size, now = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        # halved until it helps: a full step can overshoot where the classes part cleanly
        while loss(w - size * step) > now - 1e-4 * size * float(gradient @ step) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def chosen_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, members: list[list[int]]) -> list[str]:
    """Terms in the order in which they explain toxic texts. members: for each text, places in counts."""
    texts: list[set[int]] = [set() for _ in counts]
    for i, places in enumerate(members):
        for p in places:
            texts[p].add(i)
    # Precision, with one clean text's worth of doubt; clean texts are rarer in the sample than outside, and weigh CLEAN_WEIGHT. Of terms that explain equally much the whole word wins, then the longer one.
    share = n_toxic / max(1, n_toxic + n_clean)
    worth = [math.log(max((t + share) / (t + 1 + CLEAN_WEIGHT * c), 1e-9) / share) for _, t, c in counts]
    # How unlikely so many toxic texts are by chance (Chernoff's bound, as a logarithm): with as much as this, less than one of all candidates gets in so.
    enough = math.log(max(2, len(counts)))
    sure = [t * math.log(t / (t + c) / share) + (c * math.log(c / (t + c) / (1 - share)) if c else 0.0) >= enough for _, t, c in counts]
    rank = lambda k: (-len(texts[k] & open_) * worth[k], counts[k][0].endswith("*"), -len(counts[k][0]), counts[k][0], k)
    open_, out, least = set(range(len(members))), [], max(2, 0.002 * n_toxic)
    # Gains only fall, so the first whose gain is still right is the best.
    heap = [rank(k) for k in range(len(counts)) if len(texts[k]) >= least and worth[k] > 0 and sure[k]]
    heapq.heapify(heap)
    while heap and open_:
        best = heapq.heappop(heap)
        k = best[-1]
        if len(texts[k] & open_) < least:
            continue
        if (now := rank(k)) != best:
            heapq.heappush(heap, now)
            continue
        out.append(k)
        open_ -= texts[k]
    # A word that makes up half of a stem's texts is a term too, so that its misspellings are met.
    stems = [k for k in out if counts[k][0].endswith("*")]
    words = [w for w, (term, _, _) in enumerate(counts) if not term.endswith("*") and w not in out and any(term.startswith(counts[k][0][:-1]) and len(texts[w]) >= max(least, 0.5 * len(texts[k])) for k in stems)]
    # So are words that stand for themselves although other terms explain their texts; what only rides along in copies shares nearly all its texts with one term.
    alone, covers = [], [texts[k] for k in out]
    for k in sorted(range(len(counts)), key=lambda k: (-len(texts[k]), counts[k][0])):
        mine = texts[k]
        if counts[k][0].endswith("*") or not sure[k] or len(mine) < max(least, 0.01 * n_toxic) or worth[k] <= 0 or k in words or k in out:
            continue
        if all(len(mine & other) <= RIDES * len(mine) for other in covers):
            alone.append(k)
            covers.append(mine)
    return [counts[k][0] for k in out + alone + words]


def learn(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Lexicon:
    """A lexicon and its model from labelled rows that aren't held out."""
    spark = docs.sparkSession
    known = labels.filter("doc_id is not null and toxic is not null").filter(F.pmod(crc32_of("doc_id"), F.lit(4)) != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter("toxic = 1").orderBy(*order).limit(sample_toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(sample_clean))
    # At most sample_toxic + sample_clean ids: that bound is what makes the broadcast safe.
    texts = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "labelled")
    toxic, clean = texts.filter("toxic = 1"), texts.filter("toxic = 0")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon([])
    least = max(2, int(0.002 * n_toxic))
    often = counted(toxic).filter(F.col("n") >= least)
    wanted = spark.sparkContext.broadcast({r["term"] for r in often.select("term").toLocalIterator()})
    in_clean = counted(clean, wanted).withColumnRenamed("n", "c")
    both = often.join(in_clean, "term", "left").select("term", "n", F.coalesce("c", F.lit(0)).alias("c"))
    # a term of the lexicon tells toxic texts at least as often as not
    counts = [tuple(r) for r in both.filter(F.col("n") * n_clean > F.col("c") * n_toxic).filter(F.col("n") >= 2 * F.col("c")).orderBy("term").collect()]
    wanted.unpersist()
    places = spark.sparkContext.broadcast({t: k for k, (t, _, _) in enumerate(counts)})

    def belong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows = [sorted(places.value[t] for t in candidates(x) if t in places.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "places"])

    members = [r["places"] for r in toxic.select(F.col("doc_id").cast("long"), "text").mapInArrow(belong, "doc_id long, places array<int>").orderBy("doc_id").toLocalIterator()]
    lexicon = Lexicon(chosen_terms(counts, n_toxic, n_clean, members))
    places.unpersist()
    terms = lexicon.terms

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton(terms), Counter()
        for batch in pieces(batches, 1):
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hits = {(x[1], EDGE.sub("", t)) for t in set((text or "").lower().split()) if (x := automaton.look(t)) and x[0]}
                seen.update({(term, None) for term, _ in hits} if toxic else hits)
        rows = [(*key, n) for key, n in seen.items()]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["term", "word", "n"])

    # Words near a term: those of the clean sample one by one, those of the toxic sample as their number (word is null).
    met = texts.select(F.col("toxic").cast("int"), "text").mapInArrow(near, "term string, word string, n long").groupBy("term", "word").agg(F.sum("n").alias("n"))
    in_toxic, in_clean, exceptions = Counter(), Counter(), set()
    for term, word, n_texts in met.toLocalIterator():
        if word is None:
            in_toxic[term] += n_texts
        else:
            in_clean[term] += n_texts
            exceptions.add(word)
    loose = max(1, 0.0005 * n_clean)
    terms = lexicon.terms = [f"{t}=" if in_clean[t] > in_toxic[t] + loose else t for t in terms]
    lexicon.exceptions = frozenset(exceptions)
    exceptions = lexicon.exceptions

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        for batch in pieces(batches, 1):
            rows = [features(x, automaton, exceptions) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = texts.select(F.col("toxic").cast("int"), "text").mapInArrow(measure, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    rows = sorted((tuple(r["x"]), r["toxic"], r["count"]) for r in rows)
    x, y = np.repeat(np.array([r[0] for r in rows]), [r[2] for r in rows], axis=0), np.repeat([r[1] for r in rows], [r[2] for r in rows])
    lexicon.weights = fitted(x, y).tolist()
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches of every document."""
    terms, exceptions, weights = lexicon.terms, lexicon.exceptions, np.array(lexicon.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        for batch in pieces(batches, 1):
            x = np.array([features(t, automaton, exceptions) for t in batch.column(1).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            found = np.rint(np.exp2(x[:, 1]) + np.exp2(x[:, 2]) - 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(found)], names=["doc_id", "score", "n_matches"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, n_matches long")
    held_out = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(4)) == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose text scores at the threshold or above, all columns kept; no shuffle."""
    terms, exceptions, weights = lexicon.terms, lexicon.exceptions, np.array(lexicon.weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        for batch in pieces(batches, at):
            x = np.array([features(t, automaton, exceptions) for t in batch.column(at).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
