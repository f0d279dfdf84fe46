"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled rows: word stems that are far more frequent in toxic
documents than in clean ones, found by two counting jobs. A trie holds the stems, of 4 to 12
letters. A word that no stem begins is run through the trie together with its Levenshtein
automaton, so that misspelled terms are found; both walks stop as soon as the automaton dies.
In stems of 4 and 5 letters two neighbouring letters may also be exchanged, and their hits are
kept apart by whether the whole word or only its beginning is near. What a misspelt hit is
worth follows from a third counting job: how often clean documents hold words so near. The
regression sees each labelled row twice, the second time as if its terms were misspelt, as
labelled rows hold few misspellings to learn from. Each hit is seen in a window of its text: quotation marks and words of reporting speak for a quotation,
words of address speak for abuse. A logistic regression over these counts gives the score.

The model is fitted on at most `sample` labelled rows, taken by hash; every document is
scored by its whole text where it lies, so nothing is shuffled but the bounded sample and
nothing grows on the driver (the lexicon is a model of at most `terms` stems; beyond the terms proper,
which come first, stand words of toxic documents that have many near copies). Scores use the text alone.

Defined results: a null or empty text has the score of a text without hits; a null doc_id is
scored and counts as not held out; repeated rows are scored each (learned from once, by the
smallest text of a doc_id); without labelled rows of
both kinds every score is 0; an empty table gives no rows; extra columns are ignored. Of
labels that contradict each other for a doc_id the higher is taken.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_hash, lean
from .logistic import Logistic

WORD = re.compile(r"\w+")
# What speaks for quotation, and what for address.
QUOTES = frozenset("\"'“”„«»‘’‚`>")
REPORTING = frozenset("said says say called call calls wrote writes word words term terms quote quoted quoting quotes insult slur meaning means dit disait écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())
ADDRESS = frozenset("you your youre yours u ur are du dein bist tu toi ton es tú eres usted vous votre".split())
STEM = (4, 12)


EXACT, FUZZY, SHORT, LOOSE = range(4)  # how a stem is found: as it is; misspelt; if it is short, misspelt as the whole word or as a beginning


class Trie:
    """Stems; `find` gives the index of the stem that begins a word, and how it does (EXACT to LOOSE, the least of these)."""

    def __init__(self, stems: list[str], fuzzy_from: int = 6, short_from: int = 4):
        self.root: dict = {}
        for i, stem in enumerate(stems):
            node = self.root
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = i
        self.stems, self.fuzzy_from, self.short_from = stems, fuzzy_from, short_from
        self.short = {s: i for i, s in enumerate(stems) if short_from <= len(s) < fuzzy_from}
        self.sizes = sorted({len(s) for s in self.short})
        # a beginning within one edit or exchange of a short stem equals it with one letter left out of it, of the stem or of both: lossless too
        self.parts = {s[:i] + s[i + 1 :] for s in self.short for i in range(len(s))} | set(self.short)
        self.spans = sorted({n for size in self.sizes for n in (size, size + 1)})
        # a word within one edit of a stem keeps its first half in place, or its second half moved by one letter at most: a lossless test before the walk
        self.first: dict[int, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
        self.second: dict[tuple[int, int], set[str]] = defaultdict(set)
        for s in stems:
            if len(s) >= fuzzy_from:
                half = len(s) // 2
                self.first[half][s[:half]] |= {s[half], s[half + 1 : half + 3]}
                for at in (half - 1, half, half + 1):
                    self.second[at, at + len(s) - half].add(s[half:])

    def near(self, word: str) -> bool:
        """Whether a long stem may begin the word within one edit: its second half in place, or its first half and then its next letter, or the two after that moved by one at most."""
        for n, found in self.first.items():
            after = found.get(word[:n])
            if after and (word[n : n + 1] in after or word[n : n + 2] in after or word[n + 1 : n + 3] in after or word[n + 2 : n + 4] in after):
                return True
        return any(word[a:b] in found for (a, b), found in self.second.items())

    def near_short(self, word: str) -> bool:
        parts = self.parts
        for size in self.sizes:
            if word[: size - 1] in parts:
                return True
        for n in self.spans:
            start = word[:n]
            if len(start) == n:
                for i in range(n):
                    if start[:i] + start[i + 1 :] in parts:
                        return True
        return False

    def exchanged(self, word: str) -> tuple[int, int] | None:
        """A short stem with two neighbouring letters exchanged, which Levenshtein's distance takes for two edits."""
        found = []
        for size in self.sizes:
            for i in range(size - 1 if len(word) >= size else 0):
                stem = self.short.get(word[:i] + word[i + 1] + word[i] + word[i + 2 : size])
                if stem is not None:
                    found.append((SHORT if len(word) == size else LOOSE, stem))
        return min(found, default=None)

    def find(self, word: str) -> tuple[int, int] | None:
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                return node[""], 0
        short = self.near_short(word)
        if not short and (len(word) < self.fuzzy_from - 1 or not self.near(word)):
            return None
        best = self.exchanged(word) if short else None
        # states: (trie node, letters of the stem, {letters of the word: edits}); the automaton's positions within one edit
        stack = [(self.root, 0, {0: 0, 1: 1})]
        while stack:
            node, depth, at = stack.pop()
            if "" in node and depth >= self.short_from and at:
                found = (FUZZY if depth >= self.fuzzy_from else SHORT if len(word) in at else LOOSE, node[""])
                best = found if best is None or found < best else best
            for c, below in node.items():
                if c == "":
                    continue
                after: dict[int, int] = {}
                for i, edits in at.items():
                    if i < len(word) and word[i] == c:
                        after[i + 1] = min(after.get(i + 1, 2), edits)
                    if edits == 0:
                        after[i] = min(after.get(i, 2), 1)  # the word lacks this letter
                        if i < len(word):
                            after[i + 1] = min(after.get(i + 1, 2), 1)  # another letter
                            if i + 1 < len(word) and word[i + 1] == c:
                                after[i + 2] = min(after.get(i + 2, 2), 1)  # a letter too many
                if after:
                    stack.append((below, depth + 1, after))
        return best and best[::-1]


class Scorer:
    """Features of a text, with a bounded table of words already looked up."""

    NAMES = ("exact", "fuzzy", "short", "loose", "weight", "top", "distinct", "quoted", "addressed", "share", "abuse")

    def __init__(self, lexicon: list[tuple[str, float]], most: int = 200_000, worth: dict[tuple[int, int], float] | None = None):
        """worth: of a term misspelt in each of the ways, by term and way; half the weight if it isn't given."""
        self.trie, self.weights, self.known, self.most = Trie([s for s, _ in lexicon]), [w for _, w in lexicon], {}, most
        self.before: dict[str, tuple[int, int] | None] = {}  # what was known before the table was last full
        self.worth = worth or {}

    def look(self, word: str) -> tuple[int, int] | None:
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) >= self.most:
                self.before, self.known = self.known, {}
            found = self.before[word] if word in self.before else self.trie.find(word)
            if found and found[1] != EXACT and self.worth.get(found, 1.0) <= 0:
                found = None
            self.known[word] = found
            return found

    def misspelt(self, word: str, term: int) -> int:
        """How the term would be found if this word, which it begins, were misspelt."""
        stem = self.trie.stems[term]
        return FUZZY if len(stem) >= self.trie.fuzzy_from else SHORT if len(word) == len(stem) else LOOSE

    def features(self, text: str | None, misspell: bool = False) -> list[float]:
        """misspell: as if all terms of the text were misspelt."""
        text = (text or "").lower()
        words = WORD.findall(text)
        hits = [(i, h) for i, h in enumerate(map(self.look, words)) if h]
        if misspell:
            hits = [(i, (term, how or self.misspelt(words[i], term))) for i, (term, how) in hits]
            hits = [(i, h) for i, h in hits if self.worth.get(h, 1.0) > 0]
        if not hits:
            return [0.0] * len(self.NAMES)
        wanted, spans = {i for i, _ in hits}, {}
        for i, m in enumerate(WORD.finditer(text)):
            if i in wanted:
                spans[i] = m.span()
        count = [0, 0, 0, 0]
        whole = 0.0  # hits, each by its share of the worth of an exact one
        weight = top = quoted = addressed = abuse = 0.0
        terms = set()
        for i, (term, how) in hits:
            worth = self.weights[term] if how == EXACT else self.worth.get((term, how), self.weights[term] / 2)
            around = words[max(0, i - 6) : i] + words[i + 1 : i + 7]
            a, b = spans[i]
            marks = (text[a - 1 : a] in QUOTES and a > 0) + (b < len(text) and text[b] in QUOTES)
            reported = marks == 2 or (marks and any(w in REPORTING for w in around)) or sum(w in REPORTING for w in around) > 1
            faced = any(w in ADDRESS for w in around)
            count[how] += 1
            whole += min(1.0, worth / self.weights[term])
            weight, top = weight + worth, max(top, worth)
            quoted, addressed = quoted + bool(reported), addressed + faced
            abuse += worth * (0.25 if reported else 1.0)
            terms.add(term)
        n = len(words)
        return [*np.log1p(count), np.log1p(weight), top, np.log1p(len(terms)), quoted / len(hits), addressed / len(hits), min(1.0, 20 * whole / n), np.log1p(abuse)]


@lru_cache(maxsize=1)
def scorer_of(lexicon: tuple[tuple[str, float], ...], worth: tuple[tuple[tuple[int, int], float], ...] | None = None) -> Scorer:
    """One table of words for all tasks that a worker runs."""
    return Scorer(list(lexicon), worth=dict(worth or ()))


def misspelt_worth(lexicon: list[tuple[str, float]], toxic: dict[str, int], false: dict[tuple[int, int], int], n_toxic: int, n_clean: int) -> dict[tuple[int, int], float]:
    """The log-odds of each term if all its toxic rows misspelt it, against the clean rows that hold words so near to it; none below nought."""
    return {
        (i, how): max(0.0, float(np.log((toxic[stem] + 0.5) / (n_toxic + 1)) - np.log((false.get((i, how), 0) + 0.5) / (n_clean + 1))))
        for i, (stem, _) in enumerate(lexicon)
        for how in (FUZZY, SHORT, LOOSE)
    }


def count_false(rows: DataFrame, lexicon: list[tuple[str, float]]) -> DataFrame:
    """term, how, n: the number of rows whose text has a word that is found so, though not exactly."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for b in batches:
            n: Counter = Counter()
            for text in b.column(0):
                n.update({h for h in map(scorer.look, set(WORD.findall((text.as_py() or "").lower()))) if h and h[1] != EXACT})
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in n], pa.int32()), pa.array([h for _, h in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["term", "how", "n"])

    return rows.select("text").mapInArrow(lean(run), "term int, how int, n long").groupBy("term", "how").agg(F.sum("n").alias("n"))


def stems_of(words: set[str]) -> set[str]:
    low, high = STEM
    return {w[:k] for w in words for k in range(low, min(high, len(w)) + 1)}


def count_stems(rows: DataFrame) -> DataFrame:
    """stem, a, b: the number of toxic and of clean rows whose text has a word that begins so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found[toxic].update(stems_of(set(WORD.findall((text.as_py() or "").lower()))))
            stems = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([found[i][s] for s in stems], pa.int64()) for i in (1, 0))], ["stem", "a", "b"])

    return rows.select("toxic", "text").mapInArrow(lean(run), "stem string, a long, b long").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def telling(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """The stems that tell enough, with their log-odds and what they tell (half the likelihood ratio)."""
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_clean + 1))
    share = (a + b) / F.lit(n_toxic + n_clean)
    told = a * F.log(a / (n_toxic * share)) + F.when(b > 0, b * F.log(b / (n_clean * share))).otherwise(0.0)
    return counts.where((a >= max(3, n_toxic // 200)) & (odds >= 2.0) & (told >= 8.0)).select("stem", "a", odds.alias("odds"), F.round(told, 6).alias("told"))


def choose(rated: list[tuple[str, float, float]], terms: int) -> list[tuple[str, float]]:
    """Of stems with their log-odds and what they tell, none the beginning of another: those that tell most about the label, of equals the longest."""
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # every beginning of a chosen stem
    for stem, odds, _ in sorted(rated, key=lambda r: (-r[2], -len(r[0]), r[0])):
        if stem not in begun and not any(stem[:k] in chosen for k in range(1, len(stem))):
            chosen[stem] = odds
            begun.update(stem[:k] for k in range(1, len(stem) + 1))
            if len(chosen) >= terms:
                break
    return sorted(chosen.items())


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 20_000, terms: int = 300) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. labels: doc_id, toxic."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = by_hash(marked, "doc_id", sample)
    held = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    train = Scratch(spark, "toxicity").cut(held.select("text", "toxic"), "train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon: list[tuple[str, float]] = []
    model, worth = None, ()
    if n_toxic and n_clean:
        found = telling(count_stems(train), n_toxic, n_clean).collect()  # bounded by the sample
        toxic = {r["stem"]: r["a"] for r in found}
        lexicon = choose([(r["stem"], r["odds"], r["told"]) for r in found], terms)
        false = {(r["term"], r["how"]): r["n"] for r in count_false(train.where("toxic = 0"), lexicon).collect()}
        worth = tuple(misspelt_worth(lexicon, toxic, false, n_toxic, n_clean).items())
        shared = spark.sparkContext.broadcast((tuple(lexicon), worth))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = scorer_of(*shared.value)
            for b in batches:
                for misspell in (False, True):  # misspelt terms are rare in labelled rows, so each row is also learned from as if it had them
                    yield pd.DataFrame({"toxic": b.toxic, "x": [scorer.features(t, misspell) for t in b.text]})

        rows = train.mapInPandas(measure, "toxic int, x array<double>").toPandas()
        model = Logistic.fit(np.array(rows.x.tolist()), rows.toxic.to_numpy())
    shared_model = spark.sparkContext.broadcast((tuple(lexicon), worth, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own, fitted = shared_model.value
        scorer = scorer_of(words, own)
        for b in batches:
            ids = b.column(0).to_pylist()
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            x = [scorer.features(t.as_py()) for t in b.column(1)]
            p = fitted.predict(np.array(x)) if fitted is not None and x else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
