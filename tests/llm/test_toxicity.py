import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgraft.llm import toxicity
from sparkgraft.llm.logistic import Logistic


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


STEMS = ["abcabc", "bcabcc", "aabbccab", "cab"]


@settings(max_examples=500, deadline=None)
@given(st.text("abcd", min_size=1, max_size=10))
def test_trie_and_automaton_against_edit_distances(word):
    begins = [i for i, s in enumerate(STEMS) if word.startswith(s)]
    near = [i for i, s in enumerate(STEMS) if len(s) >= 6 and any(distance(word[:k], s) <= 1 for k in range(len(word) + 1))]
    found = toxicity.Trie(STEMS).find(word)
    if begins:
        assert found[1] == 0 and found[0] in begins
    elif near:
        assert found == (min(near), 1)
    else:
        assert found is None


def make(n, seed=0):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu") for b in ("ra", "lo", "ne", "si", "va")]
    rows = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(20, 80))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grumpus", "zorkhead", "vilestink"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_misspellings(spark):
    rows = make(600)
    extra = [(9001, "ba ko you grumqus you mi vilstink tu ra", None), (9002, "ba ko mi tu", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t) for i, t, _ in extra], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, text int")
    got = {r.doc_id: r for r in toxicity.score(spark, docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 60 and np.mean([p == y for p, y in held]) > 0.98
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert got[9001].score > got[9002].score


def test_quotation_is_told_from_abuse():
    scorer = toxicity.Scorer([("grumpus", 5.0)])
    names = toxicity.Scorer.NAMES
    quoted = dict(zip(names, scorer.features('he said the word "grumpus" was called an insult'), strict=True))
    plain = dict(zip(names, scorer.features("you are such a grumpus and it is so"), strict=True))
    assert quoted["quoted"] == 1 and plain["quoted"] == 0 and plain["addressed"] == 1 and quoted["abuse"] < plain["abuse"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "grumpus"), (3, "a" * 300_000), (3, "a")], "doc_id long, text string").selectExpr("*", "9 AS toxic")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(spark, docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([(i, y) for i, _, y in make(100)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t, _ in make(100)], "doc_id long, text string"))
    rows = toxicity.score(spark, more, labels).collect()
    assert len(rows) == 105 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(spark, docs.limit(0), labels).count() == 0


def test_logistic_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    fitted = Logistic.fit(x, (rng.random(4000) < p).astype(int))
    assert np.abs(fitted.predict(x) - p).mean() < 0.03
    with pytest.raises(ValueError):
        fitted.predict(np.zeros((2, 3)))


def exchanged(stem):
    return {stem[:i] + stem[i + 1] + stem[i] + stem[i + 2 :] for i in range(len(stem) - 1)}


@settings(max_examples=500, deadline=None)
@given(st.text("abcd", min_size=1, max_size=9))
def test_short_stems_against_edit_distances(word):
    stems = ["abcda", "bdca", "cbbdac", "ddd"]
    found = toxicity.Trie(stems).find(word)
    ways = []
    for i, s in enumerate(stems):
        ends = [k for k in range(len(word) + 1) if distance(word[:k], s) <= 1 or (len(s) < 6 and word[:k] in exchanged(s))]
        if len(s) >= 4 and ends:
            ways.append((1 if len(s) >= 6 else 2 if len(word) in ends else 3, i))
    if any(word.startswith(s) for s in stems):
        assert found[1] == 0
    else:
        assert found == (min(ways)[::-1] if ways else None)


def test_misspelt_terms_of_five_letters(spark):
    r = random.Random(3)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu") for b in ("ra", "lo", "ne", "si", "va")]

    def text(terms):
        words = [r.choice(plain) for _ in range(40)]
        for t in terms:
            words.insert(r.randrange(len(words)), t)
        return " ".join(words)

    names = ["idiot", "loser", "clown", "moron", "scum"]
    rows = [(i, text(r.choices(names, k=3) if i % 3 == 0 else []), int(i % 3 == 0)) for i in range(600)]
    wrong = ["idoit", "l0ser", "cl0wn", "mor0n", "scvm", "idots", "looser", "l0sers", "cluwn", "mroon"]
    extra = [(9000 + i, text([w, wrong[i - 1], w])) for i, w in enumerate(wrong)] + [(9100 + i, text([])) for i in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.score(spark, docs, labels).collect()}
    assert all(got[9000 + i] == 1 for i in range(10)) and not any(got[9100 + i] for i in range(10))
    assert all(got[i] == y for i, _, y in rows)


def test_choose_takes_those_that_tell_most():
    rated = [(f"{a}{b}xx", 2.5, float(i)) for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst")] + [("aax", 3.0, 500.0), ("aaxxy", 3.0, 1.0), ("zzzz", 2.0, 9.0), ("zzzzz", 2.0, 9.0)]
    got = dict(toxicity.choose(rated, 1000))
    assert list(dict(toxicity.choose(rated, 2))) == ["aax", "ttxx"]
    assert len(got) == 401 and "aax" in got and "aaxx" not in got and "aaxxy" not in got and "zzzzz" in got and "zzzz" not in got


def test_scores_recomputed_plainly(spark):
    """The lexicon, what misspelt terms are worth and the regression by plain loops over all labelled rows."""
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    train = [(labels[i], t) for i, t in docs if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    n = Counter(y for y, _ in train)
    counts = (Counter(), Counter())
    for y, t in train:
        counts[y].update({w[:k] for w in words(t) for k in range(4, min(12, len(w)) + 1)})
    rated = []
    for stem, a in counts[1].items():
        b = counts[0][stem]
        odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        share = (a + b) / (n[0] + n[1])
        told = a * math.log(a / (n[1] * share)) + (b * math.log(b / (n[0] * share)) if b else 0.0)
        if a >= max(3, n[1] // 200) and odds >= 2 and told >= 8:
            rated.append((stem, odds, round(told, 6)))
    lexicon = []
    for stem, odds, _ in sorted(rated, key=lambda r: (-r[2], -len(r[0]), r[0])):
        if not any(stem.startswith(s) or s.startswith(stem) for s, _ in lexicon):
            lexicon.append((stem, odds))
            if len(lexicon) == 300:
                break
    lexicon.sort()
    trie, false = toxicity.Trie([s for s, _ in lexicon]), Counter()
    for y, t in train:
        if y == 0:
            false.update({h for h in map(trie.find, words(t)) if h and h[1]})
    worth = {(i, how): max(0.0, math.log((counts[1][s] + 0.5) / (n[1] + 1)) - math.log((false[i, how] + 0.5) / (n[0] + 1))) for i, (s, _) in enumerate(lexicon) for how in (1, 2, 3)}
    scorer = toxicity.Scorer(lexicon, worth=worth)
    rows = [(y, scorer.features(t, misspell)) for y, t in train for misspell in (False, True)]
    model = Logistic.fit(np.array([x for _, x in rows]), np.array([y for y, _ in rows]))
    want = {i: float(p) for (i, _), p in zip(docs, model.predict(np.array([scorer.features(t) for _, t in docs])), strict=True)}
    got = {r.doc_id: r.score for r in toxicity.score(spark, spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-4
