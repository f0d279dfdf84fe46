import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from sparkgraft.llm import neardup, shingles


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text, k):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(rows, k, num, den):
    sets = {i: plain_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n_base=25, copies=12):
    """Families of copies with a few changed words, chains of ever more changes, exact copies, short texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(n_base):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 12, 60, 200]))]
        text = list(base)
        for _ in range(r.randrange(copies)):
            kind = r.random()
            if kind < 0.5:
                text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append((i, (" ".join(text)).upper() if kind > 0.9 else "\t".join(text)))
            i += 1
    r.shuffle(rows)
    return [(j, t) for j, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "k", "threshold", "most_rows"), [(1, 3, Fraction(85, 100), 2048), (2, 5, Fraction(80, 100), 2048), (3, 3, Fraction(85, 100), 4)])
def test_against_brute_force(spark, seed, k, threshold, most_rows):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, df, k, threshold, most_rows=most_rows).collect()}
    assert got == brute(rows, k, threshold.numerator, threshold.denominator)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (4, "ONE"), (9, "one two"), (3, "one  two"), (None, "one"), (8, "one"), (10, "x" * 5000), (11, "X" * 5000), (12, "é É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS node", "1 AS key", "2 AS label")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark, df, few_ids=0).collect())
    assert got == [(-1, 1, None, True), (3, 1, 3, True), (4, 1, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 4, False), (8, 1, 4, False), (9, 1, 3, False), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True)]
    assert neardup.near_duplicates(spark, df.limit(0)).count() == 0


def test_chunks_give_the_same_words(monkeypatch):
    text = " ".join("ab" * (i % 9 + 1) + str(i) for i in range(3000)) + " " + "q" * 9000 + "\x0b" + "é ü"
    whole = shingles.word_hashes(text)
    assert len(whole) == len(words(text)) and len(set(whole.tolist())) == len(set(words(text)))
    monkeypatch.setattr(shingles, "CHUNK", 101)
    assert np.array_equal(shingles.word_hashes(text), whole)


def test_bounds():
    least = neardup.least_matches(Fraction(85, 100))
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**32, neardup.HASHES, dtype=np.uint32)
    table = np.where(rng.random((2000, neardup.HASHES)) < 0.85, base, base + np.uint32(1))
    both = np.concatenate([base[None, :], table])
    assert len(neardup.agreeing(np.zeros(2000, int), np.arange(1, 2001), both, least)[0]) == 2000
    far = np.where(rng.random((2000, neardup.HASHES)) < 0.4, base, base + np.uint32(1))
    assert len(neardup.agreeing(np.zeros(2000, int), np.arange(1, 2001), np.concatenate([base[None, :], far]), least)[0]) == 0
    for t in (Fraction(85, 100), Fraction(80, 100)):
        n, r = neardup.bands(t)
        assert n * r <= neardup.HASHES and (1 - float(t) ** r) ** n <= 1e-6


def hidden_pair(k, threshold, n=60):
    """Two texts that reach the threshold and share no band of their signatures: words are put behind the first until no band is left."""
    n_bands, n_rows = neardup.bands(threshold)
    keys = lambda t: neardup.band_keys(neardup.signature(shingles.shingle_set(t, k))[None, :], n_bands, n_rows)[0]
    first = text = " ".join(f"w{i}" for i in range(n + k - 1))
    old, turn = keys(first), 0
    while (keys(text) == old).any():
        turn += 1
        tried = [f"{text} x{turn}y{i}" for i in range(600)]
        text = min(tried, key=lambda t: ((keys(t) == old).sum(), t))
    return first, text


@pytest.mark.parametrize(("k", "threshold"), [(3, Fraction(85, 100)), (5, Fraction(80, 100))])
def test_a_pair_that_shares_no_band_is_linked(spark, k, threshold):
    first, text = hidden_pair(k, threshold)
    rows = [(1, "another text of some words"), (2, first), (3, text)]
    want = brute(rows, k, threshold.numerator, threshold.denominator)
    assert want[3][1] == 2
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), k, threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("most_rows", [2048, 4])
def test_against_brute_force_where_bands_miss_nearly_all(spark, monkeypatch, most_rows):
    monkeypatch.setattr(neardup, "bands", lambda threshold: (1, 60))
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, df, 3, Fraction(85, 100), most_rows=most_rows, sample=100).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_texts_of_one_doc_id_are_linked(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, one), (2, one), (2, two), (3, two), (4, two), (4, None), (5, three), (4, "of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark, df, 3, Fraction(85, 100)).collect())
    assert got == [(1, 18, 1), (2, 18, 1), (2, 18, 1), (3, 18, 1), (4, 0, 1), (4, 1, 1), (4, 18, 1), (5, 18, 5)]


def test_the_last_family_searches_its_small_buckets_too(spark):
    """A pair that meets in a small bucket only, beside one that is dealt out in blocks."""
    far = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef"]
    rows = [(i, t) for i, t in enumerate(far)] + [(10, " ".join(f"z{i}" for i in range(40))), (11, " ".join(f"z{i}" for i in range(41)))]
    search = neardup.Search(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(85, 100), 100, 4, 10**6, 100)
    sets = search.shingle_sets(search.nodes, "sets")
    table = search.nodes.selectExpr("CASE WHEN node < 10 THEN 1L ELSE 2L END AS bucket", "node", "n_shingles")
    labels = search.across(table, search.nodes, sets, search.nodes.selectExpr("node", "node AS label"), 4)
    assert {r.node: r.label for r in labels.collect()}[11] == 10


def test_long_unrelated_texts_are_told_apart_where_they_meet(spark, monkeypatch):
    """Pairs of long texts with rare shingles in common aren't written out: their number grows with the square of the texts."""
    written, cut = {}, neardup.Scratch.cut

    def counted(self, df, name):
        out = cut(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(neardup.Scratch, "cut", counted)
    shared = [f"s{i}" for i in range(500)]
    rows = [(i, " ".join([*shared, *(f"t{i}w{j}" for j in range(n))])) for i, n in enumerate([3000, 3010, 3020, 3030, 6000, 6010, 9000, 9010, 20000, 20010])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, df, 3, Fraction(85, 100), sample=0).collect()}
    assert got == {i: i for i, _ in rows}
    assert written["between-rows"] > 0 and written["between-pairs"] == 0


def test_parities_of_any_size_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 1000, 2048, 2049, 5000, 20000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 7, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        for x in (neardup.coarse(len(a)), neardup.wide(len(a))):
            for y in (neardup.coarse(len(b)), neardup.wide(len(b))):
                assert neardup.parted(neardup.parities(a, x), neardup.parities(b, y)) <= apart
        held = [neardup.parities(s, neardup.coarse(len(s))) for s in (a, b)]
        lengths = np.array([len(x) for x in held])
        table = neardup.parity_table(pa.array(held, pa.binary()), lengths, int(lengths.min()))
        assert np.bitwise_count(table[0] ^ table[1]).sum() == neardup.parted(*held)
