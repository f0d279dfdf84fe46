import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkgraft.llm import decontam
from sparkgraft.llm.common import table
from sparkgraft.llm.decontam import Benchmark, MultiIndex


def grams(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(text, items, k=5, t=0.8):
    words, out = re.findall(r"\w+", (text or "").lower()), {}
    for i, item in items:
        w = re.findall(r"\w+", item.lower())
        if not w:
            continue
        if len(w) < k:
            if w == words:
                out[i] = (1.0, 0, len(w))
            continue
        a = grams(w)
        for s in range(len(words) - len(w) + 1):
            b = grams(words[s : s + len(w)])
            common = sum((a & b).values())
            similarity = common / (sum(a.values()) + sum(b.values()) - common)
            if similarity >= t and similarity > out.get(i, (0,))[0]:
                out[i] = (similarity, s, len(w))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30 if seed % 2 else 300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 5, 9, 20, 60])))) for i in range(40)]
    held = Benchmark(items, 5, 0.8, 40)
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(80))]
        for _ in range(r.randrange(3)):
            leak = r.choice(items)[1].upper().split()
            for _ in range(r.randrange(3)):
                leak[r.randrange(len(leak))] = "other"
            at = r.randrange(len(words) + 1)
            words[at:at] = leak
        text = " ".join(w + r.choice(["", ",", ".\n"]) for w in words)
        assert {i: tuple(m) for i, *m in held.matches(text)} == brute(text, items)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    base[100:] = base[:200] ^ np.packbits(rng.random((200, 128)) < 0.25, axis=1)
    index = MultiIndex(base, 40)
    away = np.bitwise_count(base[::7, None] ^ base[None]).sum(axis=2)
    assert np.array_equal(np.stack(index.within(base[::7])), np.stack(np.nonzero(away <= 40)))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {}
    for r in decontam.contaminated(spark, docs, bench).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = (r.similarity, r.start_word, r.n_words)
    want = {r.doc_id: m for r in docs.collect() if any(" ".join(i.split()[2:5]) in (r.text or "") for _, i in items) and (m := brute(r.text, items))}
    assert got == want
    parts = decontam.contaminated(spark, docs, bench, part_rows=7)
    assert {(r.doc_id, r.item_id) for r in parts.collect()} == {(d, i) for d, m in got.items() for i in m}


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, "one two"), (2, ""), (3, None), (None, long), (4, long), (5, long.upper())], "item_id long, text string")
    rows = [(1, None, "a"), (2, "", "a"), (3, "One, two!", "a"), (4, "one two three", "a"), (5, "x " * 50_000 + long + " y" * 10, "a"), (None, long, "a"), (6, long, "a"), (6, long, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.start_word) for r in decontam.contaminated(spark, docs, bench).collect())
    assert got == [(0, 4, 0), (0, 5, 0), (3, 1, 0), (5, 4, 50_000), (5, 5, 50_000), (6, 4, 0), (6, 4, 0), (6, 5, 0), (6, 5, 0)]
    left = decontam.clean_documents(spark, docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [1, 2, 4]
    assert decontam.contaminated(spark, docs, bench.limit(0)).count() == 0 and decontam.contaminated(spark, docs.limit(0), bench).count() == 0


def brute_whole(text, items, k=5, t=0.8):
    """As brute, and a text shorter than an item is held against it as one window."""
    words, out = re.findall(r"\w+", (text or "").lower()), brute(text, items, k, t)
    for i, item in items:
        w = re.findall(r"\w+", item.lower())
        if len(w) > len(words) >= k:
            a, b = grams(w), grams(words)
            common = sum((a & b).values())
            similarity = common / (sum(a.values()) + sum(b.values()) - common)
            if similarity >= t and similarity > out.get(i, (0,))[0]:
                out[i] = (similarity, 0, len(words))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_texts_shorter_than_an_item(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30 if seed % 2 else 300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 5, 9, 20, 59, 60, 200])))) for i in range(40)]
    held, short = Benchmark(items, 5, 0.8, 40), 0
    for _ in range(200):
        words = r.choice(items)[1].split()
        lost = r.randrange(1 + len(words) // 4)
        at = r.randrange(lost + 1)
        words = words[at : len(words) - lost + at]
        if words and r.random() < 0.3:
            words[r.randrange(len(words))] = "other"
        got = {i: tuple(m) for i, *m in held.matches(" ".join(words))}
        assert got == brute_whole(" ".join(words), items)
        short += got != brute(" ".join(words), items)
    assert short > 20
    words = " ".join(f"w{i}" for i in range(59))
    assert Benchmark([(1, words)], 5, 0.8, 40).matches(words.rsplit(" ", 2)[0]) == [(1, 53 / 55, 0, 57)]


def test_the_index_prunes():
    rng = np.random.default_rng(0)
    items, some = (rng.integers(0, 256, (n, 16), dtype=np.uint8) for n in (300, 500))
    assert 0.05 < MultiIndex(items, 40).near(some).mean() < 0.11


def test_rows_are_judged_on_their_own(spark):
    long = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, long), (2, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (1, "clean text"), (None, long), (None, None), (2, "x a b c d e f g y")], "doc_id long, text string")
    for part_rows in (20_000, 1):
        assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean_documents(spark, docs, bench, part_rows=part_rows).collect()) == [(0, ""), (1, "clean text")]


def hidden_pair(radius=40):
    """An item and a text that reach 0.8 and whose fingerprints lie farther apart than the radius: two runs of one word cancel out in half of the bits, so the words that differ decide."""
    for turn in range(5000):
        runs = [f"a{turn}"] * 104 + [f"b{turn}"] * 104
        item, text = ([*runs, *(f"{x}{turn}w{j}" for j in range(25))] for x in "xy")
        prints = [decontam.fingerprints(decontam.signs(decontam.shingles(np.array([decontam.word_value(w) for w in words], dtype=np.uint64), 5)).sum(axis=0)[None]) for words in (item, text)]
        if np.bitwise_count(prints[0] ^ prints[1]).sum() > radius:
            return " ".join(item), " ".join(text)
    raise AssertionError("none found")


def test_a_pair_beyond_the_radius_is_found():
    item, text = hidden_pair()
    for given in (text, "before " + text + " after", " ".join(text.split()[:-3])):
        want = brute_whole(given, [(7, item)])
        assert want and {i: tuple(m) for i, *m in Benchmark([(7, item)], 5, 0.8, 40).matches(given)} == want


@pytest.mark.parametrize("radius", [-1, 12])
def test_no_pair_depends_on_the_fingerprints(radius):
    r = random.Random(radius)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary[: r.choice([2, 30])]) for _ in range(r.choice([5, 9, 20, 60])))) for i in range(40)]
    held, found = Benchmark(items, 5, 0.8, radius), 0
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            leak = r.choice(items)[1].split()
            leak[r.randrange(len(leak))] = r.choice(vocabulary)
            words += leak[: r.choice([99, len(leak) - 1])]
        got = {i: tuple(m) for i, *m in held.matches(" ".join(words))}
        assert got == brute_whole(" ".join(words), items)
        found += len(got)
    assert found
