import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkgraft.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """Every document scored for every item."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // length
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, c in Counter(terms(text)).items() if bag[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank, None if none else d, -score) for rank, (score, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS row", "2 AS ids")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "3 AS row", "4 AS terms")
    return sorted((tuple(r) for r in lexical.search(spark, d, i, **more).collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"cells": 64, "part_terms": 12}, {"part_items": 1}], ids=["whole", "small parts and shards", "item by item"])
def test_against_every_score(spark, more):
    pick = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Ä", "ä", "x-y", "Q1"]
    text = lambda n: " ".join(pick.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(pick.randrange(0, 60))) for i in range(300)] + [(7, text(20)), (None, text(30)), (900, None), (901, ""), (902, "-- !")] + [(i, "w1 w2 w3") for i in range(1000, 1030)]
    items = [(i, text(12)) for i in range(8)] + [(20, None), (21, "nowhere"), (22, "w1 w1 W1 w2"), (23, "--")]
    assert run(spark, docs, items, **more) == plain(docs, items)


def test_repeated_items_and_empty_tables(spark):
    docs = [(2, "a b c"), (1, "a b c"), (3, "z")]
    assert run(spark, docs, [(1, "a"), (1, "a")]) == sorted([(1, r, d, s) for _, r, d, s in plain(docs, [(1, "a")])] * 2, key=str)
    assert run(spark, [], [(1, "a")]) == [] and run(spark, docs, []) == []


def test_long_text_in_chunks():
    raw = ("ab " * 900_000 + "A\u00e9-").encode()
    assert Counter(w for c in lexical.term_chunks(raw) for w in c) == {b"ab": 900_000, "a\u00e9".encode(): 1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 7), st.integers(1, 9), min_size=1), min_size=1, max_size=30), st.lists(st.integers(25, 4000), min_size=30, max_size=30))
def test_bounds_hold_and_every_document_is_in_the_tree(vectors, norms):
    paths = [np.array(sorted(v)) for v in vectors]
    tfs = [np.array([v[t] for t in sorted(v)]) for v in vectors]
    tree = lexical.Tree(paths, tfs, np.array(norms[: len(vectors)]), 8)
    weights = np.array([[(t * 37 + i * 11) % 90 for i in range(3)] for t in range(8)])
    bounds = tree.bounds(weights.astype(np.float32))

    def below(at):
        for c in tree.children[at]:
            if c < 0:
                yield ~c
            else:
                yield from below(c)

    assert sorted(below(0)) == list(range(len(vectors)))
    for at in range(len(tree.children)):
        for leaf in below(at):
            tf = tree.tfs[leaf]
            score = ((10**9 * tf) // (1000 * tf + 8 * tree.norms[leaf])) @ weights[tree.paths[leaf]]
            assert (score <= bounds[at]).all()


def test_the_walk_leaves_most_documents_out():
    """Documents of one rare term and many without it: those without are never scored once ten are found."""
    paths = [np.array([0, 1])] * 30 + [np.array([0, 2])] * 1000
    tree = lexical.Tree(paths, [np.array([1, 1])] * 1030, np.full(1030, 100), 3)
    weights = np.array([[1], [5000], [2]])
    assert lexical.walk(tree, list(range(1030)), weights, weights.astype(np.float32), lexical.Best(1, 10)) < 100
