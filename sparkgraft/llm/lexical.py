"""Ranked lexical search: the best documents for each item of a query set, over document FP-trees.

One pass over the documents counts their terms and keeps, per document, its number of terms and
the term frequencies of those terms that items ask for (its restricted vector). Sums over these
give the statistics of the whole corpus, and so each term's weight. A second pass reads the
vectors: a task takes bounded shards of documents, orders each vector by falling document
frequency and sorts them, so that vectors with a common beginning share a path of the shard's
trie. Branching nodes hold the greatest frequency of each term and the least length norm m below
them, which bound the score of everything below. The trie is walked depth first with the items
that may still gain from it: an item leaves where the bound falls below its tenth score so far,
which a task keeps from shard to shard. Documents that are reached are scored exactly, in whole
numbers. Each task's best ten per item are merged by a window.

Items come in parts of at most `part_terms` distinct terms (or of one item) and `part_items`
items; a part is broadcast, and more parts mean more passes. Vectors are written, not texts. A
shard holds at most `cells` (documents by terms); nothing else grows with the corpus.

Terms are runs of ASCII letters and digits and of anything beyond ASCII; A-Z are lower-cased.

Defined results: null texts and those without terms take no part and aren't counted in N; an
item that is null or without terms, or whose terms stand nowhere, has no rows; equal scores are
ordered by ascending doc_id (null last); documents that repeat a doc_id are ranked each; items
that repeat an item_id are ranked each on its own, so such an id has every rank once for each of
its rows; whole texts are read, very long ones in chunks; terms in every document may weigh
nothing; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean

CHUNK = 1 << 20
#: Letters and digits stay (A-Z lower-cased), as do bytes beyond ASCII; the rest parts terms.
KEEP = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def term_chunks(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size (longer only for a longer term)."""
    plain, at = (raw or b"").translate(KEEP), 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def restricted(documents: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), ids and tfs (of those asked for, by their place in terms) of each document with terms."""
    place = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        for b in batches:
            docs, sizes, ids, tfs = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                n, counts = 0, Counter()
                for words in term_chunks(text.as_py()):
                    n += len(words)
                    counts.update(filter(known.__contains__, words))
                if n:
                    docs.append(doc)
                    sizes.append(n)
                    ids.append([known[t] for t in counts])
                    tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n long, ids array<int>, tfs array<long>")


class Tree:
    """The FP-tree of a shard. Paths without branches are one step, so only branching nodes and documents are kept."""

    def __init__(self, paths: list[np.ndarray], tfs: list[np.ndarray], norms: np.ndarray, width: int):
        keys = [p.astype(">u4").tobytes() for p in paths]
        order = sorted(range(len(paths)), key=keys.__getitem__)
        self.order, self.norms = order, norms[order]
        self.paths, self.tfs = [paths[i] for i in order], [tfs[i] for i in order]
        shared = np.array([self.common(a, b) for a, b in zip(self.paths, self.paths[1:], strict=False)], dtype=np.int64)
        #: children of each branching node (below 0: the document ~x), parents before children
        self.children: list[list[int]] = []
        todo = [(0, len(order), -1, 0)]
        while todo:
            low, high, parent, slot = todo.pop()
            at = len(self.children)
            if parent >= 0:
                self.children[parent][slot] = at
            between = shared[low : high - 1]
            cuts = [low, *(low + 1 + np.flatnonzero(between == between.min())).tolist(), high] if high - low > 1 else [low, high]
            self.children.append([~a for a in cuts[:-1]])
            todo += [(a, b, at, i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b - a > 1]
        # greatest frequencies and least norms, from the leaves up
        self.most = np.zeros((len(self.children), width), dtype=np.float32)
        self.least = np.full(len(self.children), np.iinfo(np.int64).max)
        for at in range(len(self.children) - 1, -1, -1):
            row = self.most[at]
            for child in self.children[at]:
                if child < 0:
                    path = self.paths[~child]
                    row[path] = np.maximum(row[path], self.tfs[~child])
                    self.least[at] = min(self.least[at], self.norms[~child])
                else:
                    np.maximum(row, self.most[child], out=row)
                    self.least[at] = min(self.least[at], self.least[child])

    @staticmethod
    def common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return int(other[0]) if len(other) else n

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """What no document below a node exceeds, by node and item. weights: by term and item, in single precision, as are the products: hence the margin."""
        gains = 1e9 * self.most / np.maximum(1000.0 * self.most + 8.0 * self.least[:, None].astype(np.float32), 1.0)
        return (gains.astype(np.float32) @ weights).astype(np.float64) * (1 + 1e-4) + 1


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.needs = k, [[] for _ in range(items)], np.ones(items, dtype=np.int64)

    def offer(self, item: int, score: int, doc: int | None) -> None:
        heap, entry = self.heaps[item], (score, -(2**63 if doc is None else doc))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.needs[item] = heap[0][0]


def walk(tree: Tree, docs: list[int | None], weights: np.ndarray, rough: np.ndarray, best: Best) -> int:
    """Depth first through a shard's tree, each node with the items that it may still serve; the number of documents scored."""
    bounds, scored = tree.bounds(rough), 0
    stack = [(0, np.arange(weights.shape[1]))]
    while stack:
        at, live = stack.pop()
        live = live[bounds[at, live] >= best.needs[live]]
        if not len(live):
            continue
        inner = []
        for child in tree.children[at]:
            if child >= 0:
                inner.append(child)
                continue
            path, tf = tree.paths[~child], tree.tfs[~child]
            scored += 1
            gains = (1_000_000_000 * tf) // (1000 * tf + 8 * tree.norms[~child])
            scores = gains @ weights[path][:, live]
            for i in np.flatnonzero(scores >= best.needs[live]).tolist():
                best.offer(int(live[i]), int(scores[i]), docs[tree.order[~child]])
        inner.sort(key=lambda c: float(bounds[c, live].max()))  # the most promising is taken next
        stack += [(c, live) for c in inner]
    return scored


def search(spark: SparkSession, documents: DataFrame, items: DataFrame, k: int = 10, part_terms: int = 8192, part_items: int = 1024, cells: int = 1 << 22) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents. documents: doc_id, text; items: item_id, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [Counter(w for words in term_chunks(t.as_py()) for w in words) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(x) for x in bags], pa.list_(pa.binary())), pa.array([list(x.values()) for x in bags], pa.list_(pa.int64()))], ["row", "item_id", "terms", "counts"])

    scratch = Scratch(spark, "lexical")
    numbered = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text")
    asked = scratch.cut(numbered.mapInArrow(cut, "row long, item_id long, terms array<binary>, counts array<long>").where("size(terms) > 0"), "items")
    found, part, terms, number = [], [], set(), 0
    for r in asked.toLocalIterator():  # an item at a time; a part is bounded
        own = {bytes(t) for t in r["terms"]}
        if part and (len(terms | own) > part_terms or len(part) >= part_items):
            found.append(search_part(documents, scratch, f"part{number}", part, sorted(terms), k, cells))
            part, terms, number = [], set(), number + 1
        part.append((r["row"], r["item_id"], {bytes(t): c for t, c in zip(r["terms"], r["counts"], strict=True)}))
        terms |= own
    found.append(search_part(documents, scratch, f"part{number}", part, sorted(terms), k, cells))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_part(documents: DataFrame, scratch: Scratch, name: str, items: list[tuple[int, int | None, dict[bytes, int]]], terms: list[bytes], k: int, cells: int) -> DataFrame:
    """row, item_id, doc_id, score: the best documents of each task for a part of the items."""
    spark = documents.sparkSession
    vectors = scratch.cut(restricted(documents, terms), f"{name}-vectors")
    total, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), dtype=np.int64)
    for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # at most a row for each term
        df[r["id"]] = r["count"]
    weight = [math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) if x else 0 for x in df]
    # terms by falling document frequency; those that weigh nothing, or stand nowhere, are left out
    ranked = sorted((i for i in range(len(terms)) if weight[i] > 0), key=lambda i: (-df[i], i))
    place = np.full(len(terms), -1, dtype=np.int64)
    place[ranked] = np.arange(len(ranked))
    at = {t: int(place[i]) for i, t in enumerate(terms)}
    pairs = [(at[t], i, weight[ranked[at[t]]] * c) for i, (_, _, bag) in enumerate(items) for t, c in bag.items() if at[t] >= 0]
    shared = spark.sparkContext.broadcast((place, pairs, [(row, item) for row, item, _ in items]))
    width = len(ranked)
    most = max(64, cells // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pairs, names = shared.value
        weights = np.zeros((width, len(names)), dtype=np.int64)
        for term, item, w in pairs:
            weights[term, item] = w
        rough, best = weights.astype(np.float32), Best(len(names), k)
        docs, paths, tfs, norms = [], [], [], []

        def flush() -> None:
            if docs:
                walk(Tree(paths, tfs, np.array(norms, dtype=np.int64), width), docs, weights, rough, best)
                for held in (docs, paths, tfs, norms):
                    held.clear()

        for b in batches:
            ids, counts = b.column(2), b.column(3)
            starts, values, frequencies = ids.offsets.to_numpy(), place[ids.values.to_numpy()], counts.values.to_numpy()
            for i, (doc, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                path, tf = values[starts[i] : starts[i + 1]], frequencies[starts[i] : starts[i + 1]]
                kept = np.flatnonzero(path >= 0)
                if len(kept):
                    kept = kept[np.argsort(path[kept])]
                    docs.append(doc)
                    paths.append(path[kept])
                    tfs.append(tf[kept])
                    norms.append(25 + 75 * n * total // length)
                    if len(docs) >= most:
                        flush()
        flush()
        rows = [(*names[i], None if -doc == 2**63 else -doc, score) for i, heap in enumerate(best.heaps) for score, doc in heap]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "item_id", "doc_id", "score"])

    return vectors.where("size(ids) > 0").mapInArrow(lean(run), "row long, item_id long, doc_id long, score long")
