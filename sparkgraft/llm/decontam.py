"""Benchmark decontamination by SimHash windows and exact verification.

Every document is read in windows of each benchmark item's own length in words. A window
gets a 128-bit SimHash of its five-word shingles. A multi-index of four 32-bit blocks finds
all items of that length whose fingerprints lie within the radius: of a pair within 40 bits
some block differs by at most ten. A text shorter than an item is one window as a whole. Candidates are verified by the exact weighted similarity
of shingle multisets (the sum of least counts over the sum of greatest counts).

Windows that cannot reach the threshold are left out first, without loss: such a window holds
at least the share of benchmark shingles that the threshold asks for, which a running count
tells. At similarity 0.8 a pair's fingerprints differ by 19 bits on average with a standard
deviation of 4, so the radius misses about one pair in a million. These are found exactly: where
a window holds so many shingles of one item as the threshold asks for, the pair is verified,
whatever their fingerprints. Hence no pair is lost by chance.

Documents stay where they are: no shuffle. The benchmark is broadcast in parts of at most
`part_rows` items and `part_chars` characters; a larger benchmark takes a pass per part.

Defined results: a row per document and item that share a window at the threshold, with the
best window (the first of equals; n_words is the window's length, less than the item's only if
the text is shorter). Words are lower-cased runs of letters, digits and
underscores. An item of fewer than five words matches only a text that consists of just
these words; items without words, null texts and null item_ids match nothing. Items with equal
words are reported each. Repeated documents are reported each; a null doc_id is kept; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean
from .shingles import mix, shingles

WORD = re.compile(r"\w+")
BITS, BLOCKS = 128, 4
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def word_value(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def signs(found: np.ndarray) -> np.ndarray:
    """A row of 128 signs for each shingle hash."""
    halves = np.stack([mix(found), mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(halves.view(np.uint8).reshape(len(found), BITS // 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(summed: np.ndarray) -> np.ndarray:
    return np.packbits(summed > 0, axis=1)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Least over greatest counts of two multisets of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


class MultiIndex:
    """Fingerprints of the items of one length; `within` finds all pairs at most `radius` bits apart.

    A pair within the radius agrees in one of the blocks of 32 bits but for radius // 4 bits.
    At the radius of 40 that lets 10 % of unrelated pairs through to the whole comparison.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.blocks = prints, radius, self.cut(prints)

    @staticmethod
    def cut(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints).view(np.uint32)

    def near(self, some: np.ndarray) -> np.ndarray:
        """Which of some and which items share a block."""
        found = np.zeros((len(some), len(self.prints)), dtype=bool)
        for mine, theirs in zip(self.cut(some).T, self.blocks.T, strict=True):
            found |= np.bitwise_count(mine[:, None] ^ theirs[None, :]) <= self.radius // BLOCKS
        return found

    def within(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `some` and items, of each pair within the radius."""
        rows, items = np.nonzero(self.near(some))
        good = np.bitwise_count(some[rows] ^ self.prints[items]).sum(axis=1) <= self.radius
        return rows[good], items[good]


class Holders:
    """Which items of one length hold a shingle."""

    def __init__(self, items: list[np.ndarray]):
        own = [np.unique(x) for x in items]
        values, owners = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def enough(self, found: np.ndarray, need: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each item that holds at least `need` of the shingles found, and their places."""
        first, end = np.searchsorted(self.values, found, "left"), np.searchsorted(self.values, found, "right")
        n = end - first
        places = np.repeat(np.arange(len(found)), n)
        owners = self.owners[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(places))]
        order = np.argsort(owners, kind="stable")
        items, starts, counts = np.unique(owners[order], return_index=True, return_counts=True)
        for item, start, count in zip(items.tolist(), starts.tolist(), counts.tolist(), strict=True):
            if count >= need:
                yield item, places[order[start : start + count]]


class Benchmark:
    """One part of the benchmark, ready to be held against texts."""

    def __init__(self, items: list[tuple[int, str]], k: int, threshold: float, radius: int):
        self.k, self.threshold, self.short = k, threshold, defaultdict(list)
        self.vocabulary: dict[str, int] = {}
        values: list[int] = []
        by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        every = []
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if not words or item_id is None:
                continue
            if len(words) < k:
                self.short[tuple(words)].append(item_id)
                continue
            for w in words:
                if w not in self.vocabulary:
                    self.vocabulary[w] = len(values)
                    values.append(word_value(w))
            found = shingles(np.array([word_value(w) for w in words], dtype=np.uint64), k)
            by_length[len(words)].append((item_id, found))
            every.append(found)
        self.values = np.array([*values, 0], dtype=np.uint64)  # the last stands for any other word
        self.known = np.unique(np.concatenate(every)) if every else np.empty(0, dtype=np.uint64)
        self.lengths = {n: (found, MultiIndex(fingerprints(np.array([signs(f).sum(axis=0) for _, f in found])), radius), Holders([f for _, f in found])) for n, found in sorted(by_length.items())}

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window for each item found."""
        words = WORD.findall((text or "").lower())
        out = [(i, 1.0, 0, len(words)) for i in self.short.get(tuple(words), ())] if len(words) < self.k else []
        k, n = self.k, len(words)
        if n < k or not len(self.known):
            return out
        at = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=n)
        inside = at >= 0
        runs = inside[: n - k + 1].copy()
        for i in range(1, k):
            runs &= inside[i : n - k + 1 + i]
        places = np.flatnonzero(runs)
        if not len(places):
            return out
        found = np.zeros(len(places), dtype=np.uint64)
        for i in range(k):  # as shingles() does, at these places only
            found = mix(found * np.uint64(0xFF51AFD7ED558CCD) + self.values[at[places + i]])
        spot = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        hit = np.zeros(n - k + 2, dtype=np.int64)
        hit[places + 1] = self.known[spot] == found
        counts = np.cumsum(hit)
        if not counts[-1]:
            return out
        best: dict[int, tuple[float, int, int]] = {}
        whole = printed = None
        for length, (items, index, holders) in self.lengths.items():
            size = length - k + 1
            if length > n:  # the whole text is the one window: common >= t (size + own) / (1 + t), and common <= own
                own = n - k + 1
                if self.threshold * size > own + 1e-9:
                    break
                need = math.ceil(self.threshold * (size + own) / (1 + self.threshold) - 1e-9)
                if counts[-1] < need:
                    continue
                if whole is None:
                    whole = shingles(np.array([self.values[at[j]] if at[j] >= 0 else word_value(words[j]) for j in range(n)], dtype=np.uint64), k)
                    printed = fingerprints(signs(whole).sum(axis=0)[None])
                for i in sorted({*index.within(printed)[1].tolist(), *(i for i, _ in holders.enough(whole, need))}):
                    item_id, shingled = items[i]
                    similarity = weighted_similarity(whole, shingled)
                    if similarity >= self.threshold and similarity > best.get(item_id, (0.0,))[0]:
                        best[item_id] = (similarity, 0, n)
                continue
            # a window reaches t only with common >= 2 t n / (1 + t) shingles, all of them known ones
            need = math.ceil(2 * self.threshold * size / (1 + self.threshold) - 1e-9)
            starts = np.flatnonzero(counts[size:] - counts[:-size] >= need)
            for start, stop in self.regions(starts, length):
                exact = shingles(np.array([self.values[at[j]] if at[j] >= 0 else word_value(words[j]) for j in range(start, stop)], dtype=np.uint64), k)
                summed = np.vstack([np.zeros((1, BITS), dtype=np.int32), np.cumsum(signs(exact), axis=0, dtype=np.int32)])
                inside = starts[(starts >= start) & (starts <= stop - length)]
                beside = self.holding(exact, inside - start, size, need, holders, len(items))
                for part in np.array_split(inside, -(-len(inside) // 2000)):
                    windows = part - start
                    rows, near = index.within(fingerprints(summed[windows + size] - summed[windows]))
                    held = beside[slice(*np.searchsorted(beside, [windows[0] * len(items), (windows[-1] + 1) * len(items)]))]
                    for code in np.union1d(windows[rows] * len(items) + near, held).tolist():
                        at_word, i = divmod(code, len(items))
                        item_id, shingled = items[i]
                        similarity = weighted_similarity(exact[at_word : at_word + size], shingled)
                        if similarity >= self.threshold and similarity > best.get(item_id, (0.0,))[0]:
                            best[item_id] = (similarity, at_word + start, length)
        return out + [(i, *b) for i, b in sorted(best.items())]

    @staticmethod
    def holding(found: np.ndarray, windows: np.ndarray, size: int, need: int, holders: Holders, n_items: int) -> np.ndarray:
        """window * n_items + item, sorted, of each window (by its first place) that holds `need` shingles of an item."""
        out = [np.empty(0, dtype=np.int64)]
        for item, places in holders.enough(found, need):
            held = np.searchsorted(places, windows + size) - np.searchsorted(places, windows)
            out.append(windows[held >= need] * n_items + item)
        return np.sort(np.concatenate(out))

    @staticmethod
    def regions(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
        """Stretches of words that hold the windows at these starts."""
        out: list[list[int]] = []
        for s in starts.tolist():
            if out and s <= out[-1][1] and out[-1][1] - out[-1][0] < 100_000:
                out[-1][1] = s + length
            else:
                out.append([s, s + length])
        return [(a, b) for a, b in out]


def usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 40, part_rows: int = 20_000, part_chars: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words of each document and item that share a window."""
    items = usable(benchmark)
    found = [part.matching(docs) for part in parted(spark, items, k, threshold, radius, part_rows, part_chars)]
    return reduce(DataFrame.unionByName, found)


def parted(spark: SparkSession, items: DataFrame, k: int, threshold: float, radius: int, part_rows: int, part_chars: int) -> list[Part]:
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["n"] // part_rows), -(-size["chars"] // part_chars))
    return [Part(spark, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part), k, threshold, radius) for part in range(parts)]


class Part:
    """A part of the benchmark of bounded size, broadcast to the tasks that read it."""

    def __init__(self, spark: SparkSession, items: DataFrame, k: int, threshold: float, radius: int):
        self.shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()])
        self.options = (k, threshold, radius)

    def matching(self, docs: DataFrame) -> DataFrame:
        shared, options = self.shared, self.options

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Benchmark(shared.value, *options)
            for b in batches:
                rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in held.matches(t.as_py())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SCHEMA)

    def clean(self, docs: DataFrame) -> DataFrame:
        shared, options, at = self.shared, self.options, docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Benchmark(shared.value, *options)
            for b in batches:
                yield b.filter(pa.array([not held.matches(t.as_py()) for t in b.column(at)], pa.bool_()))

        return docs.mapInArrow(lean(run), docs.schema)


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 40, part_rows: int = 20_000, part_chars: int = 16 << 20) -> DataFrame:
    """The rows whose text shares no window with the benchmark, as they are; each row is judged on its own, whatever its id."""
    for part in parted(spark, usable(benchmark), k, threshold, radius, part_rows, part_chars):
        docs = part.clean(docs)
    return docs
