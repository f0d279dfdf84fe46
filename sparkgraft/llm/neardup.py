"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets form a class, whose smallest doc_id stands for it. Bands of the
representatives' MinHash signatures give buckets. Candidates' signatures (a byte of each hash)
are compared in batches: after each, the posterior chance that the similarity reaches the
threshold, given the matches so far (uniform prior), decides whether to go on; below the chosen
miss probability the pair is dropped. Survivors are verified on their full sets.

Pairs of a bucket are compared where the bucket lies and never emitted as such. A first round
emits the maximum spanning forest of each bucket by agreement, at most one pair per row; the
distinct pairs are verified and merged. Buckets that still hold several components go through
two more steps: one keeps the rows that have a surviving partner in another component (a pair
counts in its first shared band only), the next brings their sets together and verifies pairs
from the most alike on, leaving out those that verified links already connect. So every
surviving pair across components is verified or implied, and emitted rows stay linear.

A bucket of more than `most_rows` rows (or `most_shingles` shingles) is not searched in one
task: its nodes get a further family of longer bands, and their buckets are searched in its
place; what is too large in the last family is dealt out as pairs of blocks, which covers all
its pairs. So far a pair at the threshold is missed with a chance of at most 1e-6 in each family
of bands and 1e-6 in the Bayesian bound.

An exact search between the components found closes that gap. Two sets that reach the threshold
share one of their rarest shingles, so many of each as may be missing from the other. Rows of
different components meet by these; a pair is dropped only if the places of the shingle, or the
parities of both sets' shingles over buckets in proportion to the sets, show that the sets differ
too much: over fewer buckets, unrelated sets would seem alike, and pairs grow with the square of the
long texts. Parities over finer buckets thin out the distinct pairs that are left, which are
verified on the full sets. Which shingles are frequent is learned from a sample of `sample` rows: it orders the shingles, which
saves work, and any order gives the same links. Hence no link is lost by chance.

Nothing is collected but counts and the sample's most frequent shingles (MOST_FREQUENT). Ids are broadcast only while they are few; joins on hot keys
are plain equi-joins that adaptive execution can split. Intermediate tables are written to
the shared folder, and dropped once they are used up.

Defined results: null or empty texts and texts without words have no shingles and link with
nothing; a doc_id that stands on several rows is one vertex, linked by any of its texts, and
its rows are returned as often; a null doc_id links with nothing, has a null component and is
kept; an empty table gives no rows; extra columns are ignored. Ties need no rule: components
don't depend on order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean
from .shingles import many_words, mix, shingles

HASHES, BATCH = 180, 30
BITS, MOST_BITS = 1024, 8192
MOST_FREQUENT = 100_000
SKETCH = "doc_id long, n_shingles long, key binary, bands array<long>, signature binary, rarest array<long>, parities binary, wide binary"


@lru_cache(maxsize=8)
def family(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks of n hash functions, from fixed counters; those of a level of its own for each n."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n - HASHES))
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low[:n] | np.uint32(1), low[n:]


def signature(found: np.ndarray, n: int = HASHES) -> np.ndarray:
    """The least value of each of n hash functions over a set."""
    odd, mask = family(n)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    step = max(16, 180 * 1024 // n)
    for at in range(0, len(short), step):
        block = (short[at : at + step, None] ^ mask) * odd
        np.minimum(out, block.min(axis=0), out=out)
    return out


def bands(threshold: Fraction, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows a band at which a pair at the threshold is missed with at most this chance."""
    fits = [(HASHES // r, r) for r in range(1, 20) if (1 - float(threshold) ** r) ** (HASHES // r) <= miss]
    return fits[-1]


@lru_cache(maxsize=8)
def least_matches(threshold: Fraction, miss: float = 1e-6) -> dict[int, int]:
    """By hashes compared: the least matches at which P(similarity >= threshold | matches) is still miss or more.

    With a uniform prior the posterior is a beta distribution, whose upper tail at t after m of
    n matches is the chance of at most m successes in n + 1 trials of chance t.
    """
    t, out = float(threshold), {}
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def longer(threshold: Fraction, rows: int, miss: float = 1e-6) -> int:
    """How many bands of so many rows miss a pair at the threshold with at most this chance."""
    return ceil(log(miss) / log(1 - float(threshold) ** rows))


def band_keys(table: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A bucket for each band of each signature."""
    weight = mix(np.arange(1, rows + 1, dtype=np.uint64) + np.uint64(64 * rows))
    cut = table[:, : n_bands * rows].reshape(-1, n_bands, rows)
    return mix(mix((cut.astype(np.uint64) + np.uint64(1)) * weight).sum(axis=2, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64)).view(np.int64)


def agreeing(i: np.ndarray, j: np.ndarray, table: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of rows survive the comparison, batch by batch, and their matches."""
    left, matches = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
    for n in sorted(least):
        part = slice(n - BATCH, n)
        matches = matches + (table[i[left], part] == table[j[left], part]).sum(axis=1)
        good = matches >= least[n]
        left, matches = left[good], matches[good]
        if not len(left):
            break
    return left, matches


def reaches(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * threshold.denominator >= threshold.numerator * (len(a) + len(b) - common)


def rarest(found: np.ndarray, threshold: Fraction, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """So many of a sorted set's shingles that another set without any of them misses the threshold: the rarest, by rank and value."""
    rank = np.zeros(len(found), dtype=np.uint8)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, ranks[at], rank)
    n = len(found) + 1 - ceil(len(found) * threshold)
    return found[np.argsort(rank, kind="stable")[:n]]


def parities(found: np.ndarray, bits: int = BITS) -> bytes:
    """Whether each of so many buckets (a power of two) holds an odd number of a set's shingles: two sets differ in at least as many shingles as buckets."""
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).tobytes()


def coarse(n: int) -> int:
    """The least buckets that tell unrelated sets of n shingles apart, as unrelated parities differ in half of them: half of n and more, within bounds."""
    return min(MOST_BITS, max(BITS, 1 << max(0, (n - 1).bit_length() - 1)))


def wide(n: int) -> int:
    """The buckets that suit a set of n shingles."""
    return max(BITS, 1 << (4 * n).bit_length())


def parity_table(column: pa.Array, lengths: np.ndarray, size: int) -> np.ndarray:
    """A row of 64-bit words for each of the parities, folded to so many bytes; zeros for coarser ones."""
    out = np.zeros((len(column), size // 8), dtype=np.uint64)
    for n in np.unique(lengths[lengths >= size]).tolist():
        rows = np.flatnonzero(lengths == n)
        data = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), dtype=np.uint64)
        out[rows] = np.bitwise_xor.reduce(data.reshape(len(rows), n // size, size // 8), axis=1)
    return out


def parted(a: bytes, b: bytes) -> int:
    """The buckets in which parities differ; the finer ones are folded to the coarser."""
    a, b = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum(dtype=np.int64))


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.reshape(-1)))


def sketch(docs: DataFrame, k: int, n_bands: int, rows: int, threshold: Fraction, frequent: Broadcast) -> DataFrame:
    """doc_id, n_shingles, key (digest of the whole set), bands, signature (a byte of each hash), rarest shingles and parities (over coarse buckets, and over finer ones where these are more) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys, table, rare, odd, fine = [], [], [], [], [], []
            for words in many_words(t.as_py() for t in b.column(1).cast(pa.binary())):
                found = np.unique(shingles(words, k))
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                if len(found):
                    table.append(signature(found))
                rare.append(rarest(found, threshold, *frequent.value) if len(found) else found)
                n = len(found)
                odd.append(parities(found, coarse(n)) if n else None)
                fine.append(parities(found, wide(n)) if n and wide(n) > coarse(n) else None)
            some = np.array(sizes, dtype=np.int64) > 0
            table = np.array(table, dtype=np.uint32).reshape(-1, HASHES)
            signatures = iter((table & np.uint32(255)).astype(np.uint8))
            bands_of = list_column(band_keys(table, n_bands, rows), some * n_bands)
            rare_of = list_column(np.concatenate([np.empty(0, np.uint64), *rare]).view(np.int64), np.array([len(x) for x in rare], dtype=np.int64))
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), bands_of, pa.array([next(signatures).tobytes() if x else None for x in some], pa.binary()), rare_of, pa.array(odd, pa.binary()), pa.array(fine, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key", "bands", "signature", "rarest", "parities", "wide"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SKETCH)


def frequent_shingles(spark: SparkSession, docs: DataFrame, k: int, sample: int) -> Broadcast:
    """The most frequent shingles of a sample of rows, sorted, and a rank for each, higher for the more frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingles(words, k)) for words in many_words(t.as_py() for t in b.column(0).cast(pa.binary()))]
            values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            again = counts > 1  # what a batch holds once is hardly frequent
            yield pa.RecordBatch.from_arrays([pa.array(values[again].view(np.int64)), pa.array(counts[again].astype(np.int64))], ["shingle", "n"])

    rows = docs.select("text").sample(min(1.0, sample / max(1, docs.count())), seed=1)
    counted = rows.mapInArrow(lean(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2")
    top = counted.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toArrow()
    values, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(values)
    return spark.sparkContext.broadcast((values[order], (1 + np.log2(n[order])).astype(np.uint8)))


def whole_groups(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that are sorted by their first column, cut so that none of its values stands in two, of at most so many rows or one value; and where each value starts, with the end."""

    def cut(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        by = b.column(0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.flatnonzero(by[1:] != by[:-1]) + 1, [len(by)]])
        at = 0
        while at < len(bounds) - 1:
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
            yield b.slice(bounds[at], bounds[stop] - bounds[at]), bounds[at : stop + 1] - bounds[at]
            at = stop

    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if kept is None else pa.concat_batches([kept, b])
        by = b.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(by, by[-1]))
        if last:
            yield from cut(b.slice(0, last))
        kept = b.slice(last)
    if kept is not None:
        yield from cut(kept)


def byte_table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), HASHES)


def candidates(bounds: np.ndarray, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each group: small groups of one size together, large ones a few rows at a time."""
    sizes, starts = np.diff(bounds), bounds[:-1]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        step = max(1, 40_000 // len(i))
        for x in range(0, len(at), step):
            yield (at[x : x + step] + i).ravel(), (at[x : x + step] + j).ravel()
    for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        step = max(1, 40_000 // size)
        for x in range(0, size - 1, step):
            i, j = np.indices((min(step, size - 1 - x), size))
            i += x
            ahead = j > i
            yield start + i[ahead], start + j[ahead]


def surviving(b: pa.RecordBatch, bounds: np.ndarray, threshold: Fraction, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group with different labels whose sizes and signatures allow the threshold, and their matches, most alike first.

    Columns: bucket, node, label, n_shingles, signature, bands. once: only in the first band that the two share.
    """
    least = least_matches(threshold)
    label, size, table = b.column(2).to_numpy(), b.column(3).to_numpy(), byte_table(b.column(4))
    bands_of = b.column(5).flatten().to_numpy().reshape(b.num_rows, -1) if once else None
    bucket = b.column(0).to_numpy()
    found = [(np.empty(0, np.int64),) * 3]
    for i, j in candidates(bounds):
        fits = (label[i] != label[j]) & (np.minimum(size[i], size[j]) * threshold.denominator >= np.maximum(size[i], size[j]) * threshold.numerator)
        i, j = i[fits], j[fits]
        left, matches = agreeing(i, j, table, least)
        i, j = i[left], j[left]
        if once and bands_of.shape[1] and len(i):
            same = bands_of[i] == bands_of[j]
            first = bands_of[i, same.argmax(axis=1)] == bucket[i]
            i, j, matches = i[first], j[first], matches[first]
        found.append((i, j, matches))
    i, j, matches = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(-matches, kind="stable")
    return i[order], j[order], matches[order]


class Joined:
    """Which labels are joined so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while x in self.above:
            up = self.above[x]
            if up in self.above:
                self.above[x] = self.above[up]
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        if x != y:
            self.above[max(x, y)] = min(x, y)


def forest(threshold: Fraction):
    """a, b for each edge of the maximum spanning forest of each group's surviving pairs. Columns as for surviving()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in whole_groups(batches):
            i, j, _ = surviving(b, bounds, threshold, once=False)
            joined, keep = Joined(), []
            for at, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):  # rows, not labels: a node is in several groups
                x, y = joined.root(x), joined.root(y)
                if x != y:
                    joined.join(x, y)
                    keep.append(at)
            node = b.column(1).to_numpy()
            first, second = node[i[keep]], node[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, second)), pa.array(np.maximum(first, second))], ["a", "b"])

    return run


def open_rows(threshold: Fraction):
    """The rows that have a surviving partner with another label, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in whole_groups(batches):
            i, j, _ = surviving(b, bounds, threshold, once=True)
            yield b.take(pa.array(np.union1d(i, j)))

    return run


def exact_links(threshold: Fraction):
    """a, b for verified links that connect different labels, a spanning forest of them per batch. Columns as for surviving(), and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in whole_groups(batches):
            i, j, _ = surviving(b, bounds, threshold, once=True)
            node, label, sets = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(6)
            joined, found = Joined(), []
            for x, y, p, q in zip(i.tolist(), j.tolist(), label[i].tolist(), label[j].tolist(), strict=True):
                p, q = joined.root(p), joined.root(q)
                if p != q and reaches(np.frombuffer(sets[x].as_buffer(), np.uint64), np.frombuffer(sets[y].as_buffer(), np.uint64), threshold):
                    joined.join(p, q)
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def meeting(threshold: Fraction, most_rows: int):
    """The rows that may reach the threshold with a row of the same shingle and another label, if that is the first of the rarest that both have; all rows of more than most_rows, with the parts they are to be dealt to.

    Columns: shingle, node, label, n_shingles, place (of the shingle among the rarest).
    """
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in whole_groups(batches, 1 << 16):
            label, sizes = b.column(2).to_numpy(), np.diff(bounds)
            held = np.minimum.reduceat(label, bounds[:-1]) < np.maximum.reduceat(label, bounds[:-1])
            large = held & (sizes > most_rows)
            parts = np.repeat(np.where(large, -(-2 * sizes // most_rows), 0), sizes).astype(np.int32)
            rows = np.flatnonzero(np.repeat(held & ~large, sizes))
            label, size, place = (b.column(c).to_numpy()[rows] for c in (2, 3, 4))
            for i, j in candidates(np.concatenate([[0], np.cumsum(sizes[held & ~large])])):
                fits = (label[i] != label[j]) & (np.minimum(size[i] - place[i], size[j] - place[j]) >= -(-num * (size[i] + size[j]) // (num + den)))
                parts[rows[i[fits]]] = parts[rows[j[fits]]] = 1
            kept = np.flatnonzero(parts)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(kept)).columns, pa.array(parts[kept])], [*b.schema.names, "parts"])

    return run


def near_rows(b: pa.RecordBatch, bounds: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group with different labels that may reach the threshold, if the group's shingle is the first of the rarest that both have.

    Columns: bucket, node, label, n_shingles, parities, place (of the shingle among the rarest).
    """
    num, den = threshold.numerator, threshold.denominator
    label, size, place = (b.column(c).to_numpy() for c in (2, 3, 5))
    left = size - place
    lengths = pc.binary_length(b.column(4)).to_numpy()
    tables = {n: parity_table(b.column(4), lengths, n) for n in np.unique([BITS // 8, *lengths.tolist()]).tolist()}
    found = [(np.empty(0, np.int64),) * 2]
    for i, j in candidates(bounds):
        need = -(-num * (size[i] + size[j]) // (num + den))
        fits = (label[i] != label[j]) & (np.minimum(left[i], left[j]) >= need)
        i, j, most = i[fits], j[fits], (size[i] + size[j] - 2 * need)[fits]
        for n, table in tables.items():  # from the coarsest on, as far as both have them
            fits = np.minimum(lengths[i], lengths[j]) < n
            fits |= np.bitwise_count(table[i] ^ table[j]).sum(axis=1, dtype=np.int64) <= most
            i, j, most = i[fits], j[fits], most[fits]
        found.append((i, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j


def near_pairs(threshold: Fraction):
    """a, b of the pairs of near_rows(), each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in whole_groups(batches):
            i, j = near_rows(b, bounds, threshold)
            node = b.column(1).to_numpy()
            pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def near_enough(threshold: Fraction):
    """a, b of the pairs whose parities allow the threshold. Columns: a, b, na, nb (the sizes), wa, wb (the parities)."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = pc.add(b.column(2), b.column(3)).to_pylist()
            keep = [parted(x, y) <= n - 2 * -(-num * n // (num + den)) for n, x, y in zip(both, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def contract(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label (the least node reachable) for every node of the edges a, b.

    Each node hooks on to its least neighbour and follows the hooks to a root; the edges left
    between different roots are contracted in the same way, until none is left. A root's edges
    are looked at once a round, so a large star costs one round.
    """
    total, i = None, 0
    while True:
        both = edges.union(edges.select("b", "a"))
        hooks = scratch.cut(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")), f"{name}-{i}-hooks")
        for j in range(64):
            over = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            after = scratch.cut(hooks.join(over, "label").select("node", F.col("root").alias("label"), (F.col("root") < F.col("label")).alias("moved")), f"{name}-{i}-{j}")
            hooks = after.select("node", "label")
            if not after.where("moved").limit(1).count():
                break
        if total is None:
            total = hooks
        else:
            total = total.join(hooks.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        edges = scratch.cut(relabel(edges, hooks), f"{name}-{i}-edges")
        if not edges.limit(1).count():
            return scratch.cut(total, name)
        i += 1


def relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between different labels, each once."""
    from_a = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").select(F.coalesce("la", "a").alias("a"), "b")
    from_b = from_a.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left").select("a", F.coalesce("lb", "b").alias("b"))
    return from_b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merge(labels: DataFrame | None, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels after new edges: only the edges between components are looked at."""
    if labels is None:
        return contract(edges, scratch, name)
    between = scratch.cut(relabel(edges, labels), f"{name}-between")
    roots = contract(between, scratch, f"{name}-roots")
    moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return scratch.cut(moved.union(roots.join(labels, "node", "left_anti").select("node", "label")), name)


class Search:
    """One run over one table: what the rounds share."""

    def __init__(self, spark: SparkSession, docs: DataFrame, k: int, threshold: Fraction, few_ids: int, most_rows: int, most_shingles: int, sample: int):
        self.spark, self.k, self.threshold, self.few_ids, self.most_rows, self.most_shingles = spark, k, threshold, few_ids, most_rows, most_shingles
        self.scratch = Scratch(spark, "neardup")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
        self.n_bands, self.n_rows = bands(threshold)
        frequent = frequent_shingles(spark, docs, k, sample)
        self.rows = self.scratch.cut(sketch(docs, k, self.n_bands, self.n_rows, threshold, frequent), "rows")
        self.usable = self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = self.usable.groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "bands", "rarest", "parities", "wide")))
        self.nodes = self.scratch.cut(classes, "nodes")

    def shared(self, nodes: DataFrame, name: str) -> DataFrame:
        """bucket, node, n_shingles of the buckets that hold several nodes."""
        every = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
        several = every.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
        return self.scratch.cut(every.join(several, "bucket", "left_semi").select("bucket", "node", "n_shingles"), name)

    def gathered(self, rows: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
        """Rows with their nodes' signatures and bands, those of one bucket together."""
        full = rows.join(nodes.select("node", "n_shingles", "signature", "bands"), "node")
        return full.select("bucket", "node", "label", "n_shingles", "signature", "bands", *by).repartition("bucket").sortWithinPartitions("bucket")

    def shingle_sets(self, table: DataFrame, name: str) -> DataFrame:
        """node, shingles (sorted 64-bit hashes) of the nodes of a table, one row for each set."""
        ids, k = table.select("node").distinct(), self.k
        if ids.limit(self.few_ids + 1).count() <= self.few_ids:
            ids = F.broadcast(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [np.unique(shingles(words, k)).tobytes() for words in many_words(t.as_py() for t in b.column(1).cast(pa.binary()))]
                keys = [hashlib.blake2b(x, digest_size=16).digest() for x in found]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["node", "key", "shingles"])

        sets = self.docs.join(ids, "node", "left_semi").mapInArrow(lean(run), "node long, key binary, shingles binary")
        return self.scratch.cut(sets.groupBy("node", "key").agg(F.first("shingles").alias("shingles")).select("node", "shingles"), name)

    def verified(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs a, b whose full sets reach the threshold."""
        threshold = self.threshold
        with_a = pairs.join(sets.toDF("a", "sa"), "a")
        with_both = with_a.join(sets.toDF("b", "sb"), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(b.column(2), b.column(3), strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return self.scratch.cut(with_both.select("a", "b", "sa", "sb").mapInArrow(lean(check), "a long, b long").distinct(), name)

    def alike(self, table: DataFrame, sets: DataFrame) -> DataFrame:
        """Labels after the verified edges of each bucket's maximum spanning forest; a large bucket is taken in random parts, as this round needn't see all pairs."""
        parts = table.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(self.most_rows // 2)).alias("parts")).where("parts > 1")
        dealt = table.join(parts, "bucket", "left").select(
            F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.col("parts")))).alias("bucket"), "node", F.col("node").alias("label")
        )
        pairs = self.gathered(dealt, self.nodes, []).mapInArrow(lean(forest(self.threshold)), "a long, b long").distinct()
        return contract(self.verified(self.scratch.cut(pairs, "forest"), sets, "alike"), self.scratch, "labels-alike")

    def across(self, table: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, level: int) -> DataFrame:
        """Labels after every surviving pair across components within the buckets of this family of bands."""
        name, last = f"level{level}", level > 3
        rows = table.join(labels, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("label", "node").alias("label"))
        held = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("size")).where("low < high")
        large = (F.col("n") > self.most_rows) | (F.col("size") > self.most_shingles)
        parts = F.ceil(F.greatest(2 * F.col("n") / self.most_rows, 2 * F.col("size") / self.most_shingles)).cast("int")
        rows = self.scratch.cut(rows.join(held.select("bucket", F.when(large, parts).otherwise(1).alias("parts")), "bucket").select("bucket", "node", "label", "parts"), f"{name}-rows")
        small, hot = rows.where("parts = 1"), rows.where("parts > 1")
        any_hot = hot.limit(1).count() > 0
        if last and any_hot:  # pairs of blocks: each row goes to every block once
            other = hot.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            blocks = other.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "node", "label", "parts")
            nodes = nodes.withColumn("bands", F.array().cast("array<long>"))
            small = small.unionByName(blocks)
        opened = self.gathered(small, nodes, []).mapInArrow(lean(open_rows(self.threshold)), "bucket long, node long, label long, n_shingles long, signature binary, bands array<long>")
        opened = self.scratch.cut(opened, f"{name}-open")
        full = opened.join(sets, "node").select("bucket", "node", "label", "n_shingles", "signature", "bands", "shingles").repartition("bucket").sortWithinPartitions("bucket")
        links = self.scratch.cut(full.mapInArrow(lean(exact_links(self.threshold)), "a long, b long").distinct(), f"{name}-links")
        labels = merge(labels, links, self.scratch, f"labels-{name}")
        if any_hot and not last:
            finer = self.finer(hot.select("node").distinct(), sets, level + 1)
            labels = self.across(self.shared(finer, f"level{level + 1}-buckets"), finer, sets, labels, level + 1)
        return labels

    def finer(self, ids: DataFrame, sets: DataFrame, level: int) -> DataFrame:
        """The given nodes with the bands of a family that is `level` times as long."""
        rows = self.n_rows * level
        n_bands = longer(self.threshold, rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    table = np.array([signature(np.frombuffer(x.as_buffer(), np.uint64), n_bands * rows) for x in part.column(2)])
                    keys = list_column(band_keys(table, n_bands, rows), np.full(len(table), n_bands))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), keys], ["node", "n_shingles", "signature", "bands"])

        given = self.nodes.select("node", "n_shingles", "signature").join(ids, "node", "left_semi").join(sets, "node").where(F.length("shingles") == 8 * F.col("n_shingles"))
        return self.scratch.cut(given.select("node", "n_shingles", "shingles", "signature").mapInArrow(lean(run), "node long, n_shingles long, signature binary, bands array<long>"), f"level{level}-nodes")

    def same_doc(self, labels: DataFrame) -> DataFrame:
        """Labels after edges between the texts of one doc_id."""
        several = self.usable.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("doc_id")
        if not several.limit(1).count():
            return labels
        texts = self.scratch.cut(self.usable.select("doc_id", "key").join(several, "doc_id").join(self.nodes.select("key", "node"), "key").select("doc_id", "node").distinct(), "texts")
        edges = texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct()
        return merge(labels, edges, self.scratch, "labels-doc")

    def between(self, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels after every link between components, found by the rarest shingles, whatever the bands have missed."""
        every = self.nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "n_shingles", F.posexplode("rarest").alias("place", "shingle"))
        every = every.select("shingle", "node", "label", "n_shingles", "place").repartition("shingle").sortWithinPartitions("shingle")
        met = every.mapInArrow(lean(meeting(self.threshold, self.most_rows)), "shingle long, node long, label long, n_shingles long, place int, parts int")
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        dealt = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = self.scratch.cut(dealt.select(F.xxhash64("shingle", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), "node", "label", "n_shingles", "place"), "between-rows")
        full = rows.join(self.nodes.select("node", "n_shingles", "parities"), ["node", "n_shingles"]).select("bucket", "node", "label", "n_shingles", "parities", "place").repartition("bucket").sortWithinPartitions("bucket")
        pairs = self.scratch.cut(full.mapInArrow(lean(near_pairs(self.threshold)), "a long, b long").distinct(), "between-pairs")
        of = self.nodes.select("node", "n_shingles", F.coalesce("wide", "parities").alias("wide"))
        near = pairs.join(of.toDF("a", "na", "wa"), "a").join(of.toDF("b", "nb", "wb"), "b").select("a", "b", "na", "nb", "wa", "wb")
        near = self.scratch.cut(near.mapInArrow(lean(near_enough(self.threshold)), "a long, b long").distinct(), "between-near")
        if not near.limit(1).count():
            return labels
        ids = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        more = self.scratch.cut(ids.join(sets.select("node"), "node", "left_anti"), "between-nodes")
        if ids.limit(self.few_ids + 1).count() <= self.few_ids:  # few sets are asked for: the others needn't move
            sets = sets.join(F.broadcast(ids), "node", "left_semi")
        if more.limit(1).count():
            sets = sets.union(self.shingle_sets(more, "between-sets"))
        return merge(labels, self.verified(near, sets, "between-links"), self.scratch, "labels-between")

    def whole_docs(self, result: DataFrame) -> DataFrame:
        """The result with the component of a doc_id on its rows without shingles too."""
        blank = self.rows.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
        mixed = self.scratch.cut(blank.join(self.usable.select("doc_id"), "doc_id", "left_semi"), "mixed")
        if not mixed.limit(1).count():
            return result
        held = result.where("n_shingles > 0").join(mixed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("held"))
        return result.join(held, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("held", "component_id").alias("component_id"))

    def run(self) -> DataFrame:
        table = self.shared(self.nodes, "buckets")
        sets = self.shingle_sets(table, "sets")
        labels = self.across(table, self.nodes, sets, self.same_doc(self.alike(table, sets)), 1)
        labels = self.between(sets, labels)
        joined = self.nodes.select("key", "node", "copies").join(labels, "node", "left").where("copies > 1 OR label < node")
        known = self.scratch.cut(joined.select("key", F.coalesce("label", "node").alias("label")), "known")
        for name in ("nodes", "buckets", "sets", "between-rows", "between-pairs", "between-sets"):
            self.scratch.drop(name)
        if known.limit(self.few_ids + 1).count() <= self.few_ids:
            known = F.broadcast(known)
        component = F.when(F.col("n_shingles") > 0, F.least(F.coalesce("label", "doc_id"), "doc_id")).otherwise(F.col("doc_id"))
        key = F.when(F.col("n_shingles") > 0, F.col("key"))
        result = self.rows.select("doc_id", "n_shingles", key.alias("key")).join(known, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        return self.whole_docs(result).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(80, 100), few_ids: int = 2_000_000, most_rows: int = 2048, most_shingles: int = 8_000_000, sample: int = 10_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. docs: doc_id, text."""
    return Search(spark, docs, k, threshold, few_ids, most_rows, most_shingles, sample).run()
