"""Quality by co-training of a text view and a metadata view.

One pass measures every document twice. The text view holds what is written: shares of kinds
of characters, word lengths, how often words repeat. The metadata view holds what surrounds
it: source, language, length and layout (lines, their lengths, repeated lines, delimiters).
Two logistic regressions start from the labelled rows. In each round each of them labels the
unlabelled documents it is surest of, in the proportion of the classes and a growing share of
all, and the other one learns from these. At last both are calibrated on labelled rows that
training never saw, and a third regression over the two calibrated logits gives the score.

All unlabelled documents take part: how sure a view must be follows from counts of logits by
narrow bins, and each step of Newton's method from sums over all rows, both added up by Spark.
At most `sample` labelled rows are learned from, taken by hash; the measures are written to the
shared folder, and every document is scored.

Defined results: null and empty texts are measured as empty; null sources and languages are a
value of their own; a null doc_id is scored and never labelled; repeated rows are scored each;
without labelled rows of both kinds every score is 1 and nothing is rejected; an empty table
gives no rows; extra columns are ignored. Of labels that contradict each other for a doc_id
the lower is taken. A document is rejected if its score is under 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_hash, lean, row_key
from .logistic import Logistic, sigmoid

KINDS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 stops, 6 other marks, 7 not ASCII
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:] = 1, 2, 3, 7
KINDS[[32, 9, 10, 13]] = 4
KINDS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
KINDS[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 6
SOURCES, LANGS = 32, 8
MARKED = re.compile(r"[^\w\s]{2,}(?=\s|$)")


def text_view(text: str) -> list[float]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    share = np.bincount(KINDS[data], minlength=8) / max(1, len(data))
    words = text.split()
    n = len(words)
    distinct = len(set(words))
    marked = len(MARKED.findall(text))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [*share.tolist(), distinct / max(1.0, n**0.9), pairs / max(1, n - 1), marked / max(1, n), min(len(text) / max(1, n), 40.0), float(np.log1p(n)), float(n < 5), share[2] / max(1e-3, share[1] + share[2]), share[5] + share[6]]


def metadata_view(text: str, source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    lines = text.split("\n")
    sizes = np.array([len(x) for x in lines])
    own = [0.0] * (SOURCES + LANGS)
    own[zlib.crc32(f"s{source}".encode()) % SOURCES] = 1.0
    own[SOURCES + zlib.crc32(f"l{lang}".encode()) % LANGS] = 1.0
    return [*own, float(np.log1p(max(0, n_chars or 0))), float(np.log1p(len(lines))), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())), len(set(lines)) / len(lines), text.count("|") / max(1, len(text)) * 10, text.count("!") / max(1, len(text)) * 10]


TEXT = len(text_view(""))


VIEWS = (slice(0, TEXT), slice(TEXT, None))
WIDTH = 0.05  # of a bin of logits
BINS = int(70 / WIDTH)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and the measures of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_view(t.as_py() or "") + metadata_view(t.as_py() or "", s, g, n) for t, s, g, n in zip(b.column(2), *(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "row_key", "x"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]
    return docs.select(*columns).mapInArrow(lean(run), "doc_id long, row_key long, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def bins_of(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((logits + 35) / WIDTH), 0, BINS - 1).astype(np.int64)


def surest(counts: np.ndarray, share: float, good: float) -> tuple[int, int]:
    """The bins up to which, and from which on, a view is sure: so many rows of each kind as `share` of all in the proportion of the classes, whole bins, and at least 95 %."""
    n = counts.sum()
    low = int(np.searchsorted(np.cumsum(counts), max(1.0, n * share * (1 - good))))
    high = BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), max(1.0, n * share * good)))
    sure = np.log(0.95 / 0.05)
    return min(low, int(bins_of(np.array([-sure]))[0])), max(high, int(bins_of(np.array([sure]))[0]))


def newton_sums(x: np.ndarray, models: list[Logistic], bounds: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each view the count, gradient and curvature (flat) of the rows that the other view is sure of."""
    logits = [m.logits(x[:, v]) for m, v in zip(models, VIEWS, strict=True)]
    out = []
    for i in (0, 1):
        at = bins_of(logits[1 - i])
        low, high = bounds[1 - i]
        some = (at <= low) | (at >= high)
        m = models[i]
        z = np.hstack([(x[some][:, VIEWS[i]] - m.mean) / m.scale, np.ones((int(some.sum()), 1))])
        p = sigmoid(logits[i][some])
        out.append(np.concatenate([[len(z)], z.T @ ((at[some] >= high) - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]))
    return out


class Unlabelled:
    """All documents without a label: what the views need to know of them, added up by Spark."""

    def __init__(self, measured: DataFrame):
        self.rows = measured.where("quality IS NULL").select("x")

    def counts(self, models: list[Logistic]) -> list[np.ndarray]:
        """Rows by bin of the logits of each view."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * BINS, dtype=np.int64)
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0))
                    total += np.concatenate([np.bincount(bins_of(m.logits(x[:, v])), minlength=BINS) for m, v in zip(models, VIEWS, strict=True)])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

        total = np.zeros(2 * BINS)
        for r in self.rows.mapInArrow(lean(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            total[r["at"]] = r["n"]
        return [total[:BINS], total[BINS:]]

    def sums(self, models: list[Logistic], bounds: list[tuple[int, int]]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | float = 0.0
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    total = total + np.concatenate(newton_sums(matrix(b.slice(at, 4096).column(0)), models, bounds))
            value = np.atleast_1d(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], ["at", "value"])

        sizes = [1 + d + d * d for d in (len(m.weights) for m in models)]
        total = np.zeros(sum(sizes))
        for r in self.rows.mapInArrow(lean(run), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            total[r["at"]] += r["value"]
        return [total[: sizes[0]], total[sizes[0] :]]


@dataclass
class CoTrained:
    text: Logistic
    metadata: Logistic
    calibrated: tuple[Logistic, Logistic]
    combined: Logistic

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pool: Unlabelled, rounds: int, share: float, weight: float = 0.3, steps: int = 3) -> CoTrained:
        """Every third labelled row is kept for calibration. A pseudo-label weighs `weight` of a label, and all together not more than that of all labels."""
        held = np.arange(len(x)) % 3 == 0
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.ones(len(x), dtype=bool)
        fit_x, fit_y = (x, y) if held.all() else (x[~held], y[~held])
        models = [Logistic.fit(fit_x[:, v], fit_y) for v in VIEWS]
        for turn in range(rounds):
            bounds = [surest(n, share * (turn + 1), fit_y.mean()) for n in pool.counts(models)]
            teachers = models
            for _ in range(steps):
                moved = []
                for m, v, s in zip(models, VIEWS, pool.sums(models, bounds), strict=True):
                    d = len(m.weights)
                    own = weight * min(1.0, len(fit_x) / max(1.0, s[0]))
                    moved.append(m.step(fit_x[:, v], fit_y, own * s[1 : 1 + d], own * s[1 + d :].reshape(d, d)))
                models = moved
            if all(np.abs(m.weights - t.weights).max() < 1e-3 for m, t in zip(models, teachers, strict=True)):
                break
        logits = [m.logits(x[held][:, v])[:, None] for m, v in zip(models, VIEWS, strict=True)]
        calibrated = tuple(Logistic.fit(z, y[held]) for z in logits)
        stacked = np.hstack([c.logits(z)[:, None] for c, z in zip(calibrated, logits, strict=True)])
        return cls(models[0], models[1], calibrated, Logistic.fit(stacked, y[held]))

    def views(self, x: np.ndarray) -> list[np.ndarray]:
        """Calibrated logits of the text and of the metadata view."""
        return [c.logits(m.logits(part)[:, None]) for c, m, part in zip(self.calibrated, (self.text, self.metadata), (x[:, :TEXT], x[:, TEXT:]), strict=True)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.combined.predict(np.stack(self.views(x), axis=1))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 20_000, rounds: int = 3, share: float = 0.1) -> DataFrame:
    """doc_id, score, text_score, metadata_score, kept, row_key for every row of docs. labels: doc_id, quality."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    measured = Scratch(spark, "quality").cut(measure(docs).join(marked, "doc_id", "left"), "measures")
    labelled = measured.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality"))
    rows = by_hash(labelled, "doc_id", sample).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").select("x", "quality").toPandas()
    model = None
    if len(set(rows.quality)) == 2:
        model = CoTrained.fit(np.array(rows.x.tolist(), dtype=np.float64), rows.quality.to_numpy().astype(float), Unlabelled(measured), rounds, share)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for b in batches:
            if fitted is None or not b.num_rows:
                p = q = m = np.ones(b.num_rows)
            else:
                x = matrix(b.column(2))
                p, (q, m) = fitted.predict(x), map(sigmoid, fitted.views(x))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.float64()) for v in (p, q, m)), pa.array(p >= 0.5, pa.bool_()), b.column(1)], ["doc_id", "score", "text_score", "metadata_score", "kept", "row_key"])

    return measured.select("doc_id", "row_key", "x").mapInArrow(lean(run), "doc_id long, score double, text_score double, metadata_score double, kept boolean, row_key long")
