import random

import numpy as np
from pyspark.sql import functions as F

from sparkgraft.llm import quality
from sparkgraft.llm.queries import op6_quality


def make(n, seed=0):
    """Good prose and three kinds of junk; junk comes more often from one source."""
    r = random.Random(seed)
    vocabulary = [a + b + c for a in ("ba", "ko", "mi") for b in ("ra", "lo", "ne") for c in ("s", "nt", "")]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30, 200))]
        bad = r.random() < 0.25
        if bad:
            kind = r.randrange(3)
            words = [w + "%%%" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * len(words)
        text = "\n".join(" ".join(words[j : j + 12]) + "." for j in range(0, len(words), 12))
        rows.append((i, text, "en", "spam" if bad and r.random() < 0.7 else r.choice("abc"), len(text), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = make(900)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 3], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(spark, docs, labels).collect()}
    held = [(got[r[0]].kept, bool(r[5])) for r in rows if r[0] % 3 == 0]
    assert len(got) == 900 and np.mean([a == b for a, b in held]) > 0.98
    assert all(got[r[0]].kept for r in rows if r[5])


class Plain:
    """The pool as one array, each row looked at on its own."""

    def __init__(self, x):
        self.x = x

    def counts(self, models):
        out = [np.zeros(quality.BINS), np.zeros(quality.BINS)]
        for row in self.x:
            for i, part in enumerate((row[: quality.TEXT], row[quality.TEXT :])):
                z = float(((part - models[i].mean) / models[i].scale) @ models[i].weights[:-1] + models[i].weights[-1])
                out[i][min(quality.BINS - 1, max(0, int((z + 35) // quality.WIDTH)))] += 1
        return out

    def sums(self, models, bounds):
        out = [0.0, 0.0]
        for row in self.x:
            parts = [(p - m.mean) / m.scale for p, m in zip((row[: quality.TEXT], row[quality.TEXT :]), models, strict=True)]
            z = [p @ m.weights[:-1] + m.weights[-1] for p, m in zip(parts, models, strict=True)]
            for i in (0, 1):
                at = min(quality.BINS - 1, max(0, int((z[1 - i] + 35) // quality.WIDTH)))
                mark = 1.0 if at >= bounds[1 - i][1] else 0.0 if at <= bounds[1 - i][0] else None
                if mark is not None:
                    p, own = 1 / (1 + np.exp(-z[i])), np.append(parts[i], 1.0)
                    out[i] = out[i] + np.concatenate([[1.0], (mark - p) * own, (p * (1 - p) * np.outer(own, own)).ravel()])
        return out


def views_apart(n=2000):
    """A metadata view that is told apart only by what the text view finds in the pool."""
    rng = np.random.default_rng(0)
    y = rng.random(n) < 0.6
    x = rng.normal(size=(n, quality.TEXT + 4))
    x[:, 0] += np.where(y, 2.5, -2.5)
    x[:, quality.TEXT] += np.where(y, 1.5, -1.5)
    return x, y


def test_views_teach_each_other():
    x, y = views_apart()
    few, pool, test = slice(0, 60), slice(60, 1200), slice(1200, None)
    alone = quality.CoTrained.fit(x[few], y[few].astype(float), Plain(x[pool]), rounds=0, share=0.1)
    taught = quality.CoTrained.fit(x[few], y[few].astype(float), Plain(x[pool]), rounds=4, share=0.1)
    right = [np.mean((m.metadata.logits(x[test][:, quality.TEXT :]) > 0) == y[test]) for m in (alone, taught)]
    assert right[1] > right[0] and np.mean((taught.predict(x[test]) >= 0.5) == y[test]) > 0.97


def test_sums_of_the_job_are_those_of_single_rows(spark):
    x, y = views_apart(700)
    x = x.astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(r.tolist(), None) for r in x[100:]], "x array<float>, quality int").repartition(3)
    models = [quality.Logistic.fit(x[:100, v], y[:100].astype(float)) for v in quality.VIEWS]
    job, plain = quality.Unlabelled(rows), Plain(x[100:])
    for a, b in zip(job.counts(models), plain.counts(models), strict=True):
        assert np.array_equal(a, b)
    bounds = [quality.surest(n, 0.2, 0.6) for n in job.counts(models)]
    for a, b in zip(job.sums(models, bounds), plain.sums(models, bounds), strict=True):
        assert np.allclose(a, b) and a[0] > 20
    fits = [quality.CoTrained.fit(x[:100], y[:100].astype(float), p, rounds=2, share=0.1).predict(x) for p in (job, plain)]
    assert np.allclose(*fits)


def test_query_against_a_plain_computation(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = {r.doc_id: np.array(quality.text_view(r.text or "") + quality.metadata_view(r.text or "", r.source, r.lang, r.n_chars), dtype=np.float32).astype(float) for r in docs}
    order = [r.doc_id for r in spark.createDataFrame([(i,) for i in x if i in label], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(1))).collect()]
    fitted = quality.CoTrained.fit(np.array([x[i] for i in order]), np.array([float(label[i]) for i in order]), Plain([x[i] for i in x if i not in label]), rounds=3, share=0.1)
    got = {r.doc_id: (r.score, r.kept) for r in op6_quality(spark, sf).collect()}
    want = fitted.predict(np.array(list(x.values())))
    assert set(got) == set(x) and np.allclose([got[i][0] for i in x], want, atol=1e-6) and all(got[i][1] == (p >= 0.5) for i, p in zip(x, want, strict=True) if abs(p - 0.5) > 1e-6)


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x", "en", "a", 1), (3, "z" * 300_000, "en", "a", -5), (3, "\n" * 50, "en", "a", 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "0 AS quality", "1 AS x")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality.score(spark, docs, none).collect()] == [True] * 5
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (None, 0), (9, None)], "doc_id long, quality int")
    assert len([r for r in quality.score(spark, docs, labels).collect() if 0 <= r.score <= 1]) == 5
    assert quality.score(spark, docs.limit(0), labels).count() == 0
