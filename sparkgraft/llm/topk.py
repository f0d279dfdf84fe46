"""Exact top-k inner products over norm buckets.

Vectors are grouped by length (norm) into quantile buckets, and a bucket of more than
`block_rows` vectors into hashed blocks, so that many vectors of equal length never meet in
one task. Every query is first scored against one bounded block of the longest vectors: its
k-th score there is a threshold. A bucket whose longest vector cannot reach the threshold is
never sent the query, and a block is sent only to those groups of queries that ask for it. In each block the threshold gives a local cosine; where that is high,
vectors are pruned by the query's largest coordinate, else by length. What is left is scored
exactly, and each query's best k of all blocks are kept.

Queries and vectors meet in groups of bounded size: `query_rows` queries by `block_rows`
vectors. Nothing but the bucket edges (at most 512 numbers) reaches the driver; broadcast is
one block of at most `block_rows` vectors.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part; vectors of unequal dimension are compared over the shorter one's components; ties go to
the smaller id; a query with fewer than k partners returns all; rows that repeat an id are
candidates for others, never for that id itself; rows with a null id take no part; empty
tables give no rows; extra columns are ignored. Query rows that repeat an id are ranked each on
its own, so such an id has every rank once for each of its rows. Scores are exact integers,
clamped to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

LONG = 2**63 - 1


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors held as doubles (or as Python integers, if doubles can't hold them)."""
    d = min(rows.shape[1], len(query))
    rows, query = rows[:, :d], query[:d]
    if d == 0 or len(rows) == 0:
        return np.zeros(len(rows), dtype=np.int64)
    if np.abs(query).max() * float(np.abs(rows).max()) * d < 2**53:
        return (rows @ query).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in rows], dtype=object) @ np.array([int(x) for x in query], dtype=object)
    return np.array([max(-LONG - 1, min(LONG, int(x))) for x in exact], dtype=np.int64)


def stack(vectors) -> np.ndarray:
    """Rows of packed doubles as a matrix; shorter rows are filled up with zeros."""
    rows = [np.frombuffer(v, dtype="<f8") for v in vectors]
    width = max((len(r) for r in rows), default=0)
    if all(len(r) == width for r in rows):
        return np.array(rows, dtype=np.float64).reshape(len(rows), width)
    return np.array([np.pad(r, (0, width - len(r))) for r in rows])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    keep = np.arange(len(scores))
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    by_id = keep[np.argsort(ids[keep], kind="stable")]
    return by_id[np.argsort(-np.maximum(scores[by_id], -LONG), kind="stable")][:k]


def survivors(q: np.ndarray, q_norm: float, need: float, unit: np.ndarray, norms: np.ndarray, cosine: float) -> np.ndarray | slice:
    """Rows of a block (by falling norm) that may reach the product `need`.

    By length: |p| * |q| must reach it, so a prefix is left. By coordinate, where the local cosine
    threshold is high: with c the query's largest coordinate in size, a unit vector at cosine t or
    more has its own coordinate within c*t -+ sqrt((1-c^2)(1-t^2)).
    """
    prefix = slice(0, int(np.searchsorted(-norms, -(need / q_norm), side="right")) if need > 0 and q_norm > 0 else len(norms))
    if cosine < coordinate_from or q_norm == 0:
        return prefix
    f = int(np.argmax(np.abs(q)))
    c, t = q[f] / q_norm, min(cosine, 1.0)
    room = np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - t * t)) + 1e-9
    x = unit[prefix, f] if f < unit.shape[1] else np.zeros(prefix.stop)
    low = c * t - room if c > 0 else -np.inf
    high = c * t + room if c < 0 else np.inf
    return np.flatnonzero((x >= low) & (x <= high))


#: Local cosine thresholds from here on are pruned by coordinate.
coordinate_from = 0.8


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. vectors: vec_id, embedding. Components become floor(scale * x)."""
    scratch = Scratch(spark, "topk")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, packed, norms, asks, numbers = [], [], [], [], []
            for i, v, ask, number in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                packed.append(x.astype("<f8").tobytes())
                norms.append(float(np.linalg.norm(x)))
                asks.append(bool(ask))
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(norms, pa.float64()), pa.array(asks, pa.bool_()), pa.array(numbers, pa.int64())], ["vec_id", "v", "norm", "ask", "row"])

    # rows are numbered once and written, so the numbers hold for all that follows
    measured = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("ask"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.cut(measured.mapInArrow(measure, "vec_id long, v binary, norm double, ask boolean, row long"), "rows")
    n = rows.count()
    count = int(min(512, max(1, n // block_rows)))
    edges = rows.agg(F.percentile_approx("norm", [i / count for i in range(1, count)] or [0.5], 10_000)).first()[0] or []
    edges = sorted(set(edges)) if count > 1 else []
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("norm") > F.lit(e)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    sizes = {r["bucket"]: (r["n"], r["top"]) for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    blocks = {b: -(-m // block_rows) for b, (m, _) in sizes.items()}
    tops = sorted(((b, top, blocks[b]) for b, (_, top) in sizes.items()), reverse=True)
    per_bucket = F.element_at(F.create_map(*[F.lit(x) for b in sorted(blocks) for x in (b, blocks[b])]), F.col("bucket")) if blocks else F.lit(1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), per_bucket).cast("int"))

    # one bounded block of the longest vectors gives each query a threshold
    longest = rows.where((F.col("bucket") == (tops[0][0] if tops else 0)) & (F.col("block") == 0)).select("vec_id", "v").limit(2 * block_rows).collect()
    seed = spark.sparkContext.broadcast(([r["vec_id"] for r in longest], [bytes(r["v"]) for r in longest]))
    groups = max(1, -(-rows.where("ask").count() // query_rows))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The threshold of each query."""
        ids, matrix = np.array(seed.value[0], dtype=np.int64), stack(seed.value[1])
        for b in batches:
            needs = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                scores = products(matrix, np.frombuffer(v, "<f8"))[ids != i]
                need = float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf
                needs.append(need - abs(need) * 1e-9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(needs, pa.float64())], ["query_id", "q", "q_norm", "row", "need"])

    queries = rows.where("ask").select("vec_id", "v", "norm", "row").mapInArrow(ask, "query_id long, q binary, q_norm double, row long, need double")
    queries = scratch.cut(queries, "queries").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(groups)).cast("int"))
    # a query goes to the buckets whose longest vector may reach its threshold, and a block to the groups that ask for it
    there = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(top).alias("top"), F.lit(parts).alias("parts")) for b, top, parts in tops or [(0, 0.0, 1)]])
    asked = queries.withColumn("at", F.explode(F.filter(there, lambda t: F.col("q_norm") * t["top"] * (1 + 1e-9) >= F.col("need"))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("at.parts") - 1))).withColumn("bucket", F.col("at.bucket")).drop("at")
    wanted = asked.select(*(F.col(c).alias(c) for c in ("bucket", "block", "part"))).distinct()
    held = rows.select("bucket", "block", "vec_id", "v", "norm").join(wanted, ["bucket", "block"])

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(block):
            block = block.sort_values(["norm", "vec_id"], ascending=[False, True])
            ids, norms, matrix = block.vec_id.to_numpy(), block.norm.to_numpy(), stack(block.v)
            unit = matrix / np.where(norms > 0, norms, 1)[:, None]
            for i, v, norm, row, need in zip(queries.query_id, queries.q, queries.q_norm, queries.row, queries.need, strict=True):
                q = np.frombuffer(v, "<f8")
                cosine = need / (norm * norms[0]) if norm > 0 and norms[0] > 0 and need > 0 else -1.0
                left = survivors(q, norm, need, unit, norms, cosine)
                some, scores = ids[left], products(matrix[left], q)
                other = some != i
                some, scores = some[other], scores[other]
                at = best(some, scores, k)
                out += zip([i] * len(at), [row] * len(at), some[at].tolist(), scores[at].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"]).astype("int64")

    keys = ["bucket", "block", "part"]
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(meet, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
