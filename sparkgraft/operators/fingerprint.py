"""Fingerprints of whole relations that need no sort, and the rows in which two relations differ."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Tables
from .corpus import dense_order

#: Fixed value: equal rows that are made at a time.
REPEATS = 10_000
PRIME, BASE = 2**127 - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835 % (2**127 - 1)


def row_digest(columns: list[str]) -> Column:
    """32 hex digits of a row; columns are taken as text, null apart from any text."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns)))


def halves(digest: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits from a digest, in a type that holds the sums of any number of rows."""
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17))


def fingerprint(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, low, high per group: how many rows, and the sums of their digests' halves. Equal multisets have equal ones, whatever their order and partitions."""
    by = by or []
    low, high = halves(F.col("__digest"))
    held = rows.withColumn("__digest", row_digest([c for c in rows.columns if c not in by]))
    return held.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(low).cast("string"), F.lit("0")).alias("low"), F.coalesce(F.sum(high).cast("string"), F.lit("0")).alias("high"))


def differing_rows(left: DataFrame, right: DataFrame, step: int = 2, few: int = 100_000) -> DataFrame:
    """side and the columns of every row that one relation holds oftener than the other, as often as it does.

    Both are bisected by the first digits of their rows' digests: groups with equal sums are equal,
    others are cut further until few rows are left, or two cuts on end leave more than half of them,
    as they do where differences lie in most groups. Only what is left is compared. Equal relations
    cost a partial aggregate.
    """
    tables = Tables(left.sparkSession, "differing")
    columns = left.columns
    # sums of 128 bits by four parts, that no number of rows lets overflow
    hashes = F.xxhash64("__digest"), F.xxhash64(F.lit(1), "__digest")
    parts = [p for h in hashes for p in (F.shiftright(h, 32), h.bitwiseAND(F.lit(2**32 - 1)))]
    both = left.select(*columns, F.lit(1).alias("__n")).union(right.select(*columns, F.lit(-1).alias("__n"))).withColumn("__digest", row_digest(columns))
    kept, at, depth, rows, in_vain = None, 0, 0, None, 0
    while depth < 32 and in_vain < 2 and (rows is None or rows > few):
        depth += step
        held = both if kept is None else within(both, kept, at)
        sums = held.groupBy(F.substring("__digest", 1, depth).alias("p")).agg(F.count("*").alias("n"), F.sum("__n").alias("more"), *(F.sum(F.col("__n") * p).alias(f"s{i}") for i, p in enumerate(parts)))
        found = tables.cut(sums.withColumn("differs", F.expr("more <> 0 OR s0 <> 0 OR s1 <> 0 OR s2 <> 0 OR s3 <> 0")), f"level{depth}")
        whole, rows = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("differs"), F.col("n"))), F.lit(0))).first()
        in_vain = in_vain + 1 if 2 * rows > whole else 0
        if not in_vain:
            kept, at = found.where("differs").select(F.col("p").alias("__kept")), depth
    held = both if kept is None else within(both, kept, at)
    # one aggregate for both sides: what is left of a row's count says which holds it oftener; repeats are made in blocks
    over = held.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0").withColumn("side", F.when(F.col("__n") > 0, "left").otherwise("right")).withColumn("__n", F.abs("__n"))
    blocks = over.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(REPEATS).cast("long"))))
    return blocks.select(F.explode(F.array_repeat("side", F.least(F.lit(REPEATS), F.col("__n") - F.col("__at")).cast("int"))).alias("side"), *columns)


def within(rows: DataFrame, kept: DataFrame, depth: int) -> DataFrame:
    return rows.withColumn("__kept", F.substring("__digest", 1, depth)).join(kept, "__kept", "left_semi").drop("__kept")


def ordered_digest(rows: DataFrame, order: list[str]) -> DataFrame:
    """n and digest (hex) of rows as a sequence in an order, equal rows being interchangeable: the same at any number of partitions.

    With h(i) the digest of row i, it is the sum of h(i) * BASE^i modulo PRIME, so each task adds up
    its own rows and the parts are added; a row at another place counts differently.
    """
    columns = rows.columns
    numbered = dense_order(rows.withColumn("__digest", row_digest(columns)).select(*order, "__digest"), [*order, "__digest"], "__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = n = 0
        last, power = -2, 0
        for b in batches:
            for place, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                power = power * BASE % PRIME if place == last + 1 else pow(BASE, place, PRIME)
                last = place
                total = (total + int(digest, 16) * power) % PRIME
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([f"{total:032x}"])], ["n", "part"])

    parts = numbered.select("__place", "__digest").mapInArrow(run, "n long, part string").collect()  # a row for each task
    total = sum(int(p["part"], 16) for p in parts) % PRIME
    return rows.sparkSession.createDataFrame([(sum(p["n"] for p in parts), f"{total:032x}")], "n long, digest string")
