"""Indexes over a whole batch: unique-or-nothing, first and last writers, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import owning_type_segment, simple_segment
from ..sources.scratch import Tables


def unique_or_nothing(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """key, value where the key has exactly one distinct value. Least and greatest suffice, so nothing is gathered."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most")).where(F.col(value) == F.col("__most")).drop("__most")


def first_writer(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_writer(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def value_sets(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct pairs of key and value: a set per key, kept as rows."""
    return rows.select(*keys, value).distinct()


def batch_order(files: DataFrame) -> DataFrame:
    """files with file_ord, their dense place by org, repo and path."""
    return dense_order(files, ["org", "repo", "path"], "file_ord")


def place_in_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with place, from 1, among those of equal keys (not null). A group may hold most of the rows: it is dealt over ranges of the order."""
    numbered = dense_order(rows, [*keys, *order], "__o")
    first = numbered.groupBy(*keys).agg(F.min("__o").alias("__first"))
    return numbered.join(first, keys).withColumn("place", (F.col("__o") - F.col("__first") + 1).cast("int")).drop("__o", "__first")


def dense_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their dense place in an order, from 0, without a window over all rows.

    Partitions are ranges of the order; each gets the count of rows in those before it.
    """
    tables = Tables(rows.sparkSession, "order")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    ranged = tables.cut(ranged, "ranged")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("base")).collect()  # a row for each partition
    before, at = {}, 0
    for part in sorted(sizes, key=lambda r: r["__p"]):
        before[part["__p"]] = at - part["base"]
        at += part["n"]
    starts = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__p int, __start long")
    return ranged.join(F.broadcast(starts), "__p").withColumn(name, F.col("__i") + F.col("__start")).drop("__p", "__i", "__start")


def types_of(facts: DataFrame) -> DataFrame:
    """simple, target of every type declared in the batch."""
    return facts.where("object_type = 'code_type'").select(F.col("simple_name").alias("simple"), F.col("qualified_name").alias("target"), "path", "file_ord", "ord")


def methods_of(facts: DataFrame) -> DataFrame:
    """owner, method, target of every function below another name."""
    rows = facts.where("object_type = 'code_function'").withColumn("owner", owning_type_segment(F.col("qualified_name")))
    return rows.where("owner IS NOT NULL").select("owner", simple_segment(F.col("qualified_name")).alias("method"), F.col("qualified_name").alias("target"), "file_ord", "ord")


def functions_of(facts: DataFrame) -> DataFrame:
    """simple, target of every free function."""
    rows = facts.where("object_type = 'code_function'").where(owning_type_segment(F.col("qualified_name")).isNull())
    return rows.select(F.col("simple_name").alias("simple"), F.col("qualified_name").alias("target"), "file_ord", "ord")
