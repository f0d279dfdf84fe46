"""Edge sites to edges, and the orders of the output relations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MAX_EVIDENCE, MENTION_KINDS, REASONS
from ..sources.scratch import Tables


def confidence_of(reason: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in REASONS.items()))[reason]


#: Reasons from the weakest to the strongest, by confidence and name, so that the best of many is the greatest number.
RANKED = [r for _, r in sorted((confidence, reason) for reason, confidence in REASONS.items())]


def fold_edges(sites: DataFrame, most: int = MAX_EVIDENCE) -> DataFrame:
    """One edge per (source, type, target): all sites counted, the strongest reason, the first distinct evidence.

    Self-edges go first. Sites are counted by place and written once; counts are added up by partial
    aggregates of numbers, which need no sort, and evidence is cut before it is gathered, so that a hub
    edge never holds more than `most` places in memory.
    """
    key = ["source_ref", "edge_type", "target_ref"]
    ranked = F.array(*map(F.lit, RANKED))
    sites = sites.where("source_ref <> target_ref").withColumn("strength", F.array_position(ranked, F.col("reason")).cast("int"))
    places = Tables(sites.sparkSession, "fold").cut(sites.groupBy(*key, "file", "line").agg(F.count("*").alias("n"), F.max("strength").alias("best")), "places")
    totals = places.groupBy(*key).agg(F.sum("n").alias("count"), F.max("best").alias("best")).withColumn("reason", F.get(ranked, F.col("best") - 1))
    first = places.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("file", "line"))).where(F.col("rank") <= most)
    evidence = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("evidence"))
    return totals.join(evidence, key).select(*key, confidence_of(F.col("reason")).alias("confidence"), "reason", "evidence", "count")


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MENTION_KINDS)), kind)


def sort_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("object_type", "name", *(c for c in ("file_ord", "ord") if c in nodes.columns))


def sort_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("source_ref", "edge_type", "target_ref")


def sort_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.dropDuplicates().orderBy("identifier", kind_order(F.col("kind")), "source", "file", "line")


def sort_diagnostics(rows: DataFrame) -> DataFrame:
    return rows.orderBy("path", F.asc_nulls_first("line"), "code", *(c for c in ("file_ord", "ord") if c in rows.columns))
