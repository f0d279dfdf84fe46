"""Selected modules against supplied files: what is accepted, and why the rest is not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import content_identity
from .corpus import place_in_group

KEY = ["org", "repo", "path"]


def candidates(files: DataFrame) -> DataFrame:
    """files with their identity and place among those of the same key, by content hash; the first is the candidate.

    files: org, repo, path and content, or `supplied` (its digest) in place of it. Texts are
    digested where they lie; only digests are ordered, however many files share a key.
    """
    hashed = files if "supplied" in files.columns else files.withColumn("supplied", content_identity(F.col("content"))).drop("content")
    return place_in_group(hashed, KEY, ["supplied"])


def account(modules: DataFrame, files: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """org, repo, path, status of every module and of every file beyond them.

    modules: org, repo, path, identity. files: as candidates takes or gives them. broken: keys of
    candidates that can't be parsed. Status is accepted, not_supplied, identity_mismatch, unparsable or extra.
    """
    held = files if "place" in files.columns else candidates(files)
    first = held.where("place = 1").select(*KEY, "supplied", F.lit(True).alias("given"))
    wanted = modules.select(*KEY, "identity", F.lit(True).alias("asked"))
    joined = wanted.join(first, KEY, "full_outer")
    if broken is not None:
        joined = joined.join(broken.select(*KEY, F.lit(True).alias("broken")).distinct(), KEY, "left")
    else:
        joined = joined.withColumn("broken", F.lit(None).cast("boolean"))
    status = F.when(F.col("asked").isNull(), "extra").when(F.col("given").isNull(), "not_supplied").when(F.col("identity") != F.col("supplied"), "identity_mismatch").when(F.col("broken"), "unparsable").otherwise("accepted")
    more = held.where("place > 1").select(*KEY, F.lit("extra").alias("status"))
    return joined.select(*KEY, status.alias("status")).union(more)


def absent_functions(modules: DataFrame, facts: DataFrame) -> DataFrame:
    """org, repo, path, function of selected functions that no fact declares. modules: functions (an array of full names)."""
    asked = modules.select(*KEY, F.explode("functions").alias("function"))
    return asked.join(facts.where("object_type = 'code_function'").select(F.col("qualified_name").alias("function")).distinct(), "function", "left_anti").select(*KEY, "function")


def scope(modules: DataFrame, accounted: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """One row: full, partial or unavailable with its reason, and the number of modules missing."""
    doubled = modules.groupBy(*KEY).count().where("count > 1").agg((F.count("*") > 0).alias("doubled"))
    bad = accounted.where("status NOT IN ('accepted', 'extra')").select(*KEY)
    if absent is not None:
        bad = bad.union(absent.select(*KEY)).distinct()
    counts = modules.agg(F.count("*").alias("modules")).crossJoin(bad.agg(F.count("*").alias("missing"))).crossJoin(doubled)
    kind = F.when(F.col("doubled"), "unavailable:duplicate_module").when(F.col("modules") == 0, "unavailable:empty_selection").when(F.col("missing") == F.col("modules"), "unavailable:nothing_accounted").when(F.col("missing") > 0, "partial").otherwise("full")
    return counts.select(kind.alias("scope"), "modules", "missing")
