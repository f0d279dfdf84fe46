"""Call sites and type relations resolved to declarations, tier by tier, by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import starts_uppercase
from ..sources.scratch import Tables
from .corpus import first_writer, unique_or_nothing
from .typeenv import SELF


def reachable_types(types: DataFrame, import_paths: DataFrame, files: DataFrame) -> DataFrame:
    """file_ord, owner: simple names of types declared in a file or in one that it imports directly; of files of one path the last in batch order is imported."""
    last = F.struct(*(c for c in ("org", "repo", "file_ord") if c in files.columns))
    newest = files.groupBy("path").agg(F.max_by("file_ord", last).alias("file_ord"))
    by_path = types.join(newest, ["path", "file_ord"], "left_semi").select(F.col("path").alias("target_path"), "simple").distinct()
    through = import_paths.join(by_path, "target_path").select("path", "simple").join(files.select("path", "file_ord"), "path").select("file_ord", "simple")
    return types.select("file_ord", "simple").union(through).distinct().withColumnRenamed("simple", "owner")


def resolve_calls(calls: DataFrame, env: DataFrame, enclosing: DataFrame, reachable: DataFrame | Callable[[], DataFrame], methods: DataFrame, functions: DataFrame, tables: Tables | None = None) -> DataFrame:
    """calls with target and reason (null where unresolved). calls: file_ord, caller, scope, receiver, callee, line.

    A known type, or a type-cased receiver, decides alone: if it lacks the method, nothing else
    is tried. Else exactly one reachable type with the method, else exactly one method of that
    name in the batch. A call without receiver takes the file's own function or else the only one.
    So each call is of one of three sorts, and meets the indexes of its sort only. reachable may be
    a function, which is called only where a call needs what lies in reach.
    """
    tables = tables or Tables(calls.sparkSession, "resolve")
    member = calls.where("receiver IS NOT NULL")
    # names of a scope; the special ones stand for the type around it, whatever is bound to them
    names = env.where("name IS NOT NULL").select("file_ord", "scope", F.col("name").alias("receiver"), "type")
    around = first_writer(enclosing, ["file_ord", "scope"], "owner", ["ord"])
    special = around.select("file_ord", "scope", F.explode(F.array(*map(F.lit, SELF))).alias("receiver"), F.col("owner").alias("self_type"))
    local = names.withColumnRenamed("type", "local_type").join(special, ["file_ord", "scope", "receiver"], "full_outer").select("file_ord", "scope", "receiver", F.coalesce("self_type", "local_type").alias("local_type"))
    whole = names.where("scope = ''").select("file_ord", "receiver", F.col("type").alias("file_type"))
    typed = member.join(local, ["file_ord", "scope", "receiver"], "left").join(whole, ["file_ord", "receiver"], "left")
    owner = F.coalesce("local_type", "file_type", F.when(starts_uppercase(F.col("receiver")), F.col("receiver")))
    typed = tables.cut(typed.select(*calls.columns, owner.alias("owner")), "typed-calls")
    decided, unknown = typed.where("owner IS NOT NULL"), typed.where("owner IS NULL")

    own_methods = first_writer(methods, ["file_ord", "owner", "method"], "target", ["ord"]).select("file_ord", "owner", F.col("method").alias("callee"), F.col("target").alias("own_method"))
    the_methods = unique_or_nothing(methods, ["owner", "method"], "target").select("owner", F.col("method").alias("callee"), F.col("target").alias("the_method"))
    decided = decided.join(own_methods, ["file_ord", "owner", "callee"], "left").join(the_methods, ["owner", "callee"], "left")
    decided = decided.select(*calls.columns, F.coalesce("own_method", "the_method").alias("target"), F.lit("receiver-typed").alias("reason"))

    if unknown.limit(1).count():
        # the methods in reach of a file, by name, before any call is looked at: a call meets one row of its name
        reachable = reachable() if callable(reachable) else reachable
        wanted = unknown.select("file_ord", "callee").distinct()
        in_file = reachable.join(own_methods, ["file_ord", "owner"]).select("file_ord", "owner", "callee", "own_method", F.lit(None).cast("string").alias("the_method"))
        in_batch = reachable.join(the_methods, "owner").select("file_ord", "owner", "callee", F.lit(None).cast("string").alias("own_method"), "the_method")
        within = in_file.union(in_batch).join(wanted, ["file_ord", "callee"], "left_semi").groupBy("file_ord", "callee", "owner").agg(F.coalesce(F.max("own_method"), F.max("the_method")).alias("target"))
        scoped = within.groupBy("file_ord", "callee").agg(F.count("*").alias("n"), F.min("target").alias("scoped"))
        by_name = unique_or_nothing(methods, ["method"], "target").select(F.col("method").alias("callee"), F.col("target").alias("named"))
        unknown = unknown.join(scoped, ["file_ord", "callee"], "left").join(by_name, "callee", "left")
        one = F.col("n") == 1
        unknown = unknown.select(*calls.columns, F.when(one, F.col("scoped")).when(F.col("n").isNull(), F.col("named")).alias("target"), F.when(one, "import-scoped").otherwise("name-match").alias("reason"))
        decided = decided.union(unknown)

    own_functions = first_writer(functions, ["file_ord", "simple"], "target", ["ord"]).select("file_ord", F.col("simple").alias("callee"), F.col("target").alias("own_function"))
    the_functions = unique_or_nothing(functions, ["simple"], "target").select(F.col("simple").alias("callee"), F.col("target").alias("the_function"))
    free = calls.where("receiver IS NULL").join(own_functions, ["file_ord", "callee"], "left").join(the_functions, "callee", "left")
    return decided.union(free.select(*calls.columns, F.coalesce("own_function", "the_function").alias("target"), F.lit("name-match").alias("reason")))


def resolve_relations(relations: DataFrame, types: DataFrame) -> DataFrame:
    """file_ord, path, source_ref, target_ref, edge_type of the relations whose two ends are known."""
    own = first_writer(types, ["file_ord", "simple"], "target", ["ord"])
    the = unique_or_nothing(types, ["simple"], "target")
    for side in ("child", "parent"):
        mine = own.select("file_ord", F.col("simple").alias(side), F.col("target").alias(f"{side}_own"))
        batch = the.select(F.col("simple").alias(side), F.col("target").alias(f"{side}_the"))
        relations = relations.join(mine, ["file_ord", side], "left").join(batch, side, "left").withColumn(f"{side}_ref", F.coalesce(f"{side}_own", f"{side}_the"))
    found = relations.where("child_ref IS NOT NULL AND parent_ref IS NOT NULL")
    return found.select("file_ord", "path", F.col("child_ref").alias("source_ref"), F.col("parent_ref").alias("target_ref"), F.when(F.col("is_trait"), "implements_trait").otherwise("extends").alias("edge_type"))
