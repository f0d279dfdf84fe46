"""A batch of source files to nodes, edges, mentions, diagnostics and stats."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..front.parse import Parsed, normalized, scan
from ..functions.naming import file_name, ix_ref, node_id
from ..operators.corpus import functions_of, methods_of, types_of
from ..operators.edges import fold_edges, sort_diagnostics, sort_edges, sort_mentions, sort_nodes
from ..operators.imports import resolve_imports
from ..operators.mentions import harvest
from ..operators.resolve import reachable_types, resolve_calls, resolve_relations
from ..operators.typeenv import type_environment
from ..sources.scratch import Tables


@dataclass
class Extraction:
    """The output relations, unsorted; `ordered` puts them in their canonical order."""

    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame
    diagnostics: DataFrame
    stats: DataFrame

    def ordered(self) -> dict[str, DataFrame]:
        return {
            "nodes": sort_nodes(self.nodes).drop("file_ord", "ord"),
            "edges": sort_edges(self.edges),
            "mentions": sort_mentions(self.mentions),
            "diagnostics": sort_diagnostics(self.diagnostics).drop("file_ord", "ord"),
            "stats": self.stats,
        }


def site(source, edge_type, target, reason: str, file, line) -> list:
    return [source.alias("source_ref"), edge_type.alias("edge_type"), target.alias("target_ref"), F.lit(reason).alias("reason"), file.alias("file"), line.cast("int").alias("line")]


@dataclass
class Known:
    """What names may resolve to: the declarations, types of members and files of a batch (or those that a part of it may ask for)."""

    types: DataFrame
    methods: DataFrame
    functions: DataFrame
    returns: DataFrame
    fields: DataFrame
    files: DataFrame

    @classmethod
    def of(cls, parsed: Parsed, declared: DataFrame) -> Known:
        fields = parsed.fields().drop("path").join(parsed.files.select("file_ord", "org", "repo", "path"), "file_ord")
        return cls(types_of(declared), methods_of(declared), functions_of(declared), parsed.returns(), fields, parsed.files)


class Resolved:
    """What the files of parsed (with their facts) say once their names are resolved against everything that is known. sites: file_ord and the columns of edge sites.

    Each table is written when it is first asked for, and so only where something needs it.
    """

    def __init__(self, parsed: Parsed, facts: DataFrame | Callable[[], DataFrame], known: Known, tables: Tables):
        self.parsed, self.known, self.tables = parsed, known, tables
        self.facts = facts if callable(facts) else lambda: facts

    @cached_property
    def env(self) -> DataFrame:
        known = self.known
        return self.tables.cut(type_environment(self.parsed.bindings(), self.parsed.enclosing(), known.functions, known.methods, known.returns, known.fields, self.tables), "types")

    @cached_property
    def imports(self) -> DataFrame:
        return self.tables.cut(resolve_imports(self.parsed.imports(), self.known.files.select("path")), "imports")

    @cached_property
    def mentions(self) -> DataFrame:
        return self.tables.cut(harvest(self.parsed.comments()), "mentions")

    @cached_property
    def calls(self) -> DataFrame:
        known = self.known
        reachable = lambda: reachable_types(known.types, self.found().select("path", "target_path").distinct(), known.files)
        return self.tables.cut(resolve_calls(self.parsed.calls(), self.env, self.parsed.enclosing(), reachable, known.methods, known.functions, self.tables), "calls")

    def found(self) -> DataFrame:
        return self.imports.where("target_path IS NOT NULL")

    @cached_property
    def sites(self) -> DataFrame:
        place = [F.col("path"), F.col("line")]
        # three tables that don't need each other are written side by side
        with ThreadPoolExecutor(3) as pool:
            for made in [pool.submit(getattr, self, name) for name in ("env", "imports", "mentions")]:
                made.result()
        contains = self.facts().where("parent IS NOT NULL").select("file_ord", *site(F.col("parent"), F.lit("contains"), F.col("qualified_name"), "syntactic", *place))
        names = self.parsed.files.select("file_ord", "org", "repo", "file_ref")
        imported = self.found().join(names, "file_ord").select("file_ord", *site(F.col("file_ref"), F.lit("imports"), file_name(F.col("org"), F.col("repo"), F.col("target_path")), "path-resolved", *place))
        references = self.mentions.select("file_ord", *site(F.col("source"), F.lit("references"), F.col("identifier"), "explicit-mention", F.col("file"), F.col("line")))
        called = self.calls.where("target IS NOT NULL").select("file_ord", F.col("caller").alias("source_ref"), F.lit("calls").alias("edge_type"), F.col("target").alias("target_ref"), "reason", F.col("path").alias("file"), F.col("line").cast("int").alias("line"))
        related = resolve_relations(self.parsed.relations(), self.known.types)
        relations = related.select("file_ord", "source_ref", "edge_type", "target_ref", F.lit("syntactic").alias("reason"), F.col("path").alias("file"), F.lit(1).alias("line"))
        return contains.union(imported).union(references).union(called).union(relations)


def nodes_of(facts: DataFrame) -> DataFrame:
    return facts.select(
        node_id(F.col("object_type"), F.col("qualified_name")).alias("id"), ix_ref(F.col("qualified_name")).alias("reference"), "object_type", F.col("qualified_name").alias("name"),
        F.struct("kind", "path", F.struct(F.col("line").alias("start"), F.col("last").alias("end")).alias("span"), "parent", "visibility", "signature").alias("data"), "file_ord", "ord",
    )


def warnings_of(imports: DataFrame) -> DataFrame:
    return imports.where("relative AND target_path IS NULL").select("file_ord", "ord", F.lit("unresolved_import").alias("code"), F.concat(F.lit("unresolved import: "), "specifier").alias("message"), "path", "line", F.lit(None).cast("int").alias("column"), F.lit("warning").alias("severity"))


def stats_of(files: DataFrame, diagnostics: DataFrame, calls: DataFrame, env: DataFrame) -> DataFrame:
    """One row. calls: target; env: file_ord, rounds, bound."""
    counts = (
        files.agg(F.count("*").alias("files"))
        .crossJoin(diagnostics.agg(F.count_distinct(F.when(F.col("code") == "parse_error", F.col("file_ord"))).alias("files_with_errors")))
        .crossJoin(calls.agg(F.count_if(F.col("target").isNull()).alias("unresolved_calls")))
        .crossJoin(env.agg(F.max("rounds").alias("most"), F.count_distinct(F.when(F.col("bound"), F.col("file_ord"))).alias("files_hitting_iteration_bound")))
    )
    return counts.select(*(F.col(c).cast("int").alias(c) for c in ("files", "files_with_errors", "unresolved_calls")), F.when(F.col("files") > 0, F.greatest(F.lit(1), F.coalesce("most", F.lit(1)))).otherwise(0).cast("int").alias("max_fixpoint_iterations"), F.col("files_hitting_iteration_bound").cast("int").alias("files_hitting_iteration_bound"))


class Extracted(Extraction):
    """The relations of files, each computed when it is first asked for, on tables that are written once, when the first needs them."""

    def __init__(self, files: DataFrame, scanned: DataFrame | None):
        self.files, self.scanned, self.tables = files, scanned, Tables(files.sparkSession, "extract")

    @cached_property
    def parsed(self) -> Parsed:
        return Parsed(self.tables.cut(scan(normalized(self.files)), "rows") if self.scanned is None else self.scanned)

    @cached_property
    def facts(self) -> DataFrame:
        return self.tables.cut(self.parsed.facts(), "facts")

    @cached_property
    def resolved(self) -> Resolved:
        return Resolved(self.parsed, lambda: self.facts, Known.of(self.parsed, self.parsed.declared()), self.tables)

    @cached_property
    def nodes(self) -> DataFrame:
        return nodes_of(self.facts)

    @cached_property
    def edges(self) -> DataFrame:
        return fold_edges(self.resolved.sites.drop("file_ord"))

    @cached_property
    def mentions(self) -> DataFrame:
        return self.resolved.mentions.drop("file_ord")

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self.parsed.diagnostics().unionByName(warnings_of(self.resolved.imports))

    @cached_property
    def stats(self) -> DataFrame:
        return stats_of(self.parsed.files, self.parsed.diagnostics(), self.resolved.calls, self.resolved.env)


def extract(files: DataFrame, scanned: DataFrame | None = None) -> Extraction:
    """files: org, repo, path, language, content. scanned: rows of front.parse.scan for the files, if they are kept.

    Texts are read once and never shuffled. The scanned rows are written, as numbers of files are
    given with them; a dozen consumers read them. Nothing is done before a relation is asked for.
    """
    return Extracted(files, scanned)
