"""Graphs that follow their files: parses kept by content, and edges maintained by what changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..front.parse import COLUMNS, Parsed, normalized, scan
from ..functions.naming import content_identity, simple_segment
from ..operators.corpus import functions_of, methods_of, types_of
from ..operators.edges import fold_edges
from ..operators.imports import family_of, module_index, stem_of, stems_of_paths
from ..operators.mentions import harvest
from ..plans.extract import Extraction, Known, Resolved, nodes_of, stats_of, warnings_of
from ..sources.scratch import Tables

ROWS = "file_ord string, " + COLUMNS
KEY = ["source_ref", "edge_type", "target_ref"]
EDGES = "source_ref string, edge_type string, target_ref string, confidence double, reason string, evidence array<struct<file:string,line:int>>, count bigint"


def stored(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """A Parquet folder, or no rows if there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(ddl).parquet(folder)
    return spark.createDataFrame([], ddl)


def scan_with_cache(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Scanned rows of files; texts that folder doesn't know are scanned and added to it.

    A parse depends on a file's name, language and content alone. Each write has a name of its
    own and a key counts in one of them, so a retry that writes again changes nothing. A file
    that is given twice is scanned once and has its rows twice.
    """
    ddl = "key string, batch string, " + COLUMNS
    keyed = files.withColumn("key", F.sha2(F.concat_ws("\x1f", "org", "repo", "path", "language", content_identity(F.col("content"))), 256))
    known = stored(spark, folder, ddl)
    new = keyed.join(known.select("key").distinct(), "key", "left_anti").dropDuplicates(["key"])
    scanned = scan(new.drop(*(c for c in ("file_ord",) if c in new.columns)).withColumnRenamed("key", "file_ord")).withColumnRenamed("file_ord", "key")
    scanned.withColumn("batch", F.lit(uuid.uuid4().hex)).select(*(c.split()[0] for c in ddl.split(", "))).write.mode("append").parquet(folder)
    kept = stored(spark, folder, ddl)
    once = kept.where("relation = 'file'").groupBy("key").agg(F.min("batch").alias("batch"))
    if "file_ord" in files.columns:
        given = keyed.select("key", "file_ord")
    else:
        copies = keyed.select("key").withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("key")))
        given = copies.select("key", F.concat_ws("#", "key", "copy").alias("file_ord"))
    return kept.join(once, ["key", "batch"], "left_semi").join(given, "key").select("file_ord", *(c.split()[0] for c in COLUMNS.split(", ")))


class Graph:
    """The graph of a set of files, by org, repo and path, that changes batch by batch.

    A batch scans its files only. Its declarations, before and after, are counted as multisets;
    where the counts of a name differ, files that mention the name are affected, as are those
    that import a path which came, went or declares other types. Affected files are resolved
    anew against the declarations that they may ask for; everything else keeps its results.
    Edges that an affected file has or had a part in are folded anew from their sites.

    Tables are folders below one, partitioned by batch; a row counts while its batch is the
    latest of its file (of its edge, for edges). A batch takes effect when its commit is written,
    last, as an empty file. A batch that is applied again after that changes nothing, and before
    that is written over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- tables

    def markers(self, batch: int | None = None):
        """The file system, and the folder of the commits or the file of one."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits" + ("" if batch is None else f"/{batch}"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def committed(self) -> list[int]:
        files, path = self.markers()
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path)) if files.exists(path) else []

    def commit(self, batch: int) -> None:
        files, path = self.markers(batch)
        files.create(path, True).close()

    def write(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{table}/batch={batch}")

    def every(self, table: str, ddl: str) -> DataFrame:
        """The rows of all batches that took effect, with their batch."""
        done = self.committed()
        return stored(self.spark, f"{self.folder}/{table}", f"{ddl}, batch long").where(F.col("batch").isin(done) if done else F.lit(False))

    def current(self, table: str, ddl: str, owners: str) -> DataFrame:
        """The rows whose batch is the latest that owners names for their file."""
        latest = self.every(owners, "file_ord string, alive boolean").groupBy("file_ord").agg(F.max(F.struct("batch", "alive")).alias("o")).where("o.alive").select("file_ord", F.col("o.batch").alias("batch"))
        return self.every(table, ddl).join(latest, ["file_ord", "batch"], "left_semi").drop("batch")

    def rows(self) -> DataFrame:
        return self.current("rows", ROWS, "scanned")

    # -- a batch

    def apply(self, batch: int, files: DataFrame, gone: DataFrame | None = None) -> None:
        """files: org, repo, path, language, content of new and changed files (one row each); gone: org, repo, path of files that are no more."""
        if batch in self.committed():
            return
        tables = Tables(self.spark, "batch")
        name = F.concat_ws("\x01", "org", "repo", "path").alias("file_ord")  # sorts as the three do
        new = self.write("rows", batch, scan(normalized(files).withColumn("file_ord", name)))
        named = new.where("relation = 'file'").select("file_ord", F.lit(True).alias("alive"))
        if gone is not None:
            named = named.unionByName(normalized(gone).select(name, F.lit(False).alias("alive")).distinct().join(named.select("file_ord"), "file_ord", "left_anti"))
        changed = self.write("scanned", batch, named)
        before = self.rows()
        old = tables.cut(before.join(changed, "file_ord", "left_semi"), "old")
        kept = before.join(changed.select("file_ord"), "file_ord", "left_anti")
        whole = kept.unionByName(new)

        affected = self.write("resolved", batch, self.affected(tables, old, new, kept, changed))
        part = Parsed(tables.cut(whole.join(affected.where("alive"), "file_ord", "left_semi"), "part"))
        facts = tables.cut(part.facts(), "facts")
        found = Resolved(part, facts, self.known(tables, part, Parsed(whole)), tables)
        sites = self.write("sites", batch, found.sites)
        self.write("imports", batch, found.imports.select("file_ord", "ord", "path", "line", "specifier", "language", "relative", "target_path"))
        self.write("calls", batch, found.calls.groupBy("file_ord").agg(F.count_if(F.col("target").isNull()).alias("unresolved")))
        self.write("env", batch, found.env.groupBy("file_ord").agg(F.max("rounds").alias("rounds"), F.max("bound").alias("bound")))

        site_ddl = "file_ord string, source_ref string, edge_type string, target_ref string, reason string, file string, line int"
        held = self.current("sites", site_ddl, "resolved")
        gone_sites = held.join(affected.select("file_ord"), "file_ord", "left_semi")
        touched = tables.cut(gone_sites.select(*KEY).union(sites.select(*KEY)).distinct(), "touched")
        others = held.join(affected.select("file_ord"), "file_ord", "left_anti").join(touched, KEY, "left_semi")
        folded = fold_edges(others.unionByName(sites).drop("file_ord"))
        ended = touched.join(folded.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("array<struct<file:string,line:int>>").alias("evidence"), F.lit(0).cast("long").alias("count"))
        self.write("edges", batch, folded.select(*(c.split()[0] for c in EDGES.split(", ") if not c.startswith("evidence")), "evidence").unionByName(ended))
        self.commit(batch)
        tables.drop()

    @staticmethod
    def contributions(parsed: Parsed) -> DataFrame:
        """file_ord, path, sort, name, value of everything that a file gives to the indexes.

        Of repeated returns and fields the last counts, so theirs have a number among equals of the file.
        """
        declared = parsed.declared()
        again = lambda *keys: F.row_number().over(Window.partitionBy("file_ord", *keys).orderBy("ord"))
        row = lambda df, sort, name, value: df.select("file_ord", "path", F.lit(sort).alias("sort"), name.alias("name"), value.alias("value"))
        types = declared.where("object_type = 'code_type'")
        functions = declared.where("object_type = 'code_function'")
        both = F.concat_ws("\x1f", "a", "b", "nth")
        returns = parsed.returns().withColumn("nth", again("target")).select("file_ord", "path", F.col("target").alias("a"), F.col("type").alias("b"), "nth")
        fields = parsed.fields().withColumn("nth", again("owner", "field")).select("file_ord", "path", "field", F.col("owner").alias("a"), F.col("type").alias("b"), "nth")
        return (
            row(types, "type", F.col("simple_name"), F.concat_ws("\x1f", "qualified_name", "ord"))
            .union(row(functions, "function", F.col("simple_name"), F.concat_ws("\x1f", "qualified_name", "ord")))
            .union(row(returns, "function", simple_segment(F.col("a")), both))
            .union(row(fields, "field", F.col("field"), both))
        )

    def affected(self, tables: Tables, old: DataFrame, new: DataFrame, kept: DataFrame, changed: DataFrame) -> DataFrame:
        """file_ord, alive of the files whose results this batch may change; those that are no more among them."""
        was, now = Parsed(old), Parsed(new)
        counted = self.contributions(was).withColumn("n", F.lit(-1)).union(self.contributions(now).withColumn("n", F.lit(1)))
        diff = tables.cut(counted.groupBy("file_ord", "path", "sort", "name", "value").agg(F.sum("n").alias("n")).where("n <> 0").select("path", "sort", "name").distinct(), "diff")
        names = diff.select("sort", "name").distinct()

        mentions = kept.where("relation IN ('call', 'binding', 'relation')").select(
            "file_ord",
            F.explode(
                F.array_compact(
                    F.array(
                        *(
                            F.when(when, F.struct(F.lit(sort).alias("sort"), F.col(c).alias("name")))
                            for when, sort, c in (
                                (F.col("relation") == "call", "function", "d"), ((F.col("relation") == "binding") & (F.col("c") == "call"), "function", "d"), ((F.col("relation") == "binding") & (F.col("c") == "method"), "function", "e"),
                                ((F.col("relation") == "binding") & (F.col("c") == "field"), "field", "e"), (F.col("relation") == "relation", "type", "a"), (F.col("relation") == "relation", "type", "b"),
                            )
                        )
                    )
                )
            ).alias("m"),
        )
        named = mentions.select("file_ord", "m.sort", "m.name").join(names, ["sort", "name"], "left_semi").select("file_ord")

        # paths that came or went, by any file of theirs, and paths whose types differ
        path = lambda p, n: p.files.select("file_ord", "path").withColumn("n", F.lit(n))
        moved = path(was, -1).union(path(now, 1)).groupBy("file_ord", "path").agg(F.sum("n").alias("n")).where("n <> 0").select("path").distinct()
        retyped = diff.where("sort = 'type'").select("path").union(moved).distinct()
        resolved = self.current("imports", "file_ord string, ord int, path string, line int, specifier string, language string, relative boolean, target_path string", "resolved")
        importing = resolved.join(retyped.withColumnRenamed("path", "target_path"), "target_path", "left_semi").select("file_ord")
        imports = Parsed(kept).imports()
        stems = imports.select("file_ord", family_of(F.col("language")).alias("family"), stem_of(F.col("specifier"), F.col("path"), F.col("language")).alias("stem"))
        looking = stems.join(stems_of_paths(moved).select("family", "stem").distinct(), ["family", "stem"], "left_semi").select("file_ord")
        others = named.union(importing).union(looking).distinct().join(changed.select("file_ord"), "file_ord", "left_anti")
        return changed.unionByName(others.withColumn("alive", F.lit(True)))

    @staticmethod
    def known(tables: Tables, part: Parsed, whole: Parsed) -> Known:
        """What the files of part may ask for: declarations and members of names that they mention, and types of paths in their reach."""
        calls, bindings, relations = part.calls(), part.bindings(), part.relations()
        wanted = calls.select(F.col("callee").alias("name")).union(bindings.where("kind = 'call'").select("x")).union(bindings.where("y IS NOT NULL").select("y"))
        wanted = tables.cut(wanted.union(relations.select("child")).union(relations.select("parent")).distinct(), "wanted")
        files = whole.files
        stems = part.imports().select(family_of(F.col("language")).alias("family"), stem_of(F.col("specifier"), F.col("path"), F.col("language")).alias("stem")).where("stem IS NOT NULL").distinct()
        reach = module_index(files.select("path")).join(stems, ["family", "stem"], "left_semi").select(F.col("target_path").alias("path")).union(part.files.select("path")).distinct()
        declared = tables.cut(whole.declared(), "declared")
        of_names = declared.join(wanted.withColumnRenamed("name", "simple_name"), "simple_name", "left_semi")
        in_reach = declared.where("object_type = 'code_type'").join(reach, "path", "left_semi")
        types = types_of(of_names.unionByName(in_reach).dropDuplicates(["file_ord", "ord"]))
        returns = whole.returns().withColumn("name", simple_segment(F.col("target"))).join(wanted, "name", "left_semi").drop("name")
        fields = whole.fields().join(wanted.withColumnRenamed("name", "field"), "field", "left_semi").drop("path").join(files.select("file_ord", "org", "repo", "path"), "file_ord")
        return Known(types, methods_of(of_names), functions_of(of_names), returns, fields, files)

    # -- results

    def edges(self) -> DataFrame:
        values = [c for c in ("confidence", "reason", "evidence", "count")]
        latest = self.every("edges", EDGES).groupBy(*KEY).agg(F.max_by(F.struct(*values), "batch").alias("e")).where("e.count > 0")
        return latest.select(*KEY, *(f"e.{c}" for c in values))

    def changed_edges(self, batch: int) -> DataFrame:
        """The edges that a batch made new or otherwise; those of count 0 are no more."""
        return self.every("edges", EDGES).where(F.col("batch") == batch).drop("batch")

    def extraction(self) -> Extraction:
        parsed = Parsed(self.rows())
        imports = self.current("imports", "file_ord string, ord int, path string, line int, specifier string, language string, relative boolean, target_path string", "resolved")
        diagnostics = parsed.diagnostics().unionByName(warnings_of(imports))
        open_calls = self.current("calls", "file_ord string, unresolved long", "resolved")
        env = self.current("env", "file_ord string, rounds int, bound boolean", "resolved")
        none = F.lit(None).cast("string")
        stats = stats_of(parsed.files, diagnostics, open_calls.limit(0).select(none.alias("target")), env).drop("unresolved_calls")
        counted = stats.crossJoin(open_calls.agg(F.coalesce(F.sum("unresolved"), F.lit(0)).cast("int").alias("unresolved_calls")))
        return Extraction(nodes_of(parsed.facts()), self.edges(), harvest(parsed.comments()).drop("file_ord"), diagnostics, counted.select("files", "files_with_errors", "unresolved_calls", "max_fixpoint_iterations", "files_hitting_iteration_bound"))


def follow(files: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query over arriving files (of a path that comes again, the batch's last by content hash is taken): each batch changes the graph in folder, and its changed edges go to sink(edges, batch_id)."""
    graph = Graph(files.sparkSession, folder)

    def each(batch: DataFrame, batch_id: int) -> None:
        one = normalized(batch).groupBy("org", "repo", "path").agg(F.max_by(F.struct("language", "content"), F.sha2("content", 256)).alias("f"))
        graph.apply(batch_id, one.select("org", "repo", "path", "f.language", "f.content"))
        sink(graph.changed_edges(batch_id), batch_id)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
