"""Source trees: listed folder by folder on the executors, and read there.

A round lists the folders that the last one found; the driver holds only whether there are any.
Any URI that Arrow's file systems know may be the root. Links are skipped; of the file systems,
only local ones have them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import language_of_path
from .scratch import Tables

# Folders that hold no sources of their own, and endings that do.
SKIPPED = ("target", "node_modules")
ENDINGS = (".rs", ".ts", ".mts", ".cts", ".tsx", ".py", ".pyi")


def list_tree(root: str) -> tuple[list[str], list[str]]:
    """Supported files below a local root, by a plain walk, and folders that can't be read. Links, dot names and build folders are skipped. Tests hold list_folders against it."""
    found, unreadable, todo = [], [], [root]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            unreadable.append(folder)
            continue
        for entry in entries:
            if entry.name.startswith(".") or entry.name in SKIPPED or entry.is_symlink():
                continue
            if entry.is_dir(follow_symlinks=False):
                todo.append(entry.path)
            elif entry.name.endswith(ENDINGS):
                found.append(entry.path)
    return sorted(found), unreadable


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose bytes are UTF-8, as text, and the paths of the others. files: path, content (binary)."""
    text = F.col("content").cast("string")
    good = files.where(F.is_valid_utf8(text)).withColumn("content", text)
    return good, files.where(~F.is_valid_utf8(text)).select("path")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, the session's default if it names none."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(held).toString().rstrip("/")


def entries_of(folder: str) -> Iterator[tuple[str, str]]:
    """(path, kind) of what a folder holds that may be listed; kind is folder, file or, for itself, unreadable."""
    try:
        fs, place = file_system(folder)
        if isinstance(fs, pafs.LocalFileSystem):
            held = [(e.name, e.is_dir(follow_symlinks=False)) for e in os.scandir(place) if not e.is_symlink()]
        else:
            held = [(e.base_name, e.type == pafs.FileType.Directory) for e in fs.get_file_info(pafs.FileSelector(place))]
    except OSError:
        yield folder, "unreadable"
        return
    for name, is_folder in held:
        if not name.startswith(".") and name not in SKIPPED and (is_folder or name.endswith(ENDINGS)):
            yield f"{folder}/{name}", "folder" if is_folder else "file"


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """path, kind (file or unreadable) of everything below root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = list(entries_of(folder))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.string())], ["path", "kind"])

    tables = Tables(spark, "listing")
    top = qualified(spark, root)
    folders = spark.createDataFrame([(top,)], "path string")
    listed, step = spark.createDataFrame([], "path string, kind string"), 0
    while True:
        found = tables.cut(folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, kind string"), f"round{step}")
        listed = listed.union(found.where("kind <> 'folder'"))
        folders, step = found.where("kind = 'folder'").select("path"), step + 1
        if not folders.limit(1).count():
            return listed


def contents(paths: DataFrame) -> DataFrame:
    """path, content (binary, null if it can't be read) of files, read where their rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    fs, place = file_system(path)
                    with fs.open_input_file(place) as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], ["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content binary")


def read_tree(spark: SparkSession, root: str, org: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """The files of a tree (org, repo, path, language, content), and the paths that could not be read."""
    listed = list_folders(spark, root)
    top = qualified(spark, root)
    raw = contents(listed.where("kind = 'file'").repartition(spark.sparkContext.defaultParallelism))
    good, bad = decoded(raw.where("content IS NOT NULL"))
    inside = F.substring("path", len(top) + 2, 1_000_000)
    files = good.select(F.lit(org).alias("org"), F.lit(repo).alias("repo"), inside.alias("path"), language_of_path(inside).alias("language"), "content")
    lost = listed.where("kind = 'unreadable'").select("path").union(raw.where("content IS NULL").select("path")).union(bad)
    return files, lost


def population(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """files, supported, unreadable, unsupported and state of each population. files: path, readable and the columns of by.

    Only files below (or named) input or variant count; of these, those with one of four endings
    are supported, and only supported files can be unreadable (a null says so). A null path does not count.
    """
    inside = F.coalesce(F.col("path").rlike(r"(^|/)(input|variant)(/|\z)"), F.lit(False))
    supported = inside & F.col("path").rlike(r"[^/]\.(rs|ts|tsx|py)\z")
    counts = files.groupBy(*by).agg(
        F.count_if(inside).alias("files"), F.count_if(supported).alias("supported"),
        F.count_if(supported & ~F.coalesce("readable", F.lit(False))).alias("unreadable"), F.count_if(inside & ~supported).alias("unsupported"),
    )
    state = F.when(F.col("files") == 0, "empty").when(F.col("unreadable") > 0, "unreadable").when(F.col("supported") == 0, "unsupported").otherwise("measured")
    return counts.withColumn("state", state)


def census(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """files, supported, unreadable and state of each population, wherever its files lie; one file that isn't supported marks it. files: path, readable and the columns of by."""
    supported = language_of_path(F.col("path")).isNotNull()
    counts = files.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(supported).alias("supported"), F.count_if(~F.col("readable")).alias("unreadable"))
    state = F.when(F.col("files") == 0, "empty").when(F.col("unreadable") > 0, "unreadable").when(F.col("supported") < F.col("files"), "unsupported").otherwise("measured")
    return counts.withColumn("state", state)
