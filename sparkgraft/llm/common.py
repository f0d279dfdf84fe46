"""Helpers shared by the operators: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts. Arrow batches are bounded by bytes, as rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives memory that it no longer uses back to the machine: workers live on from stage to stage."""

    def then_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc offers it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return then_give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only in local mode, as in tests, a folder of this machine is taken where that is unset.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without is of the session's default file system, wherever it is opened."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(held).toString()


def row_key(docs: DataFrame) -> Column:
    """A hash of a whole row: equal rows have equal keys."""
    return F.xxhash64(*docs.columns)


def without(docs: DataFrame, gone: DataFrame, few: int = 1_000_000) -> DataFrame:
    """The rows of docs that gone doesn't name by doc_id, or by doc_id and row_key if it has one; gone is broadcast while it is small, so that texts needn't move."""
    names = {c: fresh(docs, f"gone_{c}") for c in gone.columns}
    gone = gone.select(*(F.col(c).alias(name) for c, name in names.items())).distinct()
    if gone.limit(few + 1).count() <= few:
        gone = F.broadcast(gone)
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"]))
    if "row_key" in names:
        same &= row_key(docs) == F.col(names["row_key"])
    return docs.join(gone, same, "left_anti")


def by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many rows, those with the smallest hashes of their key; far more are left out by a bound on the hash before any are sorted."""
    n = rows.count()
    if n <= most:
        return rows
    at_most = min(1.0, (most + 8 * most**0.5 + 8) / n)
    few = rows.where(F.xxhash64(key) <= F.lit(min(2**63 - 1, int(-(2**63) + at_most * 2**64))))
    return few.orderBy(F.xxhash64(key), key).limit(most)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class Scratch:
    """Written tables of one run, under one fresh folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back, so that a lost executor costs a read, not a recomputation."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
