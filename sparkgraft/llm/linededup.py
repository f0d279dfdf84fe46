"""Line de-duplication by distinct-site spread.

Every line is hashed (128 bits). Spark merges two HyperLogLog sketches per hash: one of the
sites (sources) it stands on, one of the whole texts it stands in. A line is boilerplate if it
stands on at least `min_sites` distinct sites and in as many distinct texts: exact copies of one
document that is mirrored from site to site count as one text, and are left to document
de-duplication. Nothing else decides, neither neighbours nor length. Lines whose estimates lie
within `margin` of the bound get exact distinct counts instead.

Documents are cut into lines once, and again when lines are removed. Sketches are merged
map-side, so a line that stands in a third of all documents is one small row per task.
Boilerplate hashes are broadcast while they are few, and else joined to the documents that hold
them.

Defined results: lines are separated by \\n and compared without outer white space (space and
\\t-\\r); blank lines always stay, as do lines of fewer than `min_chars` characters if that is set;
a null text stays null and an empty one empty; a null source counts as one site of its own;
every occurrence of a boilerplate line goes, also in repeated rows; a document may end up empty
but no row goes; an empty table gives no rows; all columns of the input are kept, whatever
their names, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, lean

WHITE = " \t\n\r\x0b\x0c"


def key_of(line: str) -> bytes:
    return xxhash.xxh128_digest(line.encode("utf-8", "surrogatepass"))


def keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A key for each line, None for those that always stay."""
    return [key_of(s) if len(s := x.strip(WHITE)) >= max(1, min_chars) else None for x in (text or "").split("\n")]


def lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that may go: its key, its site, a hash of the whole text and the doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sites, texts, docs = [], [], [], []
            for site, text, doc in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = text.as_py()
                own = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63
                held = [k for k in keys(text, min_chars) if k is not None]
                found += held
                sites += [site] * len(held)
                texts += [own] * len(held)
                docs += [doc] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sites, pa.string()), pa.array(texts, pa.int64()), pa.array(docs, pa.int64())], ["line", "site", "text", "doc_id"])

    site = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(site.alias("site"), "text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(lean(run), "line binary, site string, text long, doc_id long")


def boilerplate(spark: SparkSession, docs: DataFrame, min_sites: int = 8, min_chars: int = 1, margin: float = 1.5, lg_k: int = 8) -> DataFrame:
    """line (the key) of each boilerplate line, the sites and texts it stands on and in (estimates if far from the bound), and its home: the least doc_id that holds it."""
    scratch = Scratch(spark, "lines")
    rows = scratch.cut(lines(docs, min_chars), "rows")
    sketched = rows.groupBy("line").agg(
        F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.hll_sketch_estimate(F.hll_sketch_agg("text", lg_k)).alias("texts"), F.min("doc_id").alias("home")
    )
    least = F.least("sites", "texts")
    spread = scratch.cut(sketched.where((F.col("n") >= min_sites) & (least >= min_sites / margin)), "spread")
    sure = spread.where(least > min_sites * margin)
    counted = rows.join(spread.where(least <= min_sites * margin).select("line"), "line", "left_semi")
    by_site = counted.groupBy("line", "site").count().groupBy("line").agg(F.count("*").alias("sites"))
    by_text = counted.groupBy("line", "text").count().groupBy("line").agg(F.count("*").alias("texts"))
    exact = by_site.join(by_text, "line").where(F.least("sites", "texts") >= min_sites).join(spread.select("line", "home"), "line")
    return sure.select("line", "sites", "texts", "home").union(exact.select("line", "sites", "texts", "home"))


def drop_lines(spark: SparkSession, docs: DataFrame, few_lines: int = 200_000, min_chars: int = 1, keep_home: bool = False, **options) -> DataFrame:
    """docs with their boilerplate lines removed; adds n_lines and n_removed (replacing columns of these names).

    keep_home: a line stays in its home, the rows of the least doc_id that holds it, so that each
    stands somewhere and a group of near copies on many sites keeps its text once.
    """
    scratch = Scratch(spark, "lines")
    gone = scratch.cut(boilerplate(spark, docs, min_chars=min_chars, **options).select("line", "home"), "boilerplate")
    docs = docs.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")))
    own, same = fresh(docs, "own"), fresh(docs, "same")
    if gone.limit(few_lines + 1).count() <= few_lines:
        shared = spark.sparkContext.broadcast({bytes(r["line"]): r["home"] for r in gone.collect()})
        given = docs.withColumn(own, F.lit(None).cast("array<struct<line:binary,home:long>>"))
    else:
        shared = None
        with_id = docs.withColumn(same, F.xxhash64("text"))
        held = with_id.where("text IS NOT NULL").select(F.col(same).alias("same"), "text").mapInArrow(lean(explode_keys(min_chars)), "same long, line binary").join(gone, "line")
        sets = held.distinct().groupBy(F.col("same").alias(same)).agg(F.collect_list(F.struct("line", "home")).alias(own))
        given = with_id.join(sets, same, "left").drop(same)
    ids = given.columns.index("doc_id")
    at = given.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, totals, removed = [], [], []
            for doc, text, held in zip(b.column(ids).to_pylist(), b.column(at), b.column(b.num_columns - 1), strict=True):
                drop = shared.value if shared is not None else {x["line"]: x["home"] for x in held.as_py() or ()}
                text = text.as_py()
                split = (text or "").split("\n")
                kept = [x for x, k in zip(split, keys(text, min_chars), strict=True) if k not in drop or keep_home and doc is not None and drop[k] == doc]
                texts.append("\n".join(kept) if text is not None else None)
                totals.append(len(split))
                removed.append(len(split) - len(kept))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], [*b.schema.names[:-1], "n_lines", "n_removed"])

    return given.mapInArrow(lean(run), schema)


def explode_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(i, k) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for k in set(keys(t.as_py(), min_chars)) if k is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([k for _, k in pairs], pa.binary())], ["same", "line"])

    return run
