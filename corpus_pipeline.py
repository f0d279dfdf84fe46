"""The training-corpus pipeline: documents in, packed sequences out.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns
a DataFrame; it is written as Parquet in the shared folder and read again as the next one's
docs. All but the last return the columns of `documents`. The rows after packing are the
result. ORACLE_SQL is None: the classifier and the tokenizer can't be expressed in SQL, so the
pipeline is tested against brute force.

The classifier and decontamination judge each row on its own, whatever its id. Near-dedup takes
a doc_id for one vertex: rows that repeat one are judged together, one row of each text stays,
and rows without an id all stay. Null and empty texts pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgraft.llm import decontam, linededup, neardup, packing, quality
from sparkgraft.llm.common import Scratch, table, without
from sparkgraft.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    scored = quality.score(spark, docs, table(spark, sf_dir, "labels"))
    rejected = Scratch(spark, "rejected").cut(scored.where("NOT kept").select("doc_id", "row_key"), "rows")
    return without(docs, rejected)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites, in more than copies of one text, go from all documents but their home; n_chars follows the text.

    So of near copies on many sites, which share most lines, one is whole when near-dedup looks at them.
    """
    done = linededup.drop_lines(spark, docs, keep_home=True)
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    found = Scratch(spark, "kept").cut(neardup.near_duplicates(spark, docs).select("doc_id", "kept"), "ids")
    left = without(docs, found.where("NOT kept").select("doc_id"))
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.limit(1).count():
        left = without(left, again).unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
    return left


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean_documents(spark, docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences, by tier."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{i}")
        if i > 1:
            scratch.drop(f"stage{i - 2}")
    return docs
