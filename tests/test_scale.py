"""What keeps queries whole on large tables: work dealt out, done once, and only where it is asked for."""

import pytest
from pyspark.sql import functions as F

from sparkgraft.operators import imports
from sparkgraft.operators.edges import fold_edges
from sparkgraft.operators.fingerprint import differing_rows
from sparkgraft.plans.extract import extract
from sparkgraft.plans.queries import QUERIES
from sparkgraft.sources import corpora
from sparkgraft.sources.scratch import Tables


@pytest.mark.parametrize(("corpus", "key"), [("rust_corpus", "p_partkey"), ("heirs_corpus", "c_custkey"), ("typescript_corpus", "c_custkey"), ("tsx_corpus", "c_custkey"), ("python_corpus", "s_suppkey")])
def test_a_table_in_one_piece_gives_a_corpus_in_many(spark, corpus, key):
    table = spark.range(3 * corpora.DEALT).withColumnRenamed("id", key).coalesce(1)
    files = getattr(corpora, corpus)(table)
    assert files.select(F.spark_partition_id()).distinct().count() == 3
    assert files.count() == files.select("path").distinct().count() == 3 * corpora.DEALT


def test_members_of_types_come_from_one_scan(spark):
    assert "MapInArrow" not in QUERIES["member_types"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


@pytest.mark.parametrize(("relation", "written"), [("nodes", {"rows", "facts"}), ("mentions", {"rows", "mentions"}), ("diagnostics", {"rows", "imports"})])
def test_a_relation_takes_only_what_it_needs(spark, monkeypatch, relation, written):
    names = set()
    cut = Tables.cut
    monkeypatch.setattr(Tables, "cut", lambda self, df, name: names.add(name) or cut(self, df, name))
    assert getattr(extract(corpora.rust_corpus(spark.range(3).withColumnRenamed("id", "p_partkey"))), relation).count()
    assert names == written


def test_imports_meet_their_index_without_a_broadcast(spark):
    found = QUERIES["import_resolution"](spark, "/root/testdata/sf0.001")
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_segments_of_rust_paths(spark):
    cases = [("crate::a::b::T", "src/m.rs", "src/a/b"), ("self::_x::y", "src/d/m.rs", "src/d/_x/y"), ("super::a", "src/d/e/m.rs", "src/d/a"), ("super::super::a", "d/m.rs", "super/a"), ("crate::*", "src/m.rs", None), ("crate", "src/m.rs", None), ("crate::::a::*::b::T::c", "x/src/m.rs", "x/src/a/b"), ("self::a", "m.rs", "a"), ("crate::T::a", "src/m.rs", None), ("std::a", "src/m.rs", None), (None, "src/m.rs", None)]
    df = spark.createDataFrame(cases, "s string, p string, want string")
    assert [(r.s, r.got) for r in df.select("*", imports.rust_stem(F.col("s"), F.col("p")).alias("got")).collect() if r.got != r.want] == []


def test_differences_in_most_groups_end_the_bisection(spark, monkeypatch):
    names = []
    cut = Tables.cut
    monkeypatch.setattr(Tables, "cut", lambda self, df, name: names.append(name) or cut(self, df, name))
    left = spark.range(40_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("v")).union(spark.createDataFrame([(1, None)] * 5, "id long, v long"))
    right = left.withColumn("v", F.when(F.col("id") % 20 == 0, -1).otherwise(F.col("v"))).where("id > 1 OR v IS NOT NULL")
    got = differing_rows(left, right, few=100)
    assert len([n for n in names if n.startswith("level")]) <= 6
    want = left.exceptAll(right).selectExpr("'left' AS side", "*").union(right.exceptAll(left).selectExpr("'right' AS side", "*"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 4000


def test_sites_are_counted_without_a_sort(spark, monkeypatch):
    plans = []
    cut = Tables.cut
    monkeypatch.setattr(Tables, "cut", lambda self, df, name: plans.append(df._jdf.queryExecution().toString()) or cut(self, df, name))
    rows = [("a", "calls", "b", r, "f", i) for i, r in enumerate(("name-match", "path-resolved", "explicit-mention", "syntactic", "receiver-typed"))]
    edge, = fold_edges(spark.createDataFrame(rows, "source_ref string, edge_type string, target_ref string, reason string, file string, line int")).collect()
    assert (edge.reason, edge.confidence, edge["count"]) == ("syntactic", 1.0, 5)
    assert len(plans) == 1 and "SortAggregate" not in plans[0]


def test_stats_take_no_facts_imports_or_mentions(spark, monkeypatch):
    names = set()
    cut = Tables.cut
    monkeypatch.setattr(Tables, "cut", lambda self, df, name: names.add(name) or cut(self, df, name))
    assert extract(corpora.rust_corpus(spark.range(3).withColumnRenamed("id", "p_partkey"))).stats.first()["unresolved_calls"] == 0
    assert {"rows", "types", "calls"} <= names and not names & {"facts", "imports", "mentions"}
