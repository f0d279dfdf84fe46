from pyspark.sql import functions as F

from sparkgraft.llm.common import by_hash, fresh, row_key, without


def test_by_hash_takes_the_smallest_hashes(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    for most in (10, 4990, 5000, 6000):
        got = {r.doc_id for r in by_hash(rows, "doc_id", most).collect()}
        assert got == {r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(most).collect()} and len(got) == min(most, 5000)


def test_without_is_safe_for_nulls(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id long, text string")
    gone = docs.withColumn("row_key", row_key(docs)).where("text IN ('b', 'c')").select("doc_id", "row_key")
    for few in (100, 0):
        assert sorted((r.doc_id or 0, r.text or "") for r in without(docs, gone, few).collect()) == [(0, ""), (1, "a")]
        assert [r.doc_id for r in without(docs, gone.select("doc_id").where("doc_id IS NOT NULL"), few).collect()] == [None, None]


def test_fresh_names(spark):
    assert fresh(spark.createDataFrame([(1, 2)], "Own int, own_ int"), "own") == "own__"


def test_without_takes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 9, "k"), (2, "b", 9, "k")], "doc_id long, text string, gone_doc_id long, Gone_Row_Key string")
    gone = docs.withColumn("row_key", row_key(docs)).where("doc_id = 1").select("doc_id", "row_key")
    assert [r.doc_id for r in without(docs, gone).collect()] == [2]
