import re
from fractions import Fraction

import pytest

from sparkgraft.llm.common import table

from .test_decontam import hidden_pair as beyond_the_radius
from .test_neardup import hidden_pair

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark, tmp_path):
    docs, seen = table(spark, SF, "documents"), {}
    columns = docs.columns
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in table(spark, SF, "benchmark").collect()]
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = (before, {r.doc_id: r for r in docs.collect()})
    before, after = seen["quality classifier"]
    assert all(i in after for i in before if quality.get(i) == 1)
    assert sum(i in after for i in before if quality.get(i) == 0) <= 2
    before, after = seen["line dedup"]
    assert set(before) == set(after) and all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
    before, after = seen["benchmark decontamination"]
    leaked = {i for i, r in before.items() if any(x in " ".join(re.findall(r"\w+", (r.text or "").lower())) for x in items)}
    assert leaked and not leaked & set(after) and set(before) - leaked == set(after)
    before, after = seen["packing"]
    assert set(before) == set(after)


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text, "en", "a", 1), (2, text + " x", "en", "b", 1), (1, text, "en", "a", 1), (3, "quite another text of more than five words", "en", "a", 1), (None, text, None, None, None), (4, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_stage(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4]


def test_near_stage_against_brute_force(spark):
    """Five words and 0.8 over every pair of whole texts: the least id of each component stays, all else goes."""
    docs = table(spark, SF, "documents")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    left = corpus_pipeline.near_stage(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in left) == [i for i in ids if find(i) == i]
    assert len(left) < len(ids)


def test_line_stage_against_brute_force(spark):
    """A line on eight sites and in eight different texts goes from every row but those of the least doc_id that holds it."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    white = " \t\n\r\x0b\x0c"
    sites, texts, home = {}, {}, {}
    for i, r in rows.items():
        for line in (r.text or "").split("\n"):
            if k := line.strip(white):
                sites.setdefault(k, set()).add(r.source)
                texts.setdefault(k, set()).add(r.text)
                home[k] = min(i, home.get(k, i))
    gone = {k for k in sites if len(sites[k]) >= 8 and len(texts[k]) >= 8}
    want = {i: "\n".join(x for x in (r.text or "").split("\n") if x.strip(white) not in gone or home[x.strip(white)] == i) if r.text is not None else None for i, r in rows.items()}
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, SF).collect()}
    assert gone and got == want


def test_near_copies_on_many_sites_keep_one_whole_text(spark):
    lines = [" ".join(f"line{i}word{j}" for j in range(30)) for i in range(6)]
    rows = [(i, "\n".join([*lines, f"only in copy {i}"]), "en", f"site{i}", 1) for i in range(1, 10)] + [(20, "a clean text of its own that stays as it is", "en", "site1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = corpus_pipeline.line_stage(spark, docs, SF)
    left = {r.doc_id: r.text for r in corpus_pipeline.near_stage(spark, after, SF).collect()}
    assert left[1] == rows[0][1] and left[20] == rows[9][1]
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.doc_id not in (1, 20))


def test_stages_on_an_empty_table_and_with_clashing_columns(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "doc_id AS gone_doc_id", "1 AS gone_row_key", "2 AS own", "3 AS same", "4 AS label", "5 AS row_key_")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), SF).count() == 0


def test_packing_stage_holds_every_token_once(spark):
    """Pieces of a document are gapless, and sequences are filled without gaps or overlaps."""
    docs = table(spark, SF, "documents")
    pieces = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == {r.doc_id for r in docs.collect()}
    for held in by_doc.values():
        at = 0
        for start, length, _ in sorted(held):
            assert start == at
            at += length
        assert {t for _, _, t in held} == {at}
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_near_stage_links_a_pair_that_shares_no_band(spark):
    first, text = hidden_pair(5, Fraction(80, 100))
    rows = [(1, "another text of some words", "en", "a", 1), (2, first, "en", "a", 1), (3, text, "en", "b", 1), (4, first + " y", "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()) == [1, 2]


def test_decontamination_stage_drops_a_passage_beyond_the_radius(spark, tmp_path):
    item, text = beyond_the_radius()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, text, "en", "a", 1), (2, "a clean text of its own words", "en", "a", 1), (3, f"before it {text} and after", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()] == [2]
