import random
from collections import defaultdict

import pytest

from sparkgraft.llm import linededup


WHITE = " \t\n\r\x0b\x0c"


def brute(rows, min_sites, min_chars):
    sites, texts = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        for x in (text or "").split("\n"):
            x = x.strip(WHITE)
            if len(x) >= min_chars:
                sites[x].add(source)
                texts[x].add(text)
    gone = {x for x in sites if len(sites[x]) >= min_sites and len(texts[x]) >= min_sites}
    return sorted((i or 0, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(WHITE) not in gone)) for i, t, _ in rows)


def corpus(seed):
    r = random.Random(seed)
    common = [f"boilerplate line number {i} of the site" for i in range(12)]
    common[3:5] = ["Share", "\xa0Menu\x85"]
    rows = []
    for i in range(400):
        own = [f"line {r.random()} of a document" for _ in range(r.randrange(1, 6))]
        for _ in range(r.randrange(3)):
            own.insert(r.randrange(len(own) + 1), r.choice(["  ", "", "\x0b"]) + common[min(11, int(r.expovariate(0.4)))])
        rows.append((i, "\n".join(own), r.choice([None, *"abcdefghijkl"])))
    mirrored = rows[0][1] + "\nand a last line that is mirrored too"
    return rows + [(1000 + i, mirrored, "abcdefghijkl"[i % 12]) for i in range(36)]


@pytest.mark.parametrize(("seed", "few"), [(1, 1000), (2, 0)])
def test_against_brute_force(spark, seed, few):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = linededup.drop_lines(spark, df, few_lines=few, min_sites=5)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    got = got.collect()
    want = brute(rows, 5, 1)
    assert sorted((r.doc_id, r.text) for r in got) == want
    assert sum(r.n_removed for r in got) > 100 and {r.text for r in got if r.doc_id >= 1000} == {next(t for i, t in want if i == 1000)}
    assert next(t for i, t in want if i == 1000).endswith("mirrored too")


def test_edges(spark):
    line = "the very same line on every site"
    rows = [(i, f"{line}\nown {i} {'x' * 20}\n{line}", f"s{i}") for i in range(9)] + [(90, None, "s1"), (91, "", None), (None, line, "s2"), (92, "short\n\nshort", "s3"), (93, "y" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n_lines", "2 AS line", "3 AS own", "4 AS same", "5 AS __gone", "6 AS SAME_")
    for few in (100, 0):
        got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.drop_lines(spark, df, few_lines=few).collect()}
        assert got[3] == (f"own 3 {'x' * 20}", 3, 2) and got[90] == (None, 1, 0) and got[91] == ("", 1, 0)
        assert got[None] == ("", 1, 1) and got[92] == ("short\n\nshort", 3, 0) and got[93][2] == 0
        assert linededup.drop_lines(spark, df, few_lines=few).columns == ["doc_id", "text", "source", "line", "own", "same", "__gone", "SAME_", "n_lines", "n_removed"]
    assert linededup.drop_lines(spark, df.limit(0)).count() == 0


def test_a_block_goes_whole(spark):
    block = "\n".join(f"inner line {c} of one notice on all the sites" for c in "abcde")
    alone = "a notice that stands between two blank lines"
    bound = "a line that stands on seven sites and no more"
    mirrored = "the first line of a mirrored document\nand the second line of the same document"
    own = [f"line {i} of this document and of no other" for i in range(300)]
    rows = [(i, f"{x}\n{block}\n\n{alone}\n\n{bound if i % 20 < 7 else ''}", "en", f"s{i % 20}", 1) for i, x in enumerate(own)]
    rows += [(1000 + i, mirrored, "en", f"s{i % 20}", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r for r in linededup.drop_lines(spark, docs).collect()}
    assert len(left) == 360 and all(left[i].text == f"{x}\n\n\n{bound if i % 20 < 7 else ''}" for i, x in enumerate(own))
    assert all(left[1000 + i].text == mirrored for i in range(60))
