import random

import pytest

from sparkgraft.front.parse import Parsed, scan
from sparkgraft.operators.structure import compose_names, own_comments, structural_errors

FILES = "org string, repo string, path string, language string, content string"


def plain_names(rows):
    """Depth first, with a counter for each (parent's name, kind)."""
    out, counters, names = {}, {}, {}
    for file, ord_, up, ref, kind, name, named in sorted(rows):
        below = names[file, up] if up is not None else ref
        if name is None and kind is not None:
            n = counters.get((file, below, kind), 0)
            counters[file, below, kind] = n + 1
            name = f"<{kind}#{n}>"
        out[file, ord_] = f"{below}::{name}"
        names[file, ord_] = out[file, ord_] if named else below
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_names_equal_a_walk(spark, seed):
    pick = random.Random(seed)
    rows = []
    for f in range(4):
        for i in range(60):
            up = pick.choice([None, *range(max(0, i - 6), i)])
            kind = pick.choice(["function", "class", None])
            rows.append((f, i, up, f"o/r/f{f}", kind, pick.choice(["a", "b", None]) if kind else pick.choice("xy"), pick.random() < 0.9))
    df = spark.createDataFrame(rows, "file_ord long, ord int, up int, file_ref string, kind string, name string, named boolean")
    assert {(r.file_ord, r.ord): r.qualified_name for r in compose_names(df).collect()} == plain_names(rows)


def test_names_of_a_deep_chain(spark):
    rows = [(1, i, i - 1 if i else None, "f", "class", None, True) for i in range(70)]
    got = compose_names(spark.createDataFrame(rows, "file_ord long, ord int, up int, file_ref string, kind string, name string, named boolean"))
    assert got.where("ord = 69").first().qualified_name == "f" + "::<class#0>" * 70


def test_comments_own_the_next_declaration_of_their_frame(spark):
    rows = [
        (1, 0, 0, "inner", "file"), (1, 0, 1, "comment", "file"), (1, 0, 2, "import", None), (1, 0, 3, "comment", "file"), (1, 0, 4, "declaration", "a"),
        (1, 1, 5, "comment", "a"), (1, 1, 6, "other", None), (1, 1, 7, "comment", "a"), (1, 0, 8, "comment", "file"), (1, 0, 9, "other", None), (1, 0, 10, "declaration", "b"), (1, 0, 11, "comment", "file"),
    ]
    got = {r.ord: r.owner for r in own_comments(spark.createDataFrame(rows, "file_ord long, frame int, ord int, sort string, name string")).collect()}
    assert got == {0: "file", 1: "a", 3: "a", 5: "a", 7: "a", 8: "file", 11: "file"}


def test_structural_errors_against_every_span(spark):
    pick, spans, errors = random.Random(4), [], []

    def nest(file, low, high, depth):
        at = low
        while at + 4 < high and depth:
            start = pick.randrange(at, high - 3)
            stop = pick.randrange(start + 3, high)
            body = pick.choice([None, pick.randrange(start + 1, stop)])
            spans.append((file, start, stop, body))
            nest(file, start + 1, stop - 1, depth - 1)
            at = stop + 1

    for f in range(6):
        nest(f, 0, 9000, 4)
        errors += [(f, pick.randrange(9500)) for _ in range(5)] if f else []
    want = {}
    for f, at in errors:
        inside = [s for s in spans if s[0] == f and s[1] <= at < s[2]]
        d = max(inside, key=lambda s: (s[1], -s[2]), default=None)
        want.setdefault(f, []).append((at, d is None or d[3] is None or at < d[3]))
    got = structural_errors(spark.createDataFrame(spans, "file_ord long, start int, stop int, body int"), spark.createDataFrame(errors, "file_ord long, at int"), bin_size=64)
    assert {r.file_ord: (r.errors, r.at) for r in got.collect()} == {f: (len(set(x)), min((a for a, s in x if s), default=None)) for f, x in want.items()}


def test_files_that_fail_only_in_a_body_stay_usable(spark):
    cases = {
        "body.rs": ("rust", "fn a() { let x = (1; }\nfn b() {}\n", True), "open.rs": ("rust", "fn b() {}\nfn a() { x();\n", True), "signature.rs": ("rust", "fn a(x: (u8) {}\n", False), "struct.rs": ("rust", "struct S { a: [u8 }\n", False),
        "top.ts": ("typescript", "f(];\n", False), "method.ts": ("typescript", "class A {\n  m(): void { f([); }\n}\n", True), "class.ts": ("typescript", "class A {\n  m(): void { f(1); }\n  x = (;\n}\n", False), "arrow.ts": ("typescript", "const f = (x) => g(x];\n", True),
        "body.py": ("python", "def a():\n    x = (1\n", True), "top.py": ("python", "x = (1\n", False), "class.py": ("python", "class A:\n    x = ]\n", False), "good.py": ("python", "x = 1\n", None),
    }
    rows = scan(spark.createDataFrame([("o", "r", p, language, text) for p, (language, text, _) in cases.items()], FILES).coalesce(1))
    got = {r.path: r.at is None for r in Parsed(rows).structure().collect()}
    assert got == {p: usable for p, (_, _, usable) in cases.items() if usable is not None}
