import json
import os

import pytest
from pyspark.sql import functions as F

from sparkgraft.cli import main
from sparkgraft.front.parse import scan
from sparkgraft.front.scanner import Scan, simple_type
from sparkgraft.functions import naming
from sparkgraft.functions.naming import is_exported
from sparkgraft.operators import imports, measurement, mentions, selection
from sparkgraft.operators.corpus import batch_order, place_in_group
from sparkgraft.operators.edges import fold_edges
from sparkgraft.operators.typeenv import Row, solve
from sparkgraft.plans.select import extract_selected
from sparkgraft.sources.tree import list_tree, population, read_tree
from sparkgraft.streaming.incremental import scan_with_cache

FILES = "org string, repo string, path string, language string, content string"


def test_evidence_is_distinct_sorted_and_cut(spark):
    rows = [("a", "calls", "b", "name-match" if i % 2 else "receiver-typed", f"f{i % 31:02}", 1) for i in range(62)] + [("a", "calls", "a", "name-match", "f", 1)]
    edge, = fold_edges(spark.createDataFrame(rows, "source_ref string, edge_type string, target_ref string, reason string, file string, line int")).collect()
    assert edge["count"] == 62 and edge.confidence == 0.9 and edge.reason == "receiver-typed"
    assert [e.file for e in edge.evidence] == [f"f{i:02}" for i in range(20)]


def test_paths(spark):
    cases = {"./a//b/": "a/b", "././x\\y": "x/y", "a": "a", "": "", "/r": "/r"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want string")
    assert df.where(naming.normalize_path(F.col("p")) != F.col("want")).count() == 0
    joined = spark.createDataFrame([("a/b", "../c", "a/c"), ("", "./x", "x"), ("a", "../../x", None), ("a", "..", "")], "d string, s string, want string")
    assert joined.where(~naming.join_relative(F.col("d"), F.col("s")).eqNullSafe(F.col("want"))).count() == 0


def test_import_candidates(spark):
    paths = spark.createDataFrame([("src/a.rs",), ("src/b/mod.rs",), ("ui/x.ts",), ("ui/y/index.ts",), ("pkg/m.py",), ("pkg/n/__init__.py",)], "path string")
    cases = [("crate::a::T", "src/m.rs", "rust", "src/a.rs"), ("crate::b::F", "src/m.rs", "rust", "src/b/mod.rs"), ("crate::b::f", "src/m.rs", "rust", None), ("std::fs", "src/m.rs", "rust", None), ("./x", "ui/z.ts", "typescript", "ui/x.ts"), ("./y", "ui/z.tsx", "tsx", "ui/y/index.ts"), ("x", "ui/z.ts", "typescript", None), (".m", "pkg/z.py", "python", "pkg/m.py"), ("..pkg.n", "pkg/z.py", "python", "pkg/n/__init__.py"), (".gone", "pkg/z.py", "python", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "import_id int, specifier string, path string, language string, want string")
    assert [(r.specifier, r.target_path) for r in imports.resolve_imports(df, paths).collect() if r.target_path != r.want] == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("FR-001", {"FR-001"}), ("FR-001-AC-1 ok", {"FR-001-AC-1"}), ("FR-001-AC-1a", set()), ("xFR-1", set()), ("FR-1 NFR-2,Task-3", {"FR-1", "NFR-2", "Task-3"}), ("ix://o/r/FR-2.", {"ix://o/r/FR-2"}), ("FR-001ix://o/r/x", {"ix://o/r/x"}), ("TC-1234567", set()), ("US-1_", set()), ("(StR-9)", {"StR-9"})],
)
def test_mentions(spark, text, want):
    df = spark.createDataFrame([(text, 1, "o", False, "p")], "text string, line int, owner string, owner_is_test boolean, path string")
    assert {r.identifier for r in mentions.harvest(df).collect()} == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("&mut Option<Store>", "Store"), ("Vec<Row>", "Row"), ("crate::store::Store", "Store"), ("HashMap<K, V>", "HashMap"), (": Foo[]", "Foo"), ("-> &'a Store", "Store"), ("u32", None), ("dyn Persist", "Persist"), ("Box<dyn Persist>", None), ("", None)],
)
def test_simple_type(text, want):
    assert simple_type(text) == want


@pytest.mark.parametrize(
    ("language", "text", "names"),
    [
        ("rust", "fn a<'x>(s: &'x str) -> char { '{' }\nfn b() { let r = r#\"}\"#; /* } */ }\nfn c() {}", ["a", "b", "c"]),
        ("rust", "pub(crate) async fn f() {}\npub const fn g() -> u8 { 1 }\nunsafe impl X for Y {}\ntrait T { fn h(&self); }", ["f", "g", "T", "h"]),
        ("typescript", "const s = `${'}'} {`;\nexport async function f() {}\nexport default class A<T> extends B<T> implements C { private x = 1; #y(): void {} get z(): A { return this; } }\nnamespace N { export function q() {} }", ["f", "A", "#y", "z", "N", "q"]),
        ("python", "def a(x: int = (1),\n      *r):\n    s = '''\ndef no(): pass\n'''\n    def b():\n        pass\n# c\nclass D(E): x: F = 1\nasync def g(): pass", ["a", "b", "D", "g"]),
    ],
)
def test_lexing(language, text, names):
    rows = Scan("f", "f", language, text).rows
    assert [r[5].split("\x1f")[0] for r in rows if r[0] == "fact"] == names and not [r for r in rows if r[0] == "diagnostic"]


def test_rounds_of_the_fixpoint():
    row = lambda i, name, kind, x: Row(1, i, "", name, kind, x, None, None)
    forward = [row(0, "v0", "annotation", "T")] + [row(i, f"v{i}", "copy", f"v{i - 1}") for i in range(1, 30)]
    assert {r[4:6] for r in solve(forward)} == {(1, False)} and len(solve(forward)) == 30
    backward = [row(-i, f"v{i}", "copy", f"v{i - 1}") for i in range(14, 0, -1)] + [row(1, "v0", "annotation", "T")]
    got = solve(backward)
    assert {r[4:6] for r in got} == {(10, True)} and len(got) == 11
    assert solve([row(0, "a", "copy", "b")]) == [(1, None, None, None, 1, False, None)]


def test_selection(spark):
    text = "fn a() {}\n"
    import hashlib

    files = spark.createDataFrame([("o", "r", "a.rs", "rust", text), ("o", "r", "b.rs", "rust", "fn b( {"), ("o", "r", "x.rs", "rust", "fn x() {}")], FILES)
    identity = lambda t: hashlib.sha256(t.encode()).hexdigest()
    modules = lambda *rows: spark.createDataFrame(list(rows), "org string, repo string, path string, identity string, functions array<string>")
    good = ("o", "r", "a.rs", identity(text), ["o/r/a.rs::a"])
    scope, accounted, found = extract_selected(modules(good, ("o", "r", "b.rs", identity("fn b( {"), []), ("o", "r", "c.rs", "", [])), files)
    assert {r.path: r.status for r in accounted.collect()} == {"a.rs": "accepted", "b.rs": "unparsable", "c.rs": "not_supplied", "x.rs": "extra"}
    assert tuple(scope.first()) == ("partial", 3, 2) and {r.name for r in found.nodes.collect()} == {"o/r/a.rs", "o/r/a.rs::a"}
    assert selection.scope(modules(good, good), accounted).first()["scope"] == "unavailable:duplicate_module"
    assert selection.scope(modules().limit(0), accounted.limit(0)).first()["scope"] == "unavailable:empty_selection"


def test_observation_absence(spark):
    counts = measurement.confusion(spark.createDataFrame([(True, False, "rust", "f", "calls", "t1")], "truth boolean, emitted boolean, language string, node_kind string, relation_kind string, resolver_tier string"))
    absent = measurement.observation(counts, "empty", "p", "t")
    assert "results" not in json.loads(absent.first()["record"])
    assert measurement.collection(absent).first()["status"] == "not_computed"
    assert measurement.valid_observations(absent).first()["problem"] is None
    assert measurement.decision(counts, "empty").first()["decision"] == "fail" and measurement.decision(counts).first()["decision"] == "pass"


def test_tree_and_command(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() { b(); }\nfn b() {}\n")
    (tmp_path / "target/no.rs").write_text("fn no() {}")
    (tmp_path / ".git/no.rs").write_text("fn no() {}")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    os.symlink(tmp_path / "src", tmp_path / "loop")
    found, unreadable = list_tree(str(tmp_path))
    assert [p.removeprefix(str(tmp_path)) for p in found] == ["/bad.py", "/src/a.rs"] and unreadable == []
    files, lost = read_tree(spark, str(tmp_path), "o", "r")
    assert [(r.path, r.language) for r in files.collect()] == [("src/a.rs", "rust")] and lost.count() == 1
    assert main(["--org", "o", "--repo", "r", str(tmp_path)], spark) == 1
    out = capsys.readouterr()
    shown = json.loads(out.out)
    assert list(shown) == ["nodes", "edges", "mentions", "diagnostics", "stats"] and shown["stats"]["files"] == 1 and "bad.py" in out.err
    with pytest.raises(SystemExit):
        main(["--org", "o"], spark)


def test_kept_parses_give_the_same_rows(spark, tmp_path):
    first = spark.createDataFrame([("o", "r", "a.rs", "rust", "fn a() {}\n"), ("o", "r", "b.rs", "rust", "fn b() {}\n")], FILES)
    more = first.union(spark.createDataFrame([("o", "r", "c.py", "python", "def c():\n    pass\n")], FILES))
    folder = str(tmp_path / "cache")
    scan_with_cache(spark, batch_order(first), folder)
    ordered = batch_order(more)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(scan_with_cache(spark, ordered, folder)) == key(scan(ordered))
    assert spark.read.parquet(folder).where("relation = 'fact'").count() == 3


def test_populations_count_source_trees_only(spark):
    rows = [("a", "x/input/a.rs", True), ("a", "x/variant/b.md", True), ("a", "x/other/c.rs", False), ("a", None, True), ("b", "input/n.pyi", None), ("c", "input/.rs", True), ("c", "input/m.py", None), ("d", "inputs/e.ts", True)]
    found = {r.g: (r.files, r.supported, r.unreadable, r.unsupported, r.state) for r in population(spark.createDataFrame(rows, "g string, path string, readable boolean"), ("g",)).collect()}
    assert found == {"a": (2, 1, 0, 1, "measured"), "b": (1, 0, 0, 1, "unsupported"), "c": (2, 1, 1, 1, "unreadable"), "d": (0, 0, 0, 0, "empty")}
    assert population(spark.createDataFrame([], "path string, readable boolean")).first()["state"] == "empty"


def test_open_counts_keep_their_strata(spark):
    cases = spark.createDataFrame([("m/rust", 2, 5), ("n/rust", None, 1), (None, 1, None)], "name string, reported long, expected long")
    got = {(r.dimension, r.key): (r.unresolved, r.ambiguous) for r in measurement.open_counts(cases).collect()}
    assert got == {("language", "rust"): (2, 6), ("language", "mixed"): (1, 0), **{s: (3, 6) for s in measurement.STRATA}}
    assert [(r.unresolved, r.ambiguous) for r in measurement.open_counts(cases.limit(0)).collect()] == [(0, 0)] * 4


def test_result_lists_are_checked(spark):
    names = sorted(measurement.RESULT_DIMENSIONS)
    good = [(1, i, d, "rust") for i, d in enumerate(names)]
    rows = good + [(2, i, d, "rust") for i, d in enumerate(reversed(names))] + [(3, i, d, "rust") for i, d in enumerate(names[1:])] + [(4, i, d, "basic") for i, d in enumerate(names)] + good[:0] + [(5, i, d, "rust") for i, d in enumerate([*names, names[-1]])] + [(6, i, d, None) for i, d in enumerate(names)]
    got = {r.id: r.problem for r in measurement.result_problems(spark.createDataFrame(rows, "id long, place long, dimension string, key string")).collect()}
    assert got == {1: None, 2: "order", 3: "dimensions", 4: "language", 5: "order", 6: "language"}


def test_plan_lines_must_be_whole(spark):
    plans = spark.createDataFrame([(1, "---\na: 1\n  b: 2\n---\n"), (2, "---\na: 1\n---\n  b: 2"), (3, "a: 1\n  b: 2"), (4, None), (5, "---\na: 12\n  b: 2\n---")], "plan_id long, text string")
    got = {r.plan_id: r.first_missing for r in measurement.plan_lines(plans, ["a: 1", "  b: 2"]).collect()}
    assert got == {1: None, 2: "  b: 2", 3: "a: 1", 4: "a: 1", 5: "a: 1"}


def test_places_in_a_group_that_holds_most_rows(spark):
    rows = spark.range(1000).selectExpr("IF(id % 3 < 2, 'hot', 'k' || id % 7) AS k", "id * 7919 % 1000 AS o")
    got = {}
    for r in place_in_group(rows, ["k"], ["o"]).collect():
        got.setdefault(r.k, []).append((r.o, r.place))
    assert all(sorted(p for _, p in x) == list(range(1, len(x) + 1)) == [p for _, p in sorted(x)] for x in got.values()) and sum(map(len, got.values())) == 1000


def test_only_public_names_are_exported(spark):
    rows = spark.createDataFrame([("public",), ("private",), ("crate",), (None,)], "v string")
    assert [r.e for r in rows.select(is_exported(rows.v).alias("e")).collect()] == [True, False, False, False]
