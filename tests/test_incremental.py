"""A graph that is changed batch by batch equals one of all files at once."""

import random

import pytest

from sparkgraft.plans.extract import extract
from sparkgraft.streaming.incremental import Graph, follow

FILES = "org string, repo string, path string, language string, content string"
NAMES = ["go", "stop", "open", "save"]


def text_of(pick, language, i):
    """A small module that declares and mentions names from a small stock, so that most edits have an effect elsewhere."""
    a, b, c = (pick.choice(NAMES) for _ in range(3))
    t, u = (f"T{pick.randrange(4)}" for _ in range(2))
    other = pick.randrange(6)
    if language == "rust":
        return f"use crate::m{other}::{u};\npub struct {t} {{ next: {u} }}\nimpl {t} {{\n    pub fn {a}(&self) -> {u} {{ self.{b}() }}\n}}\n// FR-00{i}\npub fn {c}_{pick.randrange(3)}(x: {u}) {{ let y = x.next; let z = y.{a}(); z.{b}(); q.{c}(); {c}_1(x); }}\n"
    if language == "python":
        return f"from .m{other} import {u}\n\n\nclass {t}({u}):\n    def {a}(self) -> {u}:\n        return self.{b}()\n\n\ndef {c}_{pick.randrange(3)}(x: {u}):\n    y = x.{a}()\n    y.{b}()\n    q.{c}()\n"
    return f"import {{ {u} }} from './m{other}';\nexport class {t} extends {u} {{\n  next: {u};\n  {a}(): {u} {{ return this.{b}(); }}\n}}\nexport const {c}{pick.randrange(3)} = (x: {u}) => {{ const y = x.next; const z = y.{a}(); z.{b}(); q.{c}(); }};\n"


def shown(found):
    edges = sorted((e.source_ref, e.edge_type, e.target_ref, e.confidence, e.reason, e["count"], tuple(map(tuple, e.evidence))) for e in found.edges.collect())
    nodes = sorted((n.name, n.object_type, str(n.data)) for n in found.nodes.collect())
    mentions = sorted(map(str, found.mentions.collect()))
    diagnostics = sorted((d.code, d.path, d.line, d.message) for d in found.diagnostics.collect())
    return edges, nodes, mentions, diagnostics, tuple(found.stats.first())


@pytest.mark.parametrize("seed", [1])
def test_random_edits_equal_a_full_run(spark, tmp_path, seed):
    pick = random.Random(seed)
    kinds = {"rust": ("src/m{}.rs", "rust"), "python": ("pkg/m{}.py", "python"), "ts": ("ui/m{}.ts", "typescript")}
    held = {}
    graph = Graph(spark, str(tmp_path / "graph"))
    for batch in range(3):
        changed, gone = {}, []
        for _ in range(12 if batch == 0 else 3):
            path, language = pick.choice(list(kinds.values()))
            key = (pick.choice(["r", "r", "s"]), path.format(pick.randrange(6)))
            changed[key] = (language, text_of(pick, language, batch))
        if batch > 0:
            gone = [k for k in pick.sample(sorted(held), 2) if k not in changed]
        if batch == 2:
            key = next(k for k in sorted(held) if k not in gone)
            changed[key] = (held[key][0], held[key][1] + ("# (\n" if held[key][0] == "python" else "// (\n") + "(")
        held.update(changed)
        for k in gone:
            held.pop(k)
        files = spark.createDataFrame([("o", r, p, *v) for (r, p), v in changed.items()], FILES)
        left = spark.createDataFrame([("o", r, p) for r, p in gone], "org string, repo string, path string")
        if batch == 1:  # a try that ends before its commit leaves what the next one writes over
            with pytest.raises(RuntimeError):
                Failing(spark, graph.folder).apply(batch, files, left)
        graph.apply(batch, files, left)
    whole = shown(extract(spark.createDataFrame([("o", r, p, *v) for (r, p), v in held.items()], FILES)))
    assert shown(graph.extraction()) == whole and len(whole[0]) > 20
    before = shown(graph.extraction())
    graph.apply(2, spark.createDataFrame([("o", "r", "src/new.rs", "rust", "fn new() {}\n")], FILES))  # applied already
    assert shown(graph.extraction()) == before


class Failing(Graph):
    """Lost when the commit is to be written."""

    def commit(self, batch):
        raise RuntimeError("lost")


def test_only_affected_files_are_resolved_anew(spark, tmp_path):
    graph = Graph(spark, str(tmp_path / "graph"))
    lib = "pub struct A;\nimpl A { pub fn go(&self) {} }\n"
    files = [("o", "r", "src/a.rs", "rust", lib), ("o", "r", "src/b.rs", "rust", "fn f() { x.go(); }\n"), ("o", "r", "src/c.rs", "rust", "fn g() { y.other(); }\n")]
    graph.apply(1, spark.createDataFrame(files, FILES))
    graph.apply(2, spark.createDataFrame([("o", "r", "src/d.rs", "rust", lib.replace("A", "B"))], FILES))
    resolved = {r.file_ord.split("\x01")[2] for r in spark.read.parquet(f"{graph.folder}/resolved/batch=2").collect()}
    assert resolved == {"src/b.rs", "src/d.rs"}  # two methods are named go now, so the call in b.rs is open
    changed = {(r.source_ref.split("/")[-1], r.target_ref.split("/")[-1], r["count"]) for r in graph.changed_edges(2).where("edge_type = 'calls'").collect()}
    assert changed == {("b.rs::f", "a.rs::A::go", 0)}
    graph.apply(3, spark.createDataFrame([("o", "r", "src/a.rs", "rust", lib + "// a comment alone\n")], FILES))
    assert {r.file_ord.split("\x01")[2] for r in spark.read.parquet(f"{graph.folder}/resolved/batch=3").collect()} == {"src/a.rs"}


def test_the_last_field_in_batch_order_counts(spark, tmp_path):
    graph = Graph(spark, str(tmp_path / "graph"))
    lib = "export class A { go() {} }\nexport class B { go() {} }\n"
    pair = lambda a, b: f"export class T {{\n  next: {a};\n  next: {b};\n}}\n"
    files = [("o", "r", "lib.ts", "typescript", lib), ("o", "r", "u.ts", "typescript", "function f(x: T) { const y = x.next; y.go(); }\n"), ("o", "r", "z.ts", "typescript", pair("B", "B")), ("o", "s", "a.ts", "typescript", pair("B", "A"))]
    called = lambda: [r.target_ref.split("::", 1)[1] for r in graph.edges().where("edge_type = 'calls'").collect()]
    graph.apply(1, spark.createDataFrame(files, FILES))
    assert called() == ["A::go"]  # repo s stands after r, whatever the paths
    graph.apply(2, spark.createDataFrame([("o", "s", "a.ts", "typescript", pair("A", "B"))], FILES))  # the same two fields, turned
    assert called() == ["B::go"]


def test_a_stream_of_files_keeps_the_graph(spark, tmp_path):
    rows = [("o", "r", "a.rs", "rust", "fn a() { b(); }\n"), ("o", "r", "b.rs", "rust", "fn b() {}\n")]
    spark.createDataFrame(rows, FILES).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
    follow(stream, str(tmp_path / "graph"), lambda edges, i: seen.append((i, edges.where("edge_type = 'calls'").count())), str(tmp_path / "state")).awaitTermination()
    assert seen == [(0, 1)] and Graph(spark, str(tmp_path / "graph")).edges().count() == 3


def test_an_empty_graph(spark, tmp_path):
    graph = Graph(spark, str(tmp_path / "graph"))
    assert graph.edges().count() == 0 and graph.committed() == []
    graph.apply(0, spark.createDataFrame([], FILES))
    assert graph.edges().count() == 0 and tuple(graph.extraction().stats.first()) == (0, 0, 0, 0, 0)
