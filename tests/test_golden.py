"""The mixed five-file fixture: every node and edge, by hand."""

import pytest

from sparkgraft.plans.extract import extract

QUEUE = """//! A bounded queue, as FR-011 and ix://o/d/NFR-004 ask.

pub trait Drain {
    fn drain(&mut self);
}

enum Order {
    First,
    Last,
}

pub struct Queue {
    order: Order,
}

impl Queue {
    pub fn push(&mut self, item: u8) -> bool { item > 1 }
    fn shrink(&mut self) {}
}

impl Drain for Queue {
    fn drain(&mut self) { self.shrink(); }
}
"""
MAIN = """use crate::queue::Queue;

mod limits {
    pub fn most() -> u8 { 9 }
}

#[test]
fn fills_up() {
    // TC-017 until it is full
    let full = 9;
}
"""
PANEL = """export interface Panel {
  show(side: string): void;
}
export type Panels = Panel[];
export abstract class Frame {
  private draw(depth: number): string { return ""; }
}
"""
START = """import { Frame } from './panel';

export const start = (f: Frame): void => {};
"""
LOAD = """# Loads what StR-021 names.
class Loader:
    def _read(self, name: str) -> int:
        return 0


def load_all(names):
    pass
"""
FILES = [("o", "d", "src/queue.rs", "rust", QUEUE), ("o", "d", "./src//main.rs", "rust", MAIN), ("o", "d", "web/panel.ts", "typescript", PANEL), ("o", "d", "web/start.ts", "typescript", START), ("o", "d", "tools/load.py", "python", LOAD)]
COLUMNS = "org string, repo string, path string, language string, content string"


@pytest.fixture(scope="module")
def golden(spark):
    return {k: df.collect() for k, df in extract(spark.createDataFrame(FILES, COLUMNS)).ordered().items()}


def test_nodes(golden):
    got = [(n.object_type, n.name.removeprefix("o/d/"), n.data.kind, n.data.span.start, n.data.span.end, (n.data.parent or "").removeprefix("o/d/"), n.data.visibility, n.data.signature) for n in golden["nodes"]]
    assert got == [
        ("code_file", "src/main.rs", "file", 1, 11, "", "public", None),
        ("code_file", "src/queue.rs", "file", 1, 23, "", "public", None),
        ("code_file", "tools/load.py", "file", 1, 8, "", "public", None),
        ("code_file", "web/panel.ts", "file", 1, 7, "", "public", None),
        ("code_file", "web/start.ts", "file", 1, 3, "", "public", None),
        ("code_function", "src/main.rs::fills_up", "function", 8, 11, "src/main.rs", "private", "()"),
        ("code_function", "src/main.rs::limits::most", "function", 4, 4, "src/main.rs::limits", "public", "() -> u8"),
        ("code_function", "src/queue.rs::Drain::drain", "function", 4, 4, "src/queue.rs::Drain", "public", "(self)"),
        ("code_function", "src/queue.rs::Queue::drain", "function", 22, 22, "src/queue.rs::Queue", "public", "(self)"),
        ("code_function", "src/queue.rs::Queue::push", "function", 17, 17, "src/queue.rs::Queue", "public", "(self, u8) -> bool"),
        ("code_function", "src/queue.rs::Queue::shrink", "function", 18, 18, "src/queue.rs::Queue", "private", "(self)"),
        ("code_function", "tools/load.py::Loader::_read", "function", 3, 4, "tools/load.py::Loader", "crate", "(self, str) -> int"),
        ("code_function", "tools/load.py::load_all", "function", 7, 8, "tools/load.py", "public", "(names)"),
        ("code_function", "web/panel.ts::Frame::draw", "method", 6, 6, "web/panel.ts::Frame", "private", "(number) -> string"),
        ("code_function", "web/panel.ts::Panel::show", "method", 2, 2, "web/panel.ts::Panel", "public", "(string) -> void"),
        ("code_function", "web/start.ts::start", "function", 3, 3, "web/start.ts", "public", "(Frame) -> void"),
        ("code_module", "src/main.rs::limits", "module", 3, 5, "src/main.rs", "private", None),
        ("code_type", "src/queue.rs::Drain", "trait", 3, 5, "src/queue.rs", "public", None),
        ("code_type", "src/queue.rs::Order", "enum", 7, 10, "src/queue.rs", "private", None),
        ("code_type", "src/queue.rs::Queue", "struct", 12, 14, "src/queue.rs", "public", None),
        ("code_type", "tools/load.py::Loader", "class", 2, 4, "tools/load.py", "public", None),
        ("code_type", "web/panel.ts::Frame", "class", 5, 7, "web/panel.ts", "public", None),
        ("code_type", "web/panel.ts::Panel", "interface", 1, 3, "web/panel.ts", "public", None),
        ("code_type", "web/panel.ts::Panels", "type_alias", 4, 4, "web/panel.ts", "public", None),
    ]


def test_edges_mentions_and_stats(golden):
    edges = {(e.edge_type, e.source_ref.removeprefix("o/d/"), e.target_ref.removeprefix("o/d/"), e.confidence, e.reason, e["count"], e.evidence[0].line) for e in golden["edges"]}
    assert {e for e in edges if e[0] != "contains"} == {
        ("imports", "src/main.rs", "src/queue.rs", 1.0, "path-resolved", 1, 1),
        ("imports", "web/start.ts", "web/panel.ts", 1.0, "path-resolved", 1, 1),
        ("calls", "src/queue.rs::Queue::drain", "src/queue.rs::Queue::shrink", 0.9, "receiver-typed", 1, 22),
        ("implements_trait", "src/queue.rs::Queue", "src/queue.rs::Drain", 1.0, "syntactic", 1, 1),
        ("references", "src/queue.rs", "FR-011", 1.0, "explicit-mention", 1, 1),
        ("references", "src/queue.rs", "ix://o/d/NFR-004", 1.0, "explicit-mention", 1, 1),
        ("references", "src/main.rs::fills_up", "TC-017", 1.0, "explicit-mention", 1, 9),
        ("references", "tools/load.py::Loader", "StR-021", 1.0, "explicit-mention", 1, 1),
    }
    assert sum(e[0] == "contains" for e in edges) == 19
    assert [(m.identifier, m.kind, m.line) for m in golden["mentions"]] == [("FR-011", "requirement_citation", 1), ("StR-021", "requirement_citation", 1), ("TC-017", "tracking_tag", 9), ("ix://o/d/NFR-004", "artifact_reference", 1)]
    assert golden["diagnostics"] == [] and tuple(golden["stats"][0]) == (5, 0, 0, 1, 0)


def run(spark, files):
    got = extract(spark.createDataFrame([("o", "d", *f) for f in files], COLUMNS))
    calls = {(e.source_ref.split("::", 1)[-1], e.target_ref.split("/", 2)[-1], e.reason) for e in got.edges.where("edge_type = 'calls'").collect()}
    return calls, got.stats.first()


def test_rust_calls(spark):
    store = "pub struct Store;\nimpl Store {\n    pub fn upsert(&self) {}\n    pub fn open() -> Store { Store }\n    pub fn both(&self) { self.upsert(); }\n}\n"
    use = "use crate::store::Store;\nfn a(s: &Store) { s.upsert(); }\nfn b() { let s: Store = make(); let t = s; t.upsert(); }\nfn c() { Store::open(); }\nfn d(x: u32) { let s = Store::new(); s.upsert(); println!(\"{}\", upsert(1)); }\nfn e(q: Vec<Store>) { q.upsert(); nothing.missing(); }\n"
    calls, stats = run(spark, [("src/store.rs", "rust", store), ("src/use.rs", "rust", use)])
    target = "src/store.rs::Store::upsert"
    assert calls == {("Store::both", target, "receiver-typed"), ("a", target, "receiver-typed"), ("b", target, "receiver-typed"), ("c", "src/store.rs::Store::open", "receiver-typed"), ("d", target, "receiver-typed"), ("e", target, "receiver-typed")}
    assert stats.unresolved_calls == 3


def test_script_and_python_calls(spark):
    ts = "export class Repo {\n  save(): void {}\n  all(): void { this.save(); }\n}\nexport function run(r: Repo): void { r.save(); }\nexport const go = (): void => { const r = new Repo(); r.save(); };\n"
    py = "class Store:\n    def put(self):\n        return 1\n\n    def all(self):\n        self.put()\n\n\ndef main(s: Store):\n    s.put()\n    t = Store()\n    t.put()\n    helper()\n\n\ndef helper():\n    pass\n"
    calls, stats = run(spark, [("a.ts", "typescript", ts), ("b.py", "python", py)])
    assert calls == {("Repo::all", "a.ts::Repo::save", "receiver-typed"), ("run", "a.ts::Repo::save", "receiver-typed"), ("go", "a.ts::Repo::save", "receiver-typed"), ("Store::all", "b.py::Store::put", "receiver-typed"), ("main", "b.py::Store::put", "receiver-typed"), ("main", "b.py::helper", "name-match")}
    assert stats.unresolved_calls == 1  # Store() names no function


def test_ambiguity_gives_no_edge(spark):
    one = "pub struct A;\nimpl A { pub fn go(&self) {} }\n"
    two = "pub struct B;\nimpl B { pub fn go(&self) {} }\n"
    calls, stats = run(spark, [("src/a.rs", "rust", one), ("src/b.rs", "rust", two), ("src/c.rs", "rust", "fn f() { thing.go(); }\n")])
    assert calls == set() and stats.unresolved_calls == 1


def test_import_scope_and_name_match(spark):
    lib = "pub struct A;\nimpl A { pub fn go(&self) {} pub fn only(&self) {} }\n"
    other = "pub struct B;\nimpl B { pub fn go(&self) {} }\n"
    calls, _ = run(spark, [("src/a.rs", "rust", lib), ("src/b.rs", "rust", other), ("src/c.rs", "rust", "use crate::a::A;\nfn f() { x.go(); }\n"), ("src/e.rs", "rust", "fn g() { x.only(); }\n")])
    assert calls == {("f", "src/a.rs::A::go", "import-scoped"), ("g", "src/a.rs::A::only", "name-match")}


def test_errors_are_isolated(spark):
    got = extract(spark.createDataFrame([("o", "d", "a.rs", "rust", "fn a() {\n  let x = (1;\n"), ("o", "d", "b.rs", "rust", "fn b() {}\n"), ("o", "d", "c.ts", "typescript", "import './gone';\n"), ("o", "d", "e.rs", "rust", "x" * (8 * 1024 * 1024 + 1))], COLUMNS))
    assert [(r.path, r.code, r.severity) for r in got.ordered()["diagnostics"].collect()] == [("a.rs", "parse_error", "error"), ("c.ts", "unresolved_import", "warning"), ("e.rs", "file_too_large", "error")]
    assert got.stats.first().files_with_errors == 1 and {r.name for r in got.nodes.collect()} >= {"o/d/b.rs::b", "o/d/e.rs"}
