"""Valid texts give no diagnostic, and nothing that only looks like a declaration is one."""

import pytest

from sparkgraft.front.scanner import Scan

VALID = [
    ("tsx", "export const A = () => <div className='x'>don't {b()} (</div>;\n"),
    ("tsx", "function f(x: number) { return x < 2 ? <A {...x} b={<i/>}/> : <><b>[</b>{/* ' */}</>; }\n"),
    ("tsx", "const id = <T,>(x: T) => x;\nconst m = <T extends object>(x: T) => x;\nconst c = a < b && c > d;\n"),
    ("tsx", "const x = cond ? <p>{list.map((v) => <li key={v}>{`it's ${v}`}</li>)}</p> : null;\n"),
    ("typescript", 'const ok = /[("]/.test(x);\nconst half = a / b / c;\nconst q = [/\\//g, /["\']/];\n'),
    ("typescript", "const t = `a ${f(`b ${c({d: `)`})}`)} (`;\nif (/^\\(/.test(t)) { go(t); }\n"),
    ("typescript", "const n = (a + b) / 2; const m = arr[0] / 3; // it's (\n"),
    ("rust", "/* a /* nested ( */ fn hidden() {} */ pub fn real() {}\n"),
    ("rust", "macro_rules! m { ($x:expr) => { fn q() {} }; }\npub fn real() { m!(1); }\n"),
    ("rust", "fn f<'a>(c: char) -> bool { c == '\\'' || c == '(' || b'\"' == 1 }\n"),
    ("python", "x = r'\\(' + f'{a[\"k\"]}'\ndef f():\n    return '''(['''\n"),
]


@pytest.mark.parametrize(("language", "text"), VALID)
def test_valid_texts_have_no_diagnostic(language, text):
    assert [r for r in Scan("o/d/f", "f", language, text).rows if r[0] == "diagnostic"] == []


@pytest.mark.parametrize(("language", "text"), [("tsx", "const a = <div>{b</div>;\n"), ("typescript", "const t = `a ${b;\n"), ("rust", "fn g( {}\n"), ("typescript", "f(];\n")])
def test_broken_texts_have_one(language, text):
    assert len([r for r in Scan("o/d/f", "f", language, text).rows if r[0] == "diagnostic"]) == 1


def facts(language, text):
    return [(r[4].removeprefix("o/d/f::"), r[8]) for r in Scan("o/d/f", "f", language, text).rows if r[0] == "fact"]


def test_only_what_is_declared():
    assert facts(*VALID[7]) == [("real", 1)] and facts(*VALID[8]) == [("real", 2)]
    assert [f for f, _ in facts(*VALID[1])] == ["f"]


def test_calls_in_markup():
    rows = Scan("o/d/f", "f", "tsx", "function f() {\n  return <A on={() => go(1)}>not(this) {show(2)}</A>;\n}\n").rows
    assert [(r[5], r[8]) for r in rows if r[0] == "call"] == [("go", 2), ("show", 2)]


def rows(language, text, relation):
    return [tuple(r[2:8]) for r in Scan("o/d/f", "f", language, text).rows if r[0] == relation]


def signatures(language, text):
    return {r[2].removeprefix("o/d/f::"): (r[1], r[5]) for r in rows(language, text, "fact")}


def test_bounds_with_brackets_are_no_parameters():
    text = "pub fn apply<F: Fn(u8) -> u8>(f: F) -> u8 { f(1) }\n"
    assert signatures("rust", text) == {"apply": ("function", "(F) -> u8")}
    assert rows("rust", text, "binding") == [("apply@1", "f", "annotation", "F", None, None)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("const g = function (a) { h(a); };\n", "(a)"),
        ("const g = function named<T>(a: T): void { h(a); };\n", "(T) -> void"),
        ("const g = x => h(x);\n", "(x)"),
        ("const g = async x => { h(x); };\n", "(x)"),
        ("const g = <T,>(x: T): T => h(x);\n", "(T) -> T"),
        ("export const g = async (a: Foo, b = 2): Promise<Bar> => { h(a); };\n", "(Foo, b) -> Promise<Bar>"),
    ],
)
def test_functions_as_values(text, want):
    assert signatures("typescript", text) == {"g": ("function", want)}
    assert [(r[0], r[3]) for r in rows("typescript", text, "call")] == [("o/d/f::g", "h")]
    assert not [r for r in rows("typescript", text, "binding") if r[1] == "g"]


def test_values_that_are_no_functions():
    text = "const a = (b)\nconst f = (x) => 1\nconst c = (d as T);\n"
    assert set(signatures("typescript", text)) == {"f"}


def test_object_and_class_expression_members():
    text = "const o = { run() { go(1); }, async get(a: string): Promise<void> { this.run(); } };\nexport default class { m(): void {} }\n"
    assert signatures("typescript", text) == {"run": ("method", "()"), "get": ("method", "(string) -> Promise<void>"), "m": ("method", "() -> void")}
    assert [r[3] for r in rows("typescript", text, "call")] == ["go", "run"]


def test_generic_calls():
    text = "const s = useState<string>('');\nlet ok = a < b && c > (d);\nbar<Map<K, V>>(x);\n"
    assert [r[3] for r in rows("typescript", text, "call")] == ["useState", "bar"]


def test_patterns_bind_no_names():
    text = "fn f() { let Some(x) = find() else { return }; let Point { a, b } = p; let y: Foo = g(); let z = y; }\n"
    assert [(r[1], r[2], r[3]) for r in rows("rust", text, "binding")] == [("y", "annotation", "Foo"), ("z", "copy", "y")]


def test_regular_expression_after_a_head():
    text = "if (x) /don't/.test(y);\nwhile (a) /[(]/.exec(b);\nconst h = (a) / b / c;\n"
    assert rows("typescript", text, "diagnostic") == []


def test_bases_are_cut_outside_of_brackets():
    text = "class A(Generic[K, V], Base, metaclass=Meta): x: int = 3\nclass B[T](A): pass\n"
    assert [(r[0], r[1]) for r in rows("python", text, "relation")] == [("A", "Base"), ("B", "A")]


def test_the_column_counts_bytes():
    (row,) = [r for r in Scan("o/d/f", "f", "rust", "fn a() {}\n// x\nlet \u00e9 = (;\n").rows if r[0] == "diagnostic"]
    assert row[8:10] == [3, 9]


def test_simple_types():
    from sparkgraft.front.scanner import simple_type

    cases = {"Option<Box<Foo>>": "Foo", "&'a mut Vec<T>": "T", "Map<K, V>": "Map", "a::b::Thing": "Thing", "Foo<>": "Foo", "Foo<Bar": None, "Option<Map<K, V>>": "Option", "u8": None, "Foo[]": "Foo", "": None}
    assert {k: simple_type(k) for k in cases} == cases
    assert simple_type("A<" * 100_000 + "B" + ">" * 100_000) == "B"


HOSTILE = {
    "one line of bindings": ("typescript", "const a=1;" * 100_000),
    "bindings without semicolons": ("typescript", "const a=1\n" * 100_000),
    "bindings without values": ("typescript", "const a:x " * 100_000 + "=1;"),
    "lets without values": ("rust", "let a:x " * 120_000 + "=1;"),
    "open templates": ("typescript", "`${" * 300_000),
    "open comments": ("typescript", "/* " * 300_000),
    "open raw strings": ("rust", 'r#"' * 300_000),
    "open functions": ("rust", "fn f(" * 200_000),
    "open types": ("typescript", "a<" * 400_000),
    "imports": ("typescript", "import {a} " * 90_000),
    "nested classes": ("python", "class A: " * 3_000 + "pass"),
    "nested definitions": ("python", "def f(): " * 3_000 + "pass"),
    "open element": ("tsx", "const a = <div b=\"c>" + "x" * 1_000_000),
    "open elements": ("tsx", "const a = " + "<div>" * 200_000),
    "attributes": ("rust", "#[a]" * 250_000),
    "impls": ("rust", "impl a " * 140_000),
    "brackets": ("typescript", "(" * 1_000_000),
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_hostile_sources_take_linear_time(name):
    import time

    began = time.process_time()
    Scan("o/d/f", "f", *HOSTILE[name])
    assert time.process_time() - began < 15
