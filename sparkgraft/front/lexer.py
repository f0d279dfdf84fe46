"""Tokens of one source text: (kind, text, start, end).

Kinds: c comment, s string, w word, n number, p punctuation, l lifetime, r regular expression,
j the beginning of an element of markup. Texts of markup, tag names and attribute names are no
tokens; an expression in braces within markup stands between round brackets.
"""

from __future__ import annotations

import re
from itertools import accumulate

STRING = r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\""
LEXERS = {
    "rust": re.compile(r"(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])')|(?P<l>'\w+)|(?P<w>[^\W\d]\w*)|(?P<n>\d[\w.]*)|(?P<p>->|=>|::|\S)", re.S),
    "script": re.compile(rf"(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>{STRING}|`(?:\\.|[^`\\$]|\$(?!\{{))*`)|(?P<w>[#$]?[^\W\d][\w$]*|\$)|(?P<n>\d[\w.]*)|(?P<p>=>|\.\.\.|\S)", re.S),
    "python": re.compile(rf"(?P<c>#[^\n]*)|(?P<s>[rbfuRBFU]{{0,2}}(?:\"\"\".*?\"\"\"|'''.*?'''|{STRING}))|(?P<w>[^\W\d]\w*)|(?P<n>\d[\w.]*)|(?P<p>->|\*\*|\S)", re.S),
}
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words whose round brackets a statement follows, so that a slash after these begins a regular expression.
HEADS = frozenset("if while for with".split())
#: Words after which an expression begins.
BEFORE_VALUE = frozenset("return case typeof default yield await do else in of void delete throw new instanceof".split())
ELEMENT = re.compile(r"<(?:>|[A-Za-z][\w.:-]*(?=[\s/>])(?!\s+extends\b)(?!\s*,))")
IN_TAG = re.compile(r"\s+|\"[^\"]*\"|'[^']*'|/>|[>{]|/\*.*?\*/|[^\s\"'/>{]+|[/\"']", re.S)
MARKUP_TEXT = re.compile(r"[^<{]*")
CLOSING_TAG = re.compile(r"</[^>]*>")
COMMENT_EDGE = re.compile(r"/\*|\*/")
TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
IN_PLACE = re.compile(rf"{STRING}|`|[{{}}]|//[^\n]*|/\*.*?\*/", re.S)


#: Pieces of a Rust text without block comments and raw strings, white space among them, without groups: the most frequent first.
RUST_PIECES = re.compile(r"[^\W\db]\w*|\s+|[(){}\[\];,.&]|//[^\n]*|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])'|'\w+|[^\W\d]\w*|\d[\w.]*|->|=>|::|\S", re.S)


def rust_kind(piece: str) -> str:
    """The kind of a piece, a blank for white space; it follows from the piece alone."""
    first = piece[0]
    if first.isspace():
        return " "
    if len(piece) > 1 and first == "/":
        return "c"
    if len(piece) > 1 and piece[-1] in "\"'":
        return "s"
    if first == "_" or first.isalnum():
        return "n" if first.isdecimal() else "w"
    return "l" if len(piece) > 1 and first == "'" else "p"


#: By the first character of a piece, where that is enough.
RUST_KINDS = {c: rust_kind(c) for c in map(chr, range(128)) if c not in "/'\"b"}


def rust_plain(text: str) -> list[tuple[str, str, int, int]]:
    """As plain("rust", text), for texts without block comments and raw strings."""
    pieces = RUST_PIECES.findall(text)
    ends = list(accumulate(map(len, pieces)))
    return [(kind, piece, start, end) for piece, start, end in zip(pieces, [0, *ends], ends) if (kind := RUST_KINDS.get(piece[0]) or rust_kind(piece)) != " "]


def plain(family: str, text: str) -> list[tuple[str, str, int, int]]:
    return [(m.lastgroup if m.lastgroup != "h" else "s", m[0], m.start(), m.end()) for m in LEXERS[family].finditer(text)]


RAW = re.compile(r"b?r(?=#*\")")


def broken(start: int, end: int) -> tuple[str, str, int, int]:
    """What stands for the rest of a text whose comment, string or element never ends: a bracket without its partner."""
    return "p", "(", start, end


def comment_end(text: str, at: int) -> int:
    """The end of a block comment that may hold others."""
    depth = 0
    for m in COMMENT_EDGE.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def template_end(text: str, at: int) -> int:
    """The end of a template string, whose places may hold strings and further templates; at is after the opening quote."""
    places: list[int] = []  # open braces in each place that we are in; -1: in the string itself
    places.append(-1)
    while at < len(text):
        m = (TEMPLATE if places[-1] < 0 else IN_PLACE).search(text, at)
        if not m:
            return len(text)
        at, found = m.end(), m[0]
        if places[-1] < 0:
            if found == "`":
                places.pop()
                if not places:
                    return at
            elif found == "${":
                places.append(0)
        elif found == "`":
            places.append(-1)
        elif found == "{":
            places[-1] += 1
        elif found == "}":
            places[-1] -= 1
            if places[-1] < 0:
                places.pop()
    return len(text)


def rust(text: str) -> list[tuple[str, str, int, int]]:
    if "/*" not in text and not RAW.search(text):
        return rust_plain(text)
    out, at, lexer = [], 0, LEXERS["rust"]
    while m := lexer.search(text, at):
        kind, at = m.lastgroup if m.lastgroup != "h" else "s", m.end()
        if kind == "w" and m[0] in ("r", "br") and RAW.match(text, m.start()):
            return [*out, broken(m.start(), len(text))]
        if kind == "c" and m[0].startswith("/*") or m[0] == "/" and text.startswith("/*", m.start()):
            kind, at = "c", comment_end(text, m.start())
        out.append((kind, text[m.start() : at], m.start(), at))
    return out


def script(text: str, markup: bool) -> list[tuple[str, str, int, int]]:
    """Code, and with `markup` elements within it: a stack says where we are."""
    out: list[tuple[str, str, int, int]] = []
    modes: list[list] = [["code", 0]]  # code: open braces; tag; children
    heads: list[bool] = []  # of open round brackets: whether a statement follows them
    after_head, closes = False, True  # closes: no template so far is without its end
    at, n, lexer = 0, len(text), LEXERS["script"]
    while at < n:
        mode = modes[-1]
        if mode[0] == "tag":
            m = IN_TAG.match(text, at)
            at = m.end()
            if m[0] == "{":
                out.append(("p", "(", m.start(), at))
                modes.append(["code", 0])
            elif m[0] == "/>":
                modes.pop()
            elif m[0] == ">":
                mode[0] = "children"
            continue
        if mode[0] == "children":
            at = MARKUP_TEXT.match(text, at).end()
            if text.startswith("</", at):
                m = CLOSING_TAG.match(text, at)
                at = m.end() if m else n
                modes.pop()
            elif text.startswith("{", at):
                out.append(("p", "(", at, at + 1))
                modes.append(["code", 0])
                at += 1
            elif m := ELEMENT.match(text, at):
                modes.append(["children" if m[0] == "<>" else "tag", 0])
                at = m.end()
            else:
                at += 1
            continue
        m = lexer.search(text, at)
        if not m:
            break
        kind, found, start, at = m.lastgroup, m[0], m.start(), m.end()
        if kind == "p" and found == "/" and text.startswith("/*", start):
            return [*out, broken(start, n)]
        if kind == "p" and found == "(":
            heads.append(bool(out) and out[-1][0] == "w" and out[-1][1] in HEADS)
        elif kind == "p" and found == ")":
            after_head = heads.pop() if heads else False
        elif kind == "p" and found in "/<`{}":
            before = out[-1] if out else ("p", "", 0, 0)
            value = before[0] == "p" and (before[1] not in (")", "]", "}") or before[1] == ")" and after_head) or before[0] == "w" and before[1] in BEFORE_VALUE
            if found == "/" and value and (r := REGEX.match(text, start)):
                kind, at = "r", r.end()
            elif found == "`":
                kind, at = "s", template_end(text, at) if closes else start + 1
                if text[at - 1] != "`" or at == start + 1:
                    kind, at, closes = "p", start + 1, False  # the text is broken here, and no further template is looked for
            elif found == "<" and markup and value and (e := ELEMENT.match(text, start)):
                kind, at = "j", e.end()
                modes.append(["children" if e[0] == "<>" else "tag", 0])
            elif found == "{":
                mode[1] += 1
            elif found == "}" and mode[1]:
                mode[1] -= 1
            elif found == "}" and len(modes) > 1:
                modes.pop()
                out.append(("p", ")", start, at))
                continue
        out.append((kind, text[start:at], start, at))
    if len(modes) > 1:  # an element that never ends
        out.append(broken(max(0, n - 1), n))
    return out


def tokens(language: str, text: str) -> list[tuple[str, str, int, int]]:
    if language == "rust":
        return rust(text)
    if language == "python":
        return plain("python", text)
    return script(text, markup=language == "tsx")
