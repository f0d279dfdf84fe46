"""A small tolerant scanner of one source text: declarations, comments, imports, bindings, calls.

It only says what stands where. Names are joined to references, types, edges and ids by Spark.
Rust, TypeScript and TSX are read by braces, Python by indentation. It agrees with a full
parser on well-formed text; of malformed text it reports the first unbalanced bracket or
unclosed string, and what could be read around it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

from . import lexer

# Keywords by what they begin.
TYPES = {"rust": {"struct": "struct", "enum": "enum", "trait": "trait", "union": "union", "type": "type_alias"}, "script": {"class": "class", "interface": "interface", "enum": "enum", "type": "type_alias"}}
MODULES = {"rust": {"mod": "module"}, "script": {"namespace": "namespace", "module": "namespace"}}
MODIFIERS = {"rust": frozenset("pub async unsafe extern default".split()), "script": frozenset("export default declare abstract async public private protected static readonly override get set".split())}
NO_CALL = frozenset("if while for match return switch catch function fn super import typeof await in of and or not elif assert yield lambda with except del raise else".split())
PLAIN = re.compile(r"[\w$]+")
SOMETHING = re.compile(r"\S")
LINE_FEED = re.compile("\n")
COMMENTS = re.compile(r"(?s)//[^\n]*|/\*.*?\*/")
DEFAULT_VALUE = re.compile(r"(?<![=!<>:])=(?![=>])")
PARAMETER_WORD = re.compile(r"^(?:mut|public|private|protected|readonly)\s+")
RECEIVER = re.compile(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?(?:self|this|cls)")
RETURN_MARK = re.compile(r"^(?:->|:)\s*")
WHERE = re.compile(r"\bwhere\b")
BRACKETS = frozenset("([{<)]}>")
UNPAIRED = frozenset("([{)]}\"`'")


@lru_cache(maxsize=20_000)
def simple_type(text: str) -> str | None:
    """The simple name of a type: references off, single-argument generics opened, last segment, type-cased."""
    text = re.sub(r"^(?:->|:)\s*", "", text.strip()).lstrip("&* ")
    text = re.sub(r"^'\w+\s+", "", text)
    while re.match(r"(?:mut|dyn|impl|readonly)\s", text):
        text = text.split(None, 1)[1]
    opened, closed, commas = ([m.start() for m in re.finditer(c, text)] for c in "<>,") if "<" in text else ((), (), ())
    at, end = 0, len(text)
    for k, start in enumerate(opened):
        if start >= end:
            break
        if k >= len(closed) or (stop := closed[-1 - k]) < start:
            return None
        if not SOMETHING.search(text, start + 1, stop) or bisect_left(commas, start) < bisect_left(commas, stop):
            end = start
            break
        at, end = start + 1, stop
    text = text[at:end].strip().lstrip("&* ")
    last = re.split(r"::|\.", text)[-1].strip().rstrip("?![]")
    return last if last and PLAIN.fullmatch(last) and last[0].isupper() else None


@dataclass
class Frame:
    """Where we are: names for children, the containing fact, the binding scope, the owning type."""

    names: str
    contains: str
    scope: str = ""
    owner: str | None = None
    test: bool = False
    member: bool = False
    kind: str = ""
    fact: list | None = None
    indent: int = -1
    ends: int | None = None  # the token that ends an expression, where no brace does
    pending: list = field(default_factory=list)

    def inner(self, **changed) -> Frame:
        """A frame within, that says the same but for what is changed; dataclasses.replace takes ten times as long."""
        frame = object.__new__(Frame)
        frame.__dict__.update(self.__dict__, ends=None, pending=[], **changed)
        return frame


@lru_cache(maxsize=64)
def stops_of(stops: str) -> frozenset[str]:
    return frozenset(stops.split())


class Scan:
    def __init__(self, name: str, path: str, language: str, text: str):
        self.name, self.path, self.text = name, path, text
        self.family = language if language in ("rust", "python") else "script"
        self.rows: list[list] = []
        self.tokens = lexer.tokens(language, text)
        self.breaks = [m.start() for m in LINE_FEED.finditer(text)]
        self.stack = [Frame(name, name)]
        self.later, self.next_string, self.angles = self.indexed() if self.family == "script" else ([], [], {})
        self.partners, self.round = self.matched()
        self.stops: dict[str, list[int]] = {}
        self.places: dict[int, list[int | None]] = {}  # by fact: where it starts, where its body does, where it stops
        (self.python if self.family == "python" else self.braces)()
        if (broken := self.unbalanced()) is not None:
            line = self.line(broken)
            begin = self.breaks[line - 2] + 1 if line > 1 else 0
            self.row("diagnostic", line=line, end=len(text[begin:broken].encode("utf-8", "surrogatepass")))
            self.row("error", line=broken)
            for fact, (start, body, stop) in self.places.items():  # only where there is an error to place
                executes = body if self.rows[fact][2] == "code_function" else None
                self.row("span", line=start, end=len(text) if stop is None else stop, c=None if executes is None else str(executes))

    def indexed(self) -> tuple[list[int], list[int], dict[int, int]]:
        """By token: the first on a later line, and the first string from it on; and the angle brackets that close others around types alone."""
        n = len(self.tokens)
        later, strings, angles, opened = [n] * n, [n] * n, {}, []
        rows = [self.line(t[2]) for t in self.tokens]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                later[i] = i + 1 if rows[i + 1] > rows[i] else later[i + 1]
                strings[i] = strings[i + 1]
            if self.tokens[i][0] == "s":
                strings[i] = i
        for i, (kind, text, _, _) in enumerate(self.tokens):
            if kind == "p" and text == "<":
                opened.append(i)
            elif kind == "p" and text == ">":
                if opened:
                    angles[opened.pop()] = i
            elif kind not in ("w", "s", "n", "l") and text not in (".", ",", "[", "]", "|", "&", "{", "}", ":", "(", ")", "=>", "->", "::", "?", "*", "+"):
                opened = []
        return later, strings, angles

    def unbalanced(self) -> int | None:
        """The place of the first bracket or quote without its partner."""
        opened: list[tuple[str, int]] = []
        for kind, text, at, _ in self.tokens:
            if kind != "p" or text not in UNPAIRED:
                continue
            if text in "([{":
                opened.append((")]}"["([{".index(text)], at))
            elif text in ")]}" and (not opened or opened.pop()[0] != text):
                return at
            elif text in "\"`" or (text == "'" and self.family != "rust"):
                return at
        return opened[0][1] if opened else None

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def row(self, relation: str, a=None, b=None, c=None, d=None, e=None, f=None, line=None, end=None, flag=None) -> list:
        self.rows.append([relation, len(self.rows), a, b, c, d, e, f, line, end, flag])
        return self.rows[-1]

    def span(self, i: int, j: int) -> str:
        """The text of tokens i to j, without j."""
        return self.text[self.tokens[i][2] : self.tokens[j - 1][3]] if j > i else ""

    def matched(self) -> tuple[dict[int, int], dict[int, int]]:
        """By opening bracket: the one that closes it among its own kind, and (round and square together) the one that closes it by depth."""
        own: dict[str, list[int]] = {c: [] for c in "([{<"}
        deep, partners, together = [], {}, {}
        for i, (kind, text, _, _) in enumerate(self.tokens):
            if kind != "p" or text not in BRACKETS:
                continue
            if text in own:
                own[text].append(i)
                if text in "([":
                    deep.append(i)
            elif text in (")", "]", "}", ">"):
                if held := own["([{<"[")]}>".index(text)]]:
                    partners[held.pop()] = i
                if text in ")]" and deep:
                    together[deep.pop()] = i
        return partners, together

    def closing(self, i: int, stop: int) -> int:
        """The token that closes the bracket at i, before stop."""
        return min(self.partners.get(i, stop - 1), stop - 1)

    def comment(self, text: str, at: int) -> None:
        frame = self.stack[-1]
        row = self.row("comment", text, frame.contains, line=self.line(at), flag=frame.test)
        if not text.startswith(("//!", "/*!", "#![")):
            frame.pending.append(row)

    def declare(self, kind: str, object_type: str, name: str, start: int, modifiers: str, signature: str | None = None, attributes: str = "") -> Frame:
        """Records a fact and returns the frame of its body."""
        frame = self.stack[-1]
        qualified, line = f"{frame.names}::{name}", self.line(start)
        named = object_type == "code_function" and (name.startswith("test_") or (name.startswith("test") and len(name) > 4))
        test = frame.test or named or "test" in attributes
        for comment in frame.pending:
            comment[3], comment[10] = qualified, test
        frame.pending = []
        fact = self.row("fact", object_type, kind, qualified, f"{name}\x1f{modifiers}", frame.contains, signature, line, line, frame.member)
        self.places[fact[1]] = [start, None, None]
        inner = frame.inner(names=frame.names if kind == "type_alias" else qualified, contains=qualified, test=test, kind=kind, fact=fact, member=kind in ("trait", "interface", "class"))
        if object_type == "code_function":
            inner.scope = f"{name}@{line}"
            inner.member = False
            if frame.owner:
                self.row("enclosing", inner.scope, frame.owner)
        elif object_type == "code_type":
            inner.owner = name
        return inner

    def callable(self, kind: str, name: str, start: int, modifiers: str, open_at: int, shut: int, returns: str, attributes: str = "") -> Frame:
        """A function: its signature, its typed parameters, its return type."""
        shown, typed, depth, last = [], [], 0, open_at + 1
        for j in range(open_at + 1, shut + 1):
            text = self.tokens[j][1] if self.tokens[j][0] == "p" else ""
            depth += (text in ("(", "[", "{", "<")) - (text in (")", "]", "}", ">") and j < shut)
            if (text == "," and depth == 0) or j == shut:
                part = COMMENTS.sub("", self.span(last, j)).strip()
                last = j + 1
                if not part:
                    continue
                part = DEFAULT_VALUE.split(part, maxsplit=1)[0].strip() if self.family != "rust" else part
                head, colon, kind_text = part.partition(":")
                head = PARAMETER_WORD.sub("", head.strip()).rstrip("?")
                if RECEIVER.fullmatch(head) and (self.family != "script"):
                    shown.append("self")
                elif colon:
                    shown.append(kind_text.strip())
                    typed.append((head, kind_text))
                else:
                    shown.append(part)
        frame = self.declare(kind, "code_function", name, start, modifiers, f"({', '.join(shown)})" + (f" -> {returns}" if returns else ""), attributes)
        if found := simple_type(returns):
            self.row("return", frame.contains, found)
        for head, kind_text in typed:
            if PLAIN.fullmatch(head) and (found := simple_type(kind_text)):
                self.row("binding", frame.scope, head, "annotation", found)
        return frame

    def bind(self, name: str, annotation: str, value: str) -> None:
        """A binding's source: its annotation, or what its value looks like."""
        scope, value = self.stack[-1].scope, value.strip().removeprefix("await ").strip()
        if not PLAIN.fullmatch(name):
            return
        if found := simple_type(annotation):
            self.row("binding", scope, name, "annotation", found)
            return
        if m := re.match(r"new\s+([\w$.<>]+)", value):
            if found := simple_type(m[1]):
                self.row("binding", scope, name, "constructor", found)
        elif m := re.match(r"([\w$.:]+)\s*\(", value):
            head, tail = re.fullmatch(r"(?:(.*)(?:::|\.))?([\w$]*)", m[1], re.S).groups()
            head = re.split(r"[.:]+", head)[-1] if head else None
            if head and head[0].isupper() and tail == "new":
                self.row("binding", scope, name, "constructor", head)
            elif head and not head[0].isupper():
                self.row("binding", scope, name, "method", head, tail)
            elif m[1][:1].isupper():
                self.row("binding", scope, name, "constructor", m[1])
            elif not head:
                self.row("binding", scope, name, "call", tail)
        elif (m := re.fullmatch(r"([\w$]+)\.([\w$]+)", value)) and self.family != "rust":
            self.row("binding", scope, name, "field", m[1], m[2])
        elif PLAIN.fullmatch(value) and not value[0].isupper() and not value[0].isdigit():
            self.row("binding", scope, name, "copy", value)

    def is_generic_call(self, i: int) -> bool:
        """Whether type arguments and an opening bracket follow word i at once."""
        shut = self.angles.get(i + 1, -1)
        return shut > 0 and self.tokens[i + 1][2] == self.tokens[i][3] and shut + 1 < len(self.tokens) and self.tokens[shut + 1][1] == "("

    def call(self, i: int) -> None:
        """Token i is a word before an opening bracket, or type arguments and one."""
        name, frame = self.tokens[i][1], self.stack[-1]
        before = self.tokens[i - 1][1] if i else ""
        if name in NO_CALL or before in ("fn", "function", "def", "class", "new", "macro_rules"):
            return
        j = i
        while j >= 2 and self.tokens[j - 1][1] in (".", "::", "?."):
            if self.tokens[j - 2][0] != "w":
                if j == i:
                    return
                break
            j -= 2
        receiver = self.tokens[i - 2][1] if before in (".", "::", "?.") else None
        self.row("call", frame.contains, frame.scope, receiver, name, line=self.line(self.tokens[j][2]))

    # -- languages with braces

    def braces(self) -> None:
        tokens, n, family = self.tokens, len(self.tokens), self.family
        i, start, modifiers, attributes, depth = 0, None, [], "", 0
        while i < n:
            kind, text, at, end = tokens[i]
            while (over := self.stack[-1].ends) is not None and i >= over:
                fact = self.stack.pop().fact
                fact[9], self.places[fact[1]][2] = self.line(tokens[over - 1][2]), tokens[over - 1][3]
                self.stack[-1].pending = []
            if kind == "c":
                self.comment(text, at)
                i += 1
                continue
            if family == "rust" and text == "#" and i + 1 < n and tokens[i + 1][1] in ("[", "!"):
                j = self.closing(i + 1 + (tokens[i + 1][1] == "!"), n)
                attributes += self.span(i, j + 1)
                self.comment(self.span(i, j + 1), at)
                i = j + 1
                continue
            if start is None:
                start = at
            after = self.head(i, start, modifiers, attributes) if kind == "w" else None
            if after is not None:
                i, frame = after
                if frame == "more":
                    continue
                self.stack[-1].pending = []
                start, modifiers, attributes = None, [], ""
                if frame is not None:
                    self.stack.append(frame)
                continue
            if text == "{" and kind == "p":
                self.stack.append(self.stack[-1].inner(fact=None, kind="block", member=False))
            elif text == "}" and kind == "p":
                if len(self.stack) > 1:
                    frame = self.stack.pop()
                    if frame.fact is not None:
                        frame.fact[9], self.places[frame.fact[1]][2] = self.line(at), end
                    self.stack[-1].pending = []
            elif kind == "p" and text in "()":
                depth += 1 if text == "(" else -1
            elif kind == "w" and i + 1 < n and (tokens[i + 1][1] == "(" or family == "script" and self.is_generic_call(i)):
                self.call(i)
            elif kind == "s" and family == "script" and "export" in modifiers and text[1:2] == ".":
                self.row("import", text.strip("\"'`"), line=self.line(start))
            if text in (";", "{", "}") and kind == "p":
                start, modifiers, attributes = None, [], ""
                self.stack[-1].pending = []
            elif text == "," and self.stack[-1].kind in ("struct", "union", "enum", "interface"):
                start, modifiers = None, []
            i += 1

    def until(self, i: int, stops: str, end: int | None = None) -> int:
        """The first token from i on (but before end) that is one of stops outside of round and square brackets that open from i on."""
        n = len(self.tokens)
        end = n if end is None else end
        wanted = stops_of(stops)
        depth = 0
        for j in range(i, min(i + 48, end)):  # most are near; for the rest a table is made once
            kind, text = self.tokens[j][:2]
            if depth <= 0 and text in wanted and (kind == "p" or kind == "w" and (not j or self.tokens[j - 1][1] != "*")):
                return j
            if kind == "p":
                depth += (text == "(" or text == "[") - (depth > 0 and (text == ")" or text == "]"))
        if end <= i + 48:
            return end
        if stops not in self.stops:
            found = [n] * (n + 1)
            for j in range(n - 1, -1, -1):
                kind, text = self.tokens[j][:2]
                if text in wanted and (kind == "p" or kind == "w" and (not j or self.tokens[j - 1][1] != "*")):
                    found[j] = j
                elif kind == "p" and text in ("(", "["):
                    found[j] = found[self.round[j] + 1] if j in self.round else n
                else:
                    found[j] = found[j + 1]
            self.stops[stops] = found
        return min(self.stops[stops][min(i, n)], end) if i < end else end

    def body(self, frame: Frame, j: int) -> tuple:
        """After a declaration's head: its frame, if a body opens at j, else the end of the declaration."""
        n, place = len(self.tokens), self.places[frame.fact[1]]
        frame.fact[9] = self.line(self.tokens[min(j, n - 1)][2])
        if j < n and self.tokens[j][1] == "{":
            place[1] = self.tokens[j][2]
        else:
            place[2] = self.tokens[min(j, n - 1)][3]
        return (j + 1, frame) if j < n and self.tokens[j][1] == "{" else (min(j + 1, n), None)

    def head(self, i: int, start: int, modifiers: list, attributes: str):
        """If a declaration, import or binding begins at word i: where to go on, and the frame to enter (or "more")."""
        tokens, n, family = self.tokens, len(self.tokens), self.family
        word, frame = tokens[i][1], self.stack[-1]
        after = tokens[i + 1] if i + 1 < n else ("", "", 0, 0)
        fresh = tokens[i][2] == start or bool(modifiers)
        if fresh and word in MODIFIERS[family] and after[1] not in (":", "=", ",", ")") and not (family == "script" and after[1] == "("):
            if word == "pub" and after[1] == "(":
                modifiers.append("pub (")
                return self.closing(i + 1, n) + 1, "more"
            modifiers.append(word)
            if word == "export" and after[1] in ("{", "*"):
                j = i + 2 if after[1] == "*" else self.closing(i + 1, n) + 1
                j = self.until(j, ";", self.line_end(min(j, n - 1)))
                self.strings(i, j, start)
                return min(j + 1, n), None
            return i + 1, "more"
        said = " ".join(modifiers)
        if family == "rust" and word == "const" and after[1] in ("fn", "unsafe", "async"):
            return i + 1, "more"
        if word in ("fn", "function") and (after[0] == "w" or after[1] == "*"):
            star = after[1] == "*"
            name = tokens[i + 1 + star][1]
            opened = i + 2 + star
            if opened < n and tokens[opened][1] == "<":  # bounds may hold brackets of their own
                opened = self.closing(opened, n) + 1
            if opened >= n or tokens[opened][1] != "(":
                return None
            shut = self.closing(opened, n)
            stop = self.until(shut + 1, "{ ;")
            returns = self.returns(shut + 1, stop)
            return self.body(self.callable("generator_function" if star else "function", name, start, said, opened, shut, returns, attributes), stop)
        if word in TYPES[family] and after[0] == "w" and fresh:
            kind = TYPES[family][word]
            stop = self.until(i + 2, "{ ;") if kind != "type_alias" else self.until(i + 2, ";")
            inner = self.declare(kind, "code_type", after[1], start, said, attributes=attributes)
            if family == "script":
                self.heritage(after[1], self.span(i + 2, stop))
            if kind == "type_alias" and stop < n:
                inner.fact[9] = self.line(tokens[stop][2])
                return stop + 1, None
            return self.body(inner, stop)
        if word in MODULES[family] and (after[0] == "w" or (family == "script" and after[0] == "s")) and fresh:
            stop = self.until(i + 2, "{ ;")
            return self.body(self.declare(MODULES[family][word], "code_module", after[1].strip("\"'"), start, said, attributes=attributes), stop)
        if family == "rust":
            if word == "impl" and fresh:
                stop = self.until(i + 1, "{ ;")
                head = re.sub(r"^<[^{]*?>\s+(?=\w)", "", self.span(i + 1, stop)).split(" where ")[0]
                trait, _, target = head.rpartition(" for ")
                owner = re.split(r"<", target.strip().lstrip("&"))[0].strip()
                simple = simple_type(target) or owner
                if trait and (found := simple_type(trait)):
                    self.row("relation", owner, found, flag=True)
                return stop + 1, frame.inner(names=f"{frame.names}::{owner}", owner=simple if simple == owner else owner, fact=None, kind="impl", member=bool(trait))
            if word == "use":
                stop = self.until(i + 1, ";")
                self.uses(re.sub(r"\s+", "", re.sub(r"\s+as\s+\w+", "", self.span(i + 1, stop))), self.line(start))
                return min(stop + 1, n), None
            if word in ("let", "const", "static") and after[0] == "w":
                j = i + 1 + (after[1] == "mut")
                if j + 1 < n and tokens[j + 1][1] in (":", "="):  # else a pattern, which binds no plain name
                    equals = self.until(j + 1, "= ; { } let const static")
                    stop = self.until(equals, "; { } let const static")
                    value = self.span(equals + 1, stop) if stop < n and tokens[stop][0] == "p" and tokens[equals][1] == "=" else ""
                    self.bind(tokens[j][1], self.span(j + 2, equals) if tokens[j + 1][1] == ":" else "", value)
                    return j + 1, "more"
                return i + 1, "more"
            if frame.kind in ("struct", "union") and after[1] == ":" and frame.owner and (found := simple_type(self.span(i + 2, self.field_end(i + 2)))):
                self.row("field", frame.owner, word, found)
            if word == "macro_rules" and after[1] == "!" and i + 3 < n and tokens[i + 3][1] in ("(", "[", "{"):
                return self.closing(i + 3, n) + 1, None  # its patterns and bodies declare nothing here
            if after[1] == "!" and i + 2 < n and tokens[i + 2][1] in ("(", "[", "{"):
                return self.closing(i + 2, n) + 1, "more"  # a macro's tokens are no calls
            return None
        if word == "import" and fresh and after[1] != "(":
            stop = self.until(i + 1, ";", self.line_end(min(self.next_string[i], n - 1)))
            self.strings(i, stop, start)
            return min(stop + (stop < n and tokens[stop][1] == ";"), n), None
        if word in ("const", "let", "var") and after[0] == "w":
            j = self.until(i + 2, "= ; { const let var")
            if j < n and tokens[j][1] == "=":
                if (found := self.function_value(j + 1)) is not None:
                    opened, shut, stop = found
                    bare = opened == shut  # x => ..: one parameter without brackets
                    inner = self.callable("function", after[1], after[2], said, opened - bare, shut + bare, self.returns(shut + 1, stop), attributes)
                    if stop < n and tokens[stop][1] == "=>":
                        stop += 1
                    if stop < n and tokens[stop][1] == "{":
                        return self.body(inner, stop)
                    self.places[inner.fact[1]][1] = tokens[min(stop, n - 1)][2]
                    inner.ends = self.until(stop, "; , } ) const let var export import function class interface return")
                    inner.fact[9] = self.line(tokens[inner.ends - 1][2])
                    return stop, inner
                self.bind(after[1], self.span(i + 2, j), self.span(j + 1, self.until(j + 1, "; { const let var", self.line_end(j))))
            return i + 2, "more"
        if word == "class" and after[1] != ":" and (i == 0 or tokens[i - 1][1] not in (".", "?.")):  # an expression: its members are declared, it is not
            return self.until(i + 1, "{ ;") + 1, frame.inner(fact=None, kind="class", member=True)
        if frame.kind not in ("class", "interface") and after[1] == "(" and word not in NO_CALL and self.begins_member(i):
            shut = self.closing(i + 1, n)
            stop = self.until(shut + 1, "{ ; , )") if shut + 1 < n and tokens[shut + 1][1] == ":" else shut + 1
            if stop < n and tokens[stop][1] == "{":
                return self.body(self.callable("method", word, tokens[i][2], "", i + 1, shut, self.returns(shut + 1, stop), attributes), stop)
        if frame.kind in ("class", "interface") and fresh:
            if after[1] in ("(", "<"):
                opened = self.closing(i + 1, n) + 1 if after[1] == "<" else i + 1
                if opened >= n or tokens[opened][1] != "(":
                    return None
                shut = self.closing(opened, n)
                stop = min(self.until(shut + 1, "{ ;"), n)
                if stop > self.line_end(shut) and stop < n and tokens[stop][1] == "{" and frame.kind == "interface":
                    stop = self.line_end(shut)
                return self.body(self.callable("method", word, start, said, opened, shut, self.returns(shut + 1, stop), attributes), stop)
            if after[1] in (":", "?", "!") and (found := simple_type(self.span(i + 1, self.field_end(i + 1)).lstrip("?!:"))):
                self.row("field", frame.owner, word, found)
        return None

    def begins_member(self, i: int) -> bool:
        """Whether word i may name a method of an object: it follows a brace or comma, perhaps with words between."""
        i -= 1
        while i > 0 and self.tokens[i][1] in ("async", "get", "set", "*"):
            i -= 1
        return i >= 0 and self.tokens[i][0] == "p" and self.tokens[i][1] in ("{", ",")

    def function_value(self, j: int) -> tuple[int, int, int] | None:
        """Of a function that is the value from token j on: where its parameters open and close, and where its body or arrow stands."""
        tokens, n = self.tokens, len(self.tokens)
        j += j < n and tokens[j][1] == "async"
        if j < n and tokens[j][1] == "function":
            j += 1 + (j + 1 < n and tokens[j + 1][0] == "w")
            if j < n and tokens[j][1] == "<":
                j = self.closing(j, n) + 1
            if j >= n or tokens[j][1] != "(":
                return None
            shut = self.closing(j, n)
            stop = self.until(shut + 1, "{ ;")
            return (j, shut, stop) if stop < n and tokens[stop][1] == "{" else None
        if j + 1 < n and tokens[j][0] == "w" and tokens[j + 1][1] == "=>":
            return j, j, j + 1
        if j < n and tokens[j][1] == "<" and j in self.angles:
            j = self.angles[j] + 1
        if j >= n or tokens[j][1] != "(":
            return None
        shut = self.closing(j, n)
        if shut + 1 < n and tokens[shut + 1][1] == "=>":
            return j, shut, shut + 1
        if shut + 1 < n and tokens[shut + 1][1] == ":":
            stop = self.until(shut + 2, "=> = ; ,", self.line_end(shut))
            return (j, shut, stop) if stop < n and tokens[stop][1] == "=>" else None
        return None

    def returns(self, i: int, stop: int) -> str:
        text = self.span(i, stop).strip()
        return WHERE.split(RETURN_MARK.sub("", text))[0].strip() if text.startswith(("->", ":")) else ""

    def field_end(self, i: int) -> int:
        return self.until(i, ", ; } =")

    def line_end(self, i: int) -> int:
        """The first token that stands on a later line than token i."""
        return self.later[i] if i < len(self.tokens) else len(self.tokens)

    def strings(self, i: int, stop: int, start: int) -> None:
        for j in range(i, stop):
            if self.tokens[j][0] == "s":
                self.row("import", self.tokens[j][1].strip("\"'`"), line=self.line(start))

    def heritage(self, name: str, text: str) -> None:
        for clause, names in re.findall(r"\b(extends|implements)\s+([^{]*?)(?=\bextends\b|\bimplements\b|$)", text, re.S):
            for part in names.split(","):
                if found := simple_type(part):
                    self.row("relation", name, found, flag=clause == "implements")

    def uses(self, text: str, line: int) -> None:
        """A Rust use tree: its paths, without alias and braces."""
        head, brace, rest = text.partition("{")
        if head := head.removesuffix("::").removesuffix("::*"):
            self.row("import", head, line=line)
        if brace:
            for part in re.findall(r"[\w:]+", rest):
                self.row("import", part.removesuffix("::"), line=line)

    # -- Python

    def python(self) -> None:
        """Logical lines: tokens up to a line break outside of brackets and strings."""
        tokens, n, i = self.tokens, len(self.tokens), 0
        last = 1
        while i < n:
            if tokens[i][0] == "c":
                self.leave(self.indent(tokens[i][2]), last, only_if_deeper=True)
                self.comment(tokens[i][1], tokens[i][2])
                i += 1
                continue
            depth, j = 0, i
            while j < n:
                kind, text = tokens[j][:2]
                if j > i and depth <= 0 and "\n" in self.text[tokens[j - 1][3] : tokens[j][2]] and tokens[j - 1][1] != "\\":
                    break
                if kind == "p":
                    depth += (text in "([{") - (text in ")]}")
                j += 1
            at = self.indent(tokens[i][2])
            self.leave(at, last)
            last = self.line(tokens[j - 1][3] - 1)
            self.statement(i, j, at)
            i = j
        self.leave(-1, last)

    def indent(self, at: int) -> int:
        return at - (self.text.rfind("\n", 0, at) + 1)

    def leave(self, indent: int, last: int, only_if_deeper: bool = False) -> None:
        while len(self.stack) > 1 and self.stack[-1].indent >= indent:
            if only_if_deeper and self.stack[-1].indent > indent and indent > 0:
                break
            fact = self.stack.pop().fact
            fact[9], self.places[fact[1]][2] = last, self.breaks[last - 1] + 1 if last <= len(self.breaks) else len(self.text)

    def statement(self, i: int, j: int, at: int) -> None:
        tokens = self.tokens
        while True:  # declarations may follow each other on a line
            frame = self.stack[-1]
            k = i + (tokens[i][1] == "async")
            word = tokens[k][1] if k < j else ""
            if word == "@" or tokens[i][1] == "@":
                self.comment(self.span(i, j), tokens[i][2])
                return
            if word not in ("def", "class") or k + 1 >= j or tokens[k + 1][0] != "w":
                break
            name, opened = tokens[k + 1][1], k + 2
            if opened < j and tokens[opened][1] == "[":  # type parameters
                opened = self.closing(opened, j) + 1
            shut = self.closing(opened, j) if opened < j and tokens[opened][1] == "(" else None
            colon = self.until((shut or k + 1) + 1, ":", j)
            decorators = "".join(c[2] for c in frame.pending if c[2].startswith("@"))
            if word == "def":
                inner = self.callable("function", name, tokens[i][2], "", opened if shut else k + 1, shut or k + 1, self.returns((shut or k + 1) + 1, colon), decorators)
            else:
                inner = self.declare("class", "code_type", name, tokens[i][2], "", attributes=decorators)
                at_part = opened + 1
                while shut and at_part < shut:
                    end = self.until(at_part, ",", shut)
                    if found := simple_type(self.span(at_part, end)):
                        self.row("relation", name, found, flag=False)
                    at_part = end + 1
            inner.indent, inner.fact[9] = at, self.line(tokens[j - 1][3] - 1)
            self.places[inner.fact[1]][1] = tokens[colon][3] if colon < j else None
            self.stack.append(inner)
            if colon + 1 >= j:
                return
            i, at = colon + 1, at + 1
        frame.pending = []
        text = self.span(i, j)
        if word in ("import", "from"):
            line = self.line(tokens[i][2])
            m = re.match(r"from\s+([.\w\s]+?)\s+import\b|import\s+(.*)", text, re.S)
            if m:
                for part in [m[1]] if m[1] else m[2].split(","):
                    self.row("import", re.sub(r"\s", "", part.split(" as ")[0]), line=line)
            return
        if m := re.match(r"([\w.]+)\s*(?::([^=]*))?(?<![=!<>])=(?!=)(.*)|(\w+)\s*:\s*([\w.\[\]]+)\s*$", text, re.S):
            name, kind = m[1] or m[4], m[2] or m[5] or ""
            self.bind(name, kind.strip(), m[3] or "")
            if frame.kind == "class" and (found := simple_type(kind)):
                self.row("field", frame.owner, name, found)
        for x in range(i, j - 1):
            if tokens[x][0] == "w" and tokens[x + 1][1] == "(":
                self.call(x)
