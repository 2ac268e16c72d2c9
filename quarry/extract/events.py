"""What happens in the functions of a source file: statements, assignments, calls, control, in one form for all languages.

Go, Rust and C# are read from their tokens with matched brackets, Python from its
own parser. Later stages (`quarry.extract.facts`) give these events a meaning.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

from quarry.extract import lexers
from quarry.extract.structure import NO_CALL, PAIRS

Place = tuple[int, int, int, int]  # first line and column, last line and column, from 1


@dataclass
class Call:
    callee: str
    args: list[str]
    arg_names: list[list[str]]
    text: str
    place: Place
    names: list[str] = field(default_factory=list)  # of the receiver
    outputs: list[str] = field(default_factory=list)  # of the assignment whose whole right side it is
    targets: int = 0  # of that assignment, blank ones included
    blank: list[int] = field(default_factory=list)  # positions of blank targets
    loop: bool = False
    bare: bool = False  # a statement of its own
    go: bool = False
    deferred: bool = False
    inside: list[str] = field(default_factory=list)  # callees of the calls around it
    then: str = ""  # what is selected from its result
    literal: bool = False  # stands in a function literal


@dataclass
class Assign:
    outputs: list[str]
    inputs: list[str]
    left: str
    right: str
    text: str
    place: Place
    callee: str = ""
    conditional: bool = False
    call: Call | None = None


@dataclass
class Control:
    what: str
    place: Place
    text: str


@dataclass
class Start:
    """A goroutine is started."""

    text: str
    place: Place
    loops: list[str]  # the heads of the loops around it, outermost first
    inputs: list[str]


@dataclass
class Function:
    name: str
    receiver: str
    params: list[tuple[str, str, str]]  # name, type, whole text
    place: Place
    text: str
    head: str
    events: list[object] = field(default_factory=list)


@dataclass
class Return:
    names: list[str]
    text: str
    place: Place


@dataclass
class Unit:
    language: str
    text: str
    imports: dict[str, str]  # alias to path
    functions: list[Function]
    fields: dict[str, str] = field(default_factory=dict)  # struct field or global to type


_WORDS = {
    "Go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false".split()),
    "Rust": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()),
    "C#": frozenset("abstract as async await base bool break byte case catch char class const continue decimal default do double else enum false finally float for foreach if in int interface internal is lock long namespace new null object out override params private protected public readonly ref return sealed static string struct switch this throw true try typeof using var virtual void while".split()),
}
_CONTROL = {"Go": frozenset("if for switch case select".split()), "Rust": frozenset("if for while match loop unsafe".split()), "C#": frozenset("if for foreach while switch try using".split())}
_LOOPS = frozenset("for foreach while loop".split())
_LEXERS = {"Go": lexers.GO, "Rust": lexers.RUST, "C#": lexers.CS}


class _Reader:
    def __init__(self, language: str, text: str) -> None:
        self.language, self.text, self.words = language, text, _WORDS[language]
        self.kind: list[str] = []
        self.tok: list[str] = []
        self.at: list[int] = []
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        stack: list[int] = []
        self.ok = True
        for m in _LEXERS[language].finditer(text):
            k = m.lastgroup
            if k in ("nl", "end", "pp", None):
                continue
            i = len(self.tok)
            self.kind.append(k)
            self.tok.append(m[k])
            self.at.append(m.start(k))
            if k == "b" and m[k] in PAIRS:
                stack.append(i)
            elif k == "b":
                if not stack or PAIRS[self.tok[stack[-1]]] != m[k]:
                    self.ok = False
                    return
                self.open[i] = stack[-1]
                self.close[stack.pop()] = i
            elif k == "bad":
                self.ok = False
                return
        self.ok = not stack

    def line(self, offset: int) -> tuple[int, int]:
        import bisect

        n = bisect.bisect_right(self.lines, offset)
        return n, offset - self.lines[n - 1] + 1

    def place(self, a: int, b: int) -> Place:
        """From token a to the end of token b."""
        return (*self.line(self.at[a]), *self.line(self.at[b] + len(self.tok[b])))

    def source(self, a: int, b: int) -> str:
        return self.text[self.at[a] : self.at[b] + len(self.tok[b])] if a <= b else ""

    def t(self, i: int) -> str:
        return self.tok[i] if 0 <= i < len(self.tok) else ""

    def names(self, a: int, b: int) -> list[str]:
        """Names read between tokens a and b, inclusive: no members, callees, path prefixes or keywords."""
        out = []
        for i in range(a, b + 1):
            if self.kind[i] == "w" and self.tok[i] not in self.words and self.t(i - 1) not in (".", "::", "?.") and self.t(i + 1) not in ("(", "::") and self.tok[i] != "_":
                if not (self.language == "Go" and self.t(i + 1) == ":" and i < b):
                    out.append(self.tok[i])
            elif self.kind[i] == "s" and self.language == "C#" and self.tok[i].startswith("$"):
                out += re.findall(r"\{\s*([A-Za-z_]\w*)", self.tok[i])
        return list(dict.fromkeys(out))

    def chain(self, i: int) -> int:
        """The first token of the selector chain that ends in the name at i."""
        while self.t(i - 1) in (".", "::", "?."):
            i -= 2
            while i in self.open:  # a call or index before the dot
                i = self.open[i] - 1
            if i < 0 or self.kind[i] not in "ws":
                return i + 1
        return i

    def call(self, i: int) -> tuple[Call, int, int]:
        """The call of the name at i, its first and last token."""
        a, p = self.chain(i), i + 1
        e = self.close[p]
        args, names, start = [], [], p + 1
        j = p + 1
        while j <= e:
            if j == e or self.tok[j] == ",":
                if j > start:
                    args.append(self.source(start, j - 1))
                    names.append(self.names(start, j - 1))
                start = j + 1
            j = self.close.get(j, j) + 1 if j < e else j + 1
        then = self.tok[e + 2] if self.t(e + 1) in (".", "?.") and self.t(e + 3) != "(" and self.t(e + 2) else ""
        callee = re.sub(r"\s+", "", self.source(a, i))
        return Call(callee, args, names, self.source(a, e), self.place(a, e), names=self.names(a, i - 1) if i > a else [], then=then), a, e

    def statements(self, a: int, b: int, out: list[object], loop: bool, state: dict) -> None:
        """Events of the tokens a..b of a block."""
        go = self.language == "Go"
        i = a
        while i <= b:
            if self.tok[i] in (";", "}", ",") or self.kind[i] == "b" and self.tok[i] in ")]":
                i += 1
                continue
            if self.tok[i] == "{":
                self.statements(i + 1, self.close[i] - 1, out, loop, state)
                i = self.close[i] + 1
                continue
            j, body = i, -1
            while j <= b:
                t = self.tok[j]
                if t == ";" or (j > i and go and self._ends(j - 1) and self.line(self.at[j])[0] > self.line(self.at[j - 1] + len(self.tok[j - 1]))[0] and t not in (")", "]", "}")):
                    break
                if t == "{":
                    if not (go and self._literal(j, i)):
                        body = j
                        break
                    j = self.close[j] + 1
                    continue
                j = self.close.get(j, j) + 1
            last = min(j, b + 1) - 1
            self.statement(i, last, out, loop, state, body)
            word = self.tok[i]
            if body >= 0:
                inner = loop or word in _LOOPS or (self.language == "Rust" and self.t(i + 2) in _LOOPS)
                before = dict(state)
                if word == "for":
                    state["loops"] = [*state.get("loops", []), self.source(i, last)]
                if word in ("if", "else", "for", "switch", "while", "match", "foreach", "case", "loop", "try"):
                    state["conditional"] = True
                if go and word in ("go", "defer"):  # a function literal that runs beside or after the loop around it
                    self.statements(body + 1, self.close[body] - 1, out, False, {**state, "go": word == "go" or state.get("go"), "loops": [], "literal": True})
                else:
                    self.statements(body + 1, self.close[body] - 1, out, inner, state)
                state["conditional"], state["loops"] = before.get("conditional", False), before.get("loops", [])
                i = self.close[body] + 1
            else:
                i = max(j, i + 1)

    def _ends(self, i: int) -> bool:
        return self.kind[i] in "ns" or self.tok[i] in (")", "]", "}", "++", "--") or self.kind[i] == "w" and (self.tok[i] not in self.words or self.tok[i] in ("break", "continue", "return", "fallthrough", "nil", "true", "false"))

    def _literal(self, j: int, start: int) -> bool:
        """The Go brace at j opens a composite literal, not a block."""
        if self.tok[start] in ("if", "for", "switch", "select", "else", "func", "go", "defer"):
            return False
        p = self.t(j - 1)
        return self.kind[j - 1] == "w" and p not in self.words or p in ("]", "}") or p in ("=", ":=", ",", "(", "{", ":", "&")

    def statement(self, a: int, b: int, out: list[object], loop: bool, state: dict, body: int) -> None:
        if b < a:
            return
        word, lang = self.tok[a], self.language
        if word in _CONTROL[lang] or word == "else" and self.t(a + 1) == "if":
            what = "if" if word == "else" else word
            if not (what == "case" and self.t(a) == "default"):
                end = self.close.get(body, b) if body >= 0 else b
                out.append(Control(what, self.place(a, end), self.source(a, b)))
        for i in range(a, b + 1):
            if self.tok[i] in ("&&", "||"):
                out.append(Control("logical-and" if self.tok[i] == "&&" else "logical-or", self.place(i, i), self.tok[i]))
        if word == "go" and lang == "Go":
            out.append(Start(self.source(a, b), self.place(a, b), list(state.get("loops", [])), self.names(a, b)))
        if word == "return" or lang == "Rust" and body < 0 and b + 1 == state.get("end") and self.t(b) != ";" and word not in self.words:
            out.append(Return(self.names(a + (word == "return"), b), self.source(a, b), self.place(a, b)))
        eq = self._equals(a, b)
        assign: Assign | None = None
        if eq > 0:
            left_at = a + 1 if word in ("if", "for", "switch", "var", "let", "else", "while", "match", "using") else a
            left_at += self.tok[left_at] in ("if", "mut", "let", "(") if left_at < eq else 0
            outputs, count, blank = self._targets(left_at, eq - 1)
            right = eq + 1
            end = b
            for j in self._top(right, b):
                if self.tok[j] == ";" or self.tok[j] == "{" and self.tok[a] in ("if", "for", "switch"):
                    end = j - 1
                    break
            assign = Assign(outputs, self.names(right, end), self.source(left_at, eq - 1), self.source(right, end), self.source(a, end), self.place(a, end), conditional=state.get("conditional", False))
            if assign.outputs or count:
                out.append(assign)
        ends: list[tuple[int, str]] = []
        i = a
        while i <= b:
            while ends and i > ends[-1][0]:
                ends.pop()
            if self.kind[i] == "w" and self.t(i + 1) == "(" and self.tok[i] not in NO_CALL and self.t(i - 1) not in ("func", "fn") and self.tok[i] not in self.words:
                call, first, last = self.call(i)
                call.loop, call.inside = loop, [*state.get("around", []), *(c for _, c in ends)]
                call.go, call.deferred = word == "go", word == "defer"
                call.literal = state.get("literal", False)
                call.go = call.go or bool(state.get("go"))
                call.bare = first == a and last == b and eq < 0
                if assign is not None and (first == eq + 1 or first == eq + 2 and self.t(eq + 1) in ("await", "&", "range")) and assign.call is None:
                    assign.callee, assign.call = call.callee, call
                    call.outputs, call.targets, call.blank = assign.outputs, count, blank
                out.append(call)
                ends.append((last, call.callee))
            elif self.tok[i] == "{":  # a function literal, a closure or the elements of a literal
                # A started function runs beside the loop around it, not in it.
                apart = word in ("go", "defer") and lang == "Go"
                self.statements(i + 1, self.close[i] - 1, out, loop and not apart, {"literal": True, "go": state.get("go") or word == "go", "conditional": state.get("conditional", False), "loops": [] if apart else state.get("loops", []), "around": [*state.get("around", []), *(c for _, c in ends)]})
                i = self.close[i]
            i += 1

    def _top(self, a: int, b: int) -> list[int]:
        out, i = [], a
        while i <= b:
            out.append(i)
            i = self.close.get(i, i) + 1 if self.tok[i] != "{" else i + 1
        return out

    def _equals(self, a: int, b: int) -> int:
        for i in self._top(a, b):
            if self.tok[i] in (":=", "=", "+="):
                return i
            if self.tok[i] in ("{", "=>"):
                return -1
        return -1

    def _targets(self, a: int, b: int) -> tuple[list[str], int, list[int]]:
        """Names assigned, how many targets there are, and which are blank."""
        parts, start = [], a
        for i in [*self._top(a, b), b + 1]:
            if i == b + 1 or self.tok[i] == ",":
                parts.append((start, i - 1))
                start = i + 1
        out, blank = [], []
        for n, (x, y) in enumerate(parts):
            words = [i for i in range(x, y + 1) if self.kind[i] == "w" and (self.tok[i] not in self.words or self.tok[i] == "_")]
            if self.language == "Rust":
                words = words[:1]
            elif self.language == "C#":
                words = words[-1:]
            elif self.language == "Go" and words and any(self.tok[i] == "." for i in range(x, y + 1)):
                words = words[:1]
            elif words:
                words = words[:1]
            if words and self.tok[words[0]] == "_":
                blank.append(n)
            elif words:
                out.append(self.tok[words[0]])
        return out, len(parts), blank


def _params(r: _Reader, at: int) -> list[tuple[str, str, str]]:
    """(name, type, text) of each parameter of the list that opens at `at`."""
    end, parts, start, depth = r.close[at], [], at + 1, 0
    i = at + 1
    while i <= end:
        depth += (r.tok[i] == "<") - (r.tok[i] == ">") if r.language != "Go" else 0
        if i == end or r.tok[i] == "," and depth <= 0:
            if i > start:
                parts.append((start, i - 1))
            start = i + 1
        i = r.close.get(i, i) + 1 if i < end and r.tok[i] in PAIRS else i + 1
    out: list[tuple[str, str, str]] = []
    kind = ""
    for a, b in reversed(parts):
        whole = r.source(a, b)
        if r.language == "Go":
            if b > a:
                kind = r.source(a + 1, b)
            out.append((r.tok[a], kind, whole))
        elif r.language == "Rust":
            colon = next((j for j in range(a, b + 1) if r.tok[j] == ":"), -1)
            words = [r.tok[j] for j in range(a, colon if colon > 0 else b + 1) if r.kind[j] == "w" and r.tok[j] not in ("mut", "ref")]
            if words and words[-1] != "self" and colon > 0:
                out.append((words[-1], r.source(colon + 1, b), whole))
        else:
            eq = next((j for j in range(a, b + 1) if r.tok[j] == "="), b + 1)
            words = [j for j in range(a, eq) if r.kind[j] == "w"]
            if words:
                first = next((j for j in range(a, eq) if r.tok[j] != "[" and j not in r.open and not any(r.open[c] < j < c for c in r.open if a <= r.open[c] and r.tok[r.open[c]] == "[" and c < eq)), a)
                out.append((r.tok[words[-1]], re.sub(r"^(?:this|ref|out|in|params)\s+", "", r.source(first, words[-1] - 1)) if words[-1] > first else "", whole))
    return out[::-1]


def _function(r: _Reader, name: str, receiver: str, head: int, args: int, body: int, extra: list[tuple[str, str, str]] = ()) -> Function:
    end = r.close[body]
    out = Function(name, receiver, [*extra, *_params(r, args)], r.place(head, end), r.source(head, end), r.source(head, body - 1))
    r.statements(body + 1, end - 1, out.events, False, {"end": end})
    return out


def _go(text: str) -> Unit | None:
    r = _Reader("Go", text)
    if not r.ok or r.t(0) != "package":
        return None
    unit = Unit("Go", text, {}, [])
    i, n = 0, len(r.tok)
    while i < n:
        t = r.tok[i]
        if t == "import":
            a, b = (i + 2, r.close[i + 1]) if r.t(i + 1) == "(" else (i + 1, i + 3)
            for j in range(a, min(b, n)):
                if r.kind[j] == "s":
                    path = r.tok[j][1:-1]
                    base = path.rsplit("/", 1)[-1]
                    if re.fullmatch(r"v\d+", base):
                        base = path.rsplit("/", 2)[-2]
                    alias = r.tok[j - 1] if r.kind[j - 1] == "w" and r.tok[j - 1] != "import" or r.tok[j - 1] == "." else base
                    unit.imports[alias] = path
                    if r.t(i + 1) != "(":
                        break
            i = b if r.t(i + 1) == "(" else i + 1 if r.kind[min(i + 1, n - 1)] == "s" else i + 2
        elif t == "func":
            at, own, extra = i + 1, "", []
            if r.t(at) == "(":
                got = _params(r, at)
                extra = [(x, k, w) for x, k, w in got if k]
                own = re.sub(r"[*&\s]|\[.*", "", got[0][1] or got[0][0]) if got else ""
                at = r.close[at] + 1
            args = at + 1
            if r.t(args) == "[":
                args = r.close[args] + 1
            j = r.close.get(args, args) + 1
            while j < n and r.tok[j] != "{" and r.tok[j] not in ("func", "type", "var", "const"):
                j = r.close.get(j, j) + 1
            if r.t(args) == "(" and r.t(j) == "{":
                unit.functions.append(_function(r, r.t(at), own, i, args, j, extra))
                i = r.close[j]
        elif t == "type" and r.t(i + 2) == "struct":
            for m in re.finditer(r"(?m)(?:^|[{;])[ \t]*(\w+(?:\s*,\s*\w+)*)[ \t]+(\*?[\w.]+)", r.source(i + 3, r.close.get(i + 3, i + 3))):
                for x in re.split(r"\s*,\s*", m[1]):
                    unit.fields[x] = m[2]
        elif t == "var" and r.kind[min(i + 2, n - 1)] in "wo" and r.t(i + 1) != "(":
            line = text[r.at[i] : text.find("\n", r.at[i]) if "\n" in text[r.at[i] :] else len(text)]
            if m := re.match(r"var\s+(\w+)\s+(\*?[\w.]+)", line):
                unit.fields[m[1]] = m[2]
        i = r.close.get(i, i) + 1
    return unit


def _rust(text: str) -> Unit | None:
    r = _Reader("Rust", re.sub(r"/\*[^*/]*\*/", lambda m: " " * len(m[0]), text))
    if not r.ok:
        return None
    unit = Unit("Rust", text, {}, [])
    for m in re.finditer(r"(?m)^[ \t]*(?:pub\s+)?use\s+([^;]+);", text):
        unit.imports[m[1].strip()] = m[1].strip()
    i, n, owner = 0, len(r.tok), [("", 1 << 60)]
    while i < n:
        while i > owner[-1][1]:
            owner.pop()
        t = r.tok[i]
        if t in ("impl", "trait"):
            j = i
            while j < n and r.tok[j] not in ("{", ";"):
                j += 1
            if r.t(j) == "{":
                head = re.sub(r"<[^<>]*>", "", r.source(i + 1, j - 1))
                if t == "trait":
                    unit.functions.append(Function("", "", [], r.place(i, r.close[j]), "", "", [Control("trait", r.place(i, j), r.source(i, j - 1))]))
                owner.append((re.sub(r".*\bfor\b\s*|\bwhere\b.*|\W", "", head, flags=re.S), r.close[j]))
                i = j + 1
                continue
        if t == "fn" and r.kind[min(i + 1, n - 1)] == "w":
            args = i + 2
            while args < n and r.tok[args] != "(":
                args += 1
            j = r.close.get(args, n) + 1
            while j < n and r.tok[j] not in ("{", ";"):
                j = r.close.get(j, j) + 1
            if r.t(j) == "{":
                head = i
                while head and r.tok[head - 1] in ("pub", "async", "unsafe", "const", "extern"):
                    head -= 1
                unit.functions.append(_function(r, r.tok[i + 1], owner[-1][0], head, args, j))
                i = r.close[j] + 1
                continue
        i += 1
    return unit


def _cs(text: str) -> Unit | None:
    r = _Reader("C#", text)
    if not r.ok:
        return None
    unit = Unit("C#", text, {}, [])
    for m in re.finditer(r"(?m)^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", text):
        unit.imports[m[1] or m[2]] = m[2]
    i, n, owner = 0, len(r.tok), [("", 1 << 60)]
    while i < n:
        while i > owner[-1][1]:
            owner.pop()
        t = r.tok[i]
        if t in ("class", "struct", "interface", "record") and r.kind[min(i + 1, n - 1)] == "w":
            j = i
            while j < n and r.tok[j] not in ("{", ";"):
                j = r.close.get(j, j) + 1
            if r.t(j) == "{":
                owner.append((r.tok[i + 1], r.close[j]))
                i = j + 1
                continue
        if owner[-1][0] and r.kind[i] == "w" and t not in r.words and r.t(i + 1) == "(" and i and (r.kind[i - 1] == "w" and r.tok[i - 1] not in ("new", "return") or r.tok[i - 1] in (">", "]", "?", "}")):
            j = r.close[i + 1] + 1
            while j < n and r.tok[j] not in ("{", ";", "=>", "="):
                j = r.close.get(j, j) + 1
            if r.t(j) == "{":
                head = i - 1
                while head > 0 and r.tok[head - 1] not in (";", "{", "}"):
                    head -= 1
                unit.functions.append(_function(r, t, owner[-1][0], head, i + 1, j))
                i = r.close[j] + 1
                continue
        i += 1
    return unit


def _python(text: str) -> Unit | None:
    text = text.lstrip("﻿")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    unit = Unit("Python", text, {}, [])
    # Offsets of the parser are in bytes of UTF-8; each node's text is cut from its own lines.
    lines = text.encode("utf-8", "replace").splitlines(keepends=True)

    def place(x: ast.AST) -> Place:
        return x.lineno, x.col_offset + 1, x.end_lineno or x.lineno, (x.end_col_offset or 0) + 1

    def source(x: ast.AST) -> str:
        a, b, c, d = x.lineno - 1, x.col_offset, (x.end_lineno or x.lineno) - 1, x.end_col_offset or 0
        raw = lines[a][b:d] if a == c else b"".join([lines[a][b:], *lines[a + 1 : c], lines[c][:d]])
        return raw.decode("utf-8", "replace")

    def names(x: ast.AST | None) -> list[str]:
        if x is None:
            return []
        called = {id(c.func) for c in ast.walk(x) if isinstance(c, ast.Call)}
        return list(dict.fromkeys(n.id for n in ast.walk(x) if isinstance(n, ast.Name) and id(n) not in called))

    def visit(x: ast.AST, out: list[object], loop: bool, conditional: bool, around: list[str]) -> None:
        if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            declare(x)
            return
        if isinstance(x, ast.Assign | ast.AnnAssign | ast.AugAssign) and x.value is not None:
            targets = x.targets if isinstance(x, ast.Assign) else [x.target]
            flat = [y for t in targets for y in (t.elts if isinstance(t, ast.Tuple | ast.List) else [t])]
            outputs = [y.id if isinstance(y, ast.Name) else y.attr for y in flat if isinstance(y, ast.Name | ast.Attribute)]
            value = x.value.value if isinstance(x.value, ast.Await) else x.value
            made = Assign(outputs, names(x.value), source(flat[0]), source(x.value), source(x), place(x), conditional=conditional)
            if isinstance(value, ast.Call):
                made.callee = source(value.func)
            out.append(made)
        kinds = {ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.Try: "try", ast.With: "with", ast.AsyncWith: "with", ast.Match: "match"}
        if type(x) in kinds:
            test = getattr(x, "test", None)
            out.append(Control(kinds[type(x)], place(x), source(test) if test is not None else ""))
        if isinstance(x, ast.Return):
            out.append(Return(names(x.value), source(x), place(x)))
        inner = around
        if isinstance(x, ast.Call):
            args = [*x.args, *[k.value for k in x.keywords]]
            texts = [*(source(a) for a in x.args), *(f"{k.arg}={source(k.value)}" if k.arg else source(k.value) for k in x.keywords)]
            callee = source(x.func)
            out.append(Call(callee, texts, [names(a) for a in args], source(x), place(x), names=names(x.func) if isinstance(x.func, ast.Attribute) else [], loop=loop, inside=list(around)))
            inner = [*around, callee]
        deeper = loop or isinstance(x, ast.For | ast.AsyncFor | ast.While)
        branch = conditional or isinstance(x, ast.If | ast.For | ast.AsyncFor | ast.While | ast.Try | ast.Match)
        for y in ast.iter_child_nodes(x):
            visit(y, out, deeper, branch, inner)

    def declare(x: ast.AST, owner: str = "") -> None:
        if isinstance(x, ast.ClassDef):
            made = Function("", "", [], place(x), "", "", [Control("class", place(x), f"class {x.name}")])
            unit.functions.append(made)
            for y in x.body:
                declare(y, x.name) if isinstance(y, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else visit(y, made.events, False, False, [])
            return
        a = x.args
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        params = [(p.arg, source(p.annotation) if p.annotation else "", source(d) if d is not None else "") for p, d in [*zip(plain, defaults, strict=True), *zip(a.kwonlyargs, a.kw_defaults, strict=True)] if p.arg not in ("self", "cls")]
        made = Function(x.name, owner, params, place(x), source(x), " ".join(source(d) for d in x.decorator_list))
        made.events.append(Control("function", place(x), f"def {x.name}"))
        unit.functions.append(made)
        for y in x.body:
            visit(y, made.events, False, False, [])

    top = Function("", "", [], (1, 1, max(1, len(lines)), 1), "", "")
    unit.functions.append(top)
    for x in tree.body:
        if isinstance(x, ast.Import):
            for n in x.names:
                unit.imports[n.asname or n.name] = n.name
        elif isinstance(x, ast.ImportFrom):
            for n in x.names:
                unit.imports[n.asname or n.name] = f"{x.module or ''}.{n.name}"
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            declare(x)
        else:
            visit(x, top.events, False, False, [])
    return unit


READERS = {"Go": _go, "Python": _python, "Rust": _rust, "C#": _cs}


def read(language: str, text: str) -> Unit | None:
    """The unit of a file, None if it cannot be read."""
    return READERS[language](text)
