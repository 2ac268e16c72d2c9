"""Functions, types and calls of source files, by lexers; Python's by its own parser."""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.extract import lexers

PAIRS = {"(": ")", "[": "]", "{": "}"}
# Words that may stand before a parenthesis without being a call.
NO_CALL = frozenset("if for while switch catch using lock fixed return func fn match case in and or not elif except with assert await when foreach sizeof typeof nameof default import go defer select range new throw yield else do try union let mut impl where as is".split())
CONTROL = {"Go": frozenset("if for case select && ||".split()), "Rust": frozenset("if while for match loop && ||".split()), "C#": frozenset("if while for foreach case catch && ||".split())}
SCHEMA = "kind string, name string, receiver string, caller string, params array<string>, start_line int, end_line int, decisions int"

Record = tuple[str, str, str | None, str | None, list[str], int, int, int]


class Source:
    """Tokens with their lines, and for each opening bracket its partner."""

    def __init__(self, lexer: re.Pattern[str], text: str) -> None:
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[tuple[str, str, int]] = []
        for m in lexer.finditer(text):
            k = m.lastgroup
            if k not in ("nl", "end", "pp", None):
                self.tokens.append((k, m[k], bisect.bisect_right(starts, m.start(k))))
        self.close: dict[int, int] = {}
        stack: list[int] = []
        self.ok = True
        for i, (k, t, _) in enumerate(self.tokens):
            if k == "b" and t in PAIRS:
                stack.append(i)
            elif k == "b":
                if not stack or PAIRS[self.tokens[stack[-1]][1]] != t:
                    self.ok = False
                    return
                self.close[stack.pop()] = i
            elif k == "bad":
                self.ok = False
                return
        self.ok = not stack

    def word(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) and self.tokens[i][0] == "w" else ""

    def text(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def find(self, i: int, stop: str, upto: int) -> int:
        """The next `stop` at this depth from i on, or -1; a semicolon ends the search."""
        while 0 <= i < upto:
            t = self.text(i)
            if t == stop:
                return i
            if t == ";":
                return -1
            i = self.close.get(i, i) + 1
        return -1


def _params(s: Source, at: int, first: bool) -> list[str]:
    """Names of a parameter list: the first or the last word of each part, the receiver `self` left out."""
    out, part = [], []
    end = s.close[at]
    i = at + 1
    while i <= end:
        t = s.text(i)
        if i == end or t == ",":
            words = [x for x in part if re.match(lexers.WORD, x)]
            if words and "self" not in words:
                out.append(words[0 if first else -1])
            part = []
        elif not part or not first:
            part.append(t)
        i = s.close.get(i, i) + 1 if t in PAIRS and i < end else i + 1
    return out


def _calls(s: Source, a: int, b: int, caller: str, receiver: str | None, out: list[Record]) -> None:
    for i in range(a, b):
        name = s.word(i)
        if not name or s.text(i + 1) != "(" or name in NO_CALL or s.word(i - 1) in ("func", "fn", "new"):
            continue
        owner = None
        if s.text(i - 1) in (".", "::", "?.") and s.tokens[i - 2][0] == "w":
            owner = s.word(i - 2)
        out.append(("call", name, owner, f"{receiver}.{caller}" if receiver else caller, [], s.tokens[i][2], s.tokens[i][2], 0))


def _function(s: Source, name: str, receiver: str | None, params: list[str], head: int, body: int, control: frozenset[str], out: list[Record]) -> None:
    end = s.close[body]
    decisions = sum(1 for k, t, _ in s.tokens[body:end] if t in control and k in "wo")
    out.append(("function", name, receiver, None, params, s.tokens[head][2], s.tokens[end][2], decisions))
    _calls(s, body + 1, end, name, receiver, out)


def _go(text: str) -> list[Record] | None:
    s = Source(lexers.GO, text)
    if not s.ok or s.text(0) != "package":
        return None
    out: list[Record] = []
    i, n = 0, len(s.tokens)
    while i < n:
        t = s.text(i)
        if t == "func":
            at, receiver = i + 1, None
            if s.text(at) == "(":
                receiver = s.word(s.close[at] - 1) or next((s.word(j) for j in range(s.close[at] - 1, at, -1) if s.word(j)), None)
                at = s.close[at] + 1
            name, args = s.word(at), at + 1
            if s.text(args) == "[":
                args = s.close[args] + 1
            if name and s.text(args) == "(":
                j = s.close[args] + 1
                while j < n and s.text(j) != "{" and s.text(j) not in ("func", "type", "var", "const"):
                    j = s.close.get(j, j) + 1
                if s.text(j) == "{":
                    _function(s, name, receiver, _params(s, args, True), i, j, CONTROL["Go"], out)
                    i = s.close[j] + 1
                    continue
        elif t == "type" and s.word(i + 1):
            j = i + 2
            end = s.close.get(j + 1, i + 2) if s.text(j) in ("struct", "interface") else j
            out.append(("type", s.word(i + 1), s.word(j) if s.word(j) in ("struct", "interface") else "alias", None, [], s.tokens[i][2], s.tokens[min(end, n - 1)][2], 0))
        i = s.close.get(i, i) + 1
    return out


def _rust(text: str) -> list[Record] | None:
    plain = re.sub(r"/\*[^*/]*\*/", " ", text)
    s = Source(lexers.RUST, plain)
    if not s.ok:
        return None
    out: list[Record] = []

    def items(a: int, b: int, owner: str | None) -> None:
        i = a
        while i < b:
            t = s.text(i)
            if t in ("impl", "trait", "mod"):
                body = s.find(i, "{", b)
                if body < 0:
                    i += 1
                    continue
                words = [j for j in range(i + 1, body) if s.word(j)]
                at = [j for j in words if s.word(j) == "for"]
                names = [j for j in words if (not at or j > at[-1]) and s.word(j) not in ("where", "dyn")]
                name = s.word(names[0]) if names else ""
                if t == "impl" and s.text(i + 1) == "<" and not at:
                    depth, j = 0, i + 1
                    while j < body:
                        depth += (s.text(j) == "<") - (s.text(j) == ">")
                        j += 1
                        if depth == 0:
                            break
                    name = s.word(j)
                if t == "trait":
                    out.append(("type", name, "trait", None, [], s.tokens[i][2], s.tokens[s.close[body]][2], 0))
                items(body + 1, s.close[body], owner if t == "mod" else name)
                i = s.close[body] + 1
                continue
            if t == "fn" and s.word(i + 1):
                args = s.find(i, "(", b)
                body = s.find(args, "{", b) if args > 0 else -1
                if body > 0:
                    _function(s, s.word(i + 1), owner, _params(s, args, True), i, body, CONTROL["Rust"], out)
                    i = s.close[body] + 1
                    continue
            if t in ("struct", "enum", "union") and s.word(i + 1):
                out.append(("type", s.word(i + 1), t, None, [], s.tokens[i][2], s.tokens[i][2], 0))
            i = s.close.get(i, i) + 1

    items(0, len(s.tokens), None)
    return out


def _cs(text: str) -> list[Record] | None:
    s = Source(lexers.CS, text)
    if not s.ok:
        return None
    out: list[Record] = []

    def members(a: int, b: int, owner: str | None) -> None:
        i = a
        while i < b:
            t = s.text(i)
            if t in ("class", "struct", "interface", "enum", "record", "namespace"):
                body = s.find(i, "{", b)
                if body > 0:
                    name = s.word(i + 1)
                    if t != "namespace":
                        out.append(("type", name, t, None, [], s.tokens[i][2], s.tokens[s.close[body]][2], 0))
                    members(body + 1, s.close[body], owner if t == "namespace" else name)
                    i = s.close[body] + 1
                    continue
            if owner and s.word(i) and s.text(i + 1) == "(" and (s.tokens[i - 1][0] == "w" or s.text(i - 1) in (">", "]", "?")):
                j = s.close[i + 1] + 1
                body = s.find(j, "{", b)
                if body > 0 and all(x not in ("=", "=>") for x in (s.text(k) for k in range(j, body))):
                    _function(s, s.word(i), owner, _params(s, i + 1, False), i, body, CONTROL["C#"], out)
                    i = s.close[body] + 1
                    continue
            i = s.close.get(i, i) + 1

    members(0, len(s.tokens), None)
    return out


def _python(text: str) -> list[Record] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[Record] = []
    branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case, ast.comprehension)

    def walk(node: ast.AST, caller: str | None, owner: str | None) -> int:
        decisions = 0
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                a = x.args
                names = [p.arg for p in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])] if p.arg not in ("self", "cls")]
                at = len(out)
                n = walk(x, f"{owner}.{x.name}" if owner else x.name, None)
                out.insert(at, ("function", x.name, owner, None, names, x.lineno, x.end_lineno or x.lineno, n))
                continue
            if isinstance(x, ast.ClassDef):
                out.append(("type", x.name, "class", None, [], x.lineno, x.end_lineno or x.lineno, 0))
                walk(x, None, x.name)
                continue
            if isinstance(x, ast.Call) and caller:
                f = x.func
                if isinstance(f, ast.Name):
                    out.append(("call", f.id, None, caller, [], x.lineno, x.lineno, 0))
                elif isinstance(f, ast.Attribute):
                    out.append(("call", f.attr, f.value.id if isinstance(f.value, ast.Name) else None, caller, [], x.lineno, x.lineno, 0))
            decisions += isinstance(x, branches) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
            decisions += walk(x, caller, owner if caller is None else None)
        return decisions

    walk(tree, None, None)
    return out


EXTRACTORS = {"Go": _go, "Python": _python, "Rust": _rust, "C#": _cs}


def records(files: DataFrame, key: str = "file_id", language: str = "language", content: str = "content") -> DataFrame:
    """(key, kind, name, receiver, caller, params, start_line, end_line, decisions) of each file.

    kind is function, type, call or parsed; one row `parsed` with end_line 1 or 0
    tells whether the file was read. A file that cannot be read gives nothing
    else. Null contents and languages without an extractor give no row.
    """
    kind = files.schema[key].dataType.simpleString()
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32()]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            rows: list[Record] = []
            for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if text is None or lang not in EXTRACTORS:
                    continue
                found = EXTRACTORS[lang](text)
                own: list[Record] = [("parsed", lang, None, None, [], 1, int(found is not None), 0), *(found or [])]
                rows += own
                take += [i] * len(own)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *names])

    return files.select(key, language, content).mapInArrow(extract, f"`{key}` {kind}, {SCHEMA}")
