"""Is a source text valid in its language? Lexers with a pushdown stack.

`problem(language, text)` names the first thing found wrong, or returns None.
Each language has a lexer of one alternation; a literal or comment that never
ends is a token of its own. A pushdown stack of brackets follows the tokens
and carries, for each open bracket, what may come next: an operand or an
operator. That finds unbalanced delimiters, premature ends, operands without
an operator between them, operators without an operand, and text of another
kind under the suffix. Conflict markers outside of literals are never valid.

For Python the standard library's own parser follows as an exact check.
"""

from __future__ import annotations

import ast
import re
import warnings

from quarry.extract.lexers import CS as _CS
from quarry.extract.lexers import GO as _GO
from quarry.extract.lexers import JS as _JS
from quarry.extract.lexers import RUST as _RUST
from quarry.extract.lexers import WORD as _WORD
from quarry.extract.lexers import lexer as _lexer

# Suffix to language.
SUFFIXES = {"go": "Go", "py": "Python", "rs": "Rust", "cs": "C#", "js": "JavaScript", "cjs": "JavaScript"}

_PAIRS = {"(": ")", "[": "]", "{": "}"}
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |\r?$)|^={7}\r?$", re.M)


def language_of(path: str | None) -> str | None:
    """By suffix, without regard to case."""
    return SUFFIXES.get(path.rpartition(".")[2].lower()) if path and "." in path else None


def problem(language: str | None, text: str | None) -> str | None:
    """What is wrong first, or None. A null text or unknown language has no problem; an empty text only in Go."""
    if text is None or language not in _CHECKS:
        return None
    if text[:1] == "﻿":
        text = text[1:]
    return _CHECKS[language](text)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_JS_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_RUST_DOC_END = re.compile(r"(?:^|\n)[ \t]*///(?!/)[^\n]*\s*\Z")
_RUST_COMMENT = re.compile(r"/\*|\*/")
_PY_BAD = re.compile(r"\x00")


def _tokens(lexer: re.Pattern[str], text: str) -> list[tuple[str, str]] | str:
    """(kind, text); newlines stay where they are a kind."""
    out = [(m.lastgroup, m[m.lastindex]) for m in lexer.finditer(text)]
    while out and out[-1][0] == "end":
        out.pop()
    if any(k == "bad" for k, _ in out):
        m = next(m for m in lexer.finditer(text) if m.lastgroup == "bad")
        return _named(m["bad"], text, m.start("bad"))
    return out


def _named(ch: str, text: str, at: int) -> str:
    if ch in "\"'`":
        return "unterminated literal"
    if text.startswith("/*", at):
        return "unterminated comment"
    return "illegal character"


# ---------------------------------------------------------------- Go

# The words of the language.
_GO_WORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
_GO_TOP = frozenset("import func var const type".split())
_GO_ENDS = frozenset("break continue fallthrough return".split())
_GO_BINARY = frozenset("<<= >>= &^= && || == != <= >= := += -= *= /= %= &= |= ^= << >> &^ / % | = . : ~".split()) - {":", "."}
_GO_CLAUSE = frozenset("if for switch select".split())


def _go(text: str) -> str | None:
    if _CONFLICT.search(text) and _marker_outside(_GO, text):
        return "merge conflict marker"
    toks = _tokens(_GO, text)
    if isinstance(toks, str):
        return toks
    out: list[tuple[str, str]] = []  # with the semicolons that ends of lines stand for
    ended = False
    for k, t in toks:
        if k == "nl":
            if ended:
                out.append(("o", ";"))
                ended = False
            continue
        out.append((k, t))
        ended = (k == "w" and (t not in _GO_WORDS or t in _GO_ENDS)) or k in "ns" or t in (")", "]", "}", "++", "--")
    if ended:
        out.append(("o", ";"))
    out = [x for i, x in enumerate(out) if not (x[1] == ";" and i and out[i - 1][1] == ";")]
    if len(out) < 3 or out[0][1] != "package" or out[1][0] != "w" or out[1][1] in _GO_WORDS or out[2][1] != ";":
        return "no package clause"
    stack: list[tuple[str, str]] = []  # bracket, what it holds: block, fields, values, types
    start = True  # of a statement
    head = ""  # keyword of the current statement
    prev: tuple[str, str] = ("o", ";")
    pprev: tuple[str, str] = ("o", ";")
    for i in range(3, len(out)):
        k, t = out[i]
        holds = stack[-1][1] if stack else "top"
        if start and holds == "top" and t not in _GO_TOP and t != ";":
            return "unexpected text outside of a declaration"
        if start and t != ";":
            head = t if t in _GO_WORDS else ""
        before = start
        start = False
        pk, pt = prev
        operand = (pk == "w" and pt not in _GO_WORDS) or pk in "ns" or pt in (")", "]", "}")
        if k == "b" and t in "([{":
            kind = holds
            if t == "{":
                if pt == "if":
                    return "operator without operand"
                if pt in ("struct", "interface"):
                    kind = "fields"
                elif before or pt in (")", "else", "select", "switch", "for", ";", "{", ":") or head in _GO_CLAUSE or head == "func" or (head == "else"):
                    kind = "block"
                elif pt == "," or pt == "(" or pt == ":":
                    kind = "values"
                elif pk == "w" and _after_signature(out, i):
                    kind = "block"
                else:
                    kind = "values"
            elif t == "(":
                kind = "group" if head in _GO_TOP and pt in _GO_TOP and head != "func" else "list"
            else:
                kind = "list"
            stack.append((t, kind, head))
            start = kind in ("block", "fields", "group")
            if start:
                head = ""
        elif k == "b":
            if not stack or _PAIRS[stack[-1][0]] != t:
                return "unbalanced delimiter"
            if pk == "o" and pt not in (";", ",", "...", "++", "--", ":", "*", "&") and not (t == "]" and pt == ".") or (pt in (",",) and stack[-1][0] == "(" and pprev[1] == "("):
                return "operator without operand"
            head = stack.pop()[2]
        elif k == "o":
            if t == ";":
                if pk == "o" and pt not in (";", "++", "--", ":", ",", "..."):
                    return "operator without operand"
                if pk == "w" and pt in _GO_WORDS and pt not in _GO_ENDS and pt not in ("select", "for", "switch", "default", "else", "chan", "interface", "struct"):
                    return "premature end of a statement"
                if holds in ("list", "values") and pt != ";":
                    if head not in ("for", "if", "switch") or holds == "list":
                        return "line ends inside a bracket"
                if pt in _GO_TOP:
                    return "premature end of a declaration"
                if not stack and head == "type" and out[i - 2][1] == "type":
                    return "premature end of a declaration"
                start = not (head in _GO_CLAUSE and pt != "}" and holds == "block")  # a header goes on
            elif t in _GO_BINARY or t in (",",):
                if not operand and not (t == "," and pt in (";",)) and not (t == "|" or t == "~" or t == "="):
                    return "operator without operand"
                if t == "=" and not operand:
                    return "operator without operand"
            elif t == ":":
                if holds == "block":
                    start = True
                    head = ""
        elif k in "ns":
            if pk in "ns" or pt in ("}",):
                return "two operands without an operator"
            if operand and k == "n":
                return "two operands without an operator"
            if operand and holds not in ("fields", "group") and head != "import":
                return "two operands without an operator"
        elif t not in _GO_WORDS:
            if pk in "ns":
                return "two operands without an operator"
            if pk == "w" and pt not in _GO_WORDS and pprev[0] == "w" and pprev[1] not in _GO_WORDS:
                return "two operands without an operator"
            if pk == "w" and pt not in _GO_WORDS and holds in ("block", "values") and head not in ("var", "const", "type", "import", "func"):
                return "two operands without an operator"
            if pt == "}" and holds in ("block", "top") or pt == ")" and holds == "block" and head not in ("func", "var", "defer", "go", "return") and not _after_signature(out, i + 1):
                return "two operands without an operator"
        elif pk in "ns" or (operand and t in ("package", "import", "return", "defer", "go", "break", "var", "const", "case", "type", "if", "for", "switch")):
            return "two operands without an operator"
        elif t in ("import", "package") and stack:
            return "declaration inside a block"
        elif t == "else" and pt != "}" or pt == "else" and t != "if":
            return "unexpected text"
        if pt == "func" and t != "(" and (k != "w" or t in _GO_WORDS):
            return "declaration without a name"
        if not stack and t == ";" and head == "func" and not _has_parameters(out, i):
            return "premature end of a declaration"
        pprev, prev = prev, (k, t)
    if stack or out[-1][1] != ";":
        return "premature end"
    return None


def _has_parameters(out: list[tuple[str, str]], i: int) -> bool:
    """The function declared before the semicolon at i has a name and then parameters."""
    depth, j = 0, i - 1
    while j > 2 and not (depth == 0 and out[j][1] == ";"):
        depth += (out[j][1] in (")", "]", "}")) - (out[j][1] in ("(", "[", "{"))
        j -= 1
    words = out[j + 1 : i]
    at = 1
    if len(words) > 1 and words[1][1] == "(":
        while at < len(words) and words[at][1] != ")":
            at += 1
        at += 1
    return at + 1 < len(words) and words[at][0] == "w" and words[at + 1][1] in ("(", "[")


def _after_signature(out: list[tuple[str, str]], i: int) -> bool:
    """A `func` with its parameters comes shortly before: the words before i are its result."""
    depth = 0
    for j in range(i - 1, 2, -1):
        t = out[j][1]
        if t in ")]}":
            depth += 1
        elif t in ("(", "[", "{"):
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0 and t == "func":
            return True
        elif depth == 0 and t in (";", ":=", "=", ","):
            return False
    return False


# ---------------------------------------------------------------- Rust

# The words of the language.
_RUST_WORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()
)
_RUST_TOP = frozenset("pub use mod fn struct enum union impl trait const static type extern unsafe async macro_rules auto default safe".split())
_RUST_VALUES = frozenset("self Self super crate true false".split())
_RUST_STATEMENT = frozenset("let use fn struct enum impl trait static mod".split())
_RUST_BINARY = frozenset("<<= >>= == != <= >= += -= *= /= %= &= |= ^= / % ^ = =>".split())


def _rust(text: str) -> str | None:
    if _CONFLICT.search(text) and _marker_outside(_RUST, text):
        return "merge conflict marker"
    text = re.sub(r"^#![^\[\n][^\n]*", "", text)
    toks: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        for m in _RUST.finditer(text, at):
            k = m.lastgroup
            if k == "cm":
                depth, at = 0, m.start("cm")
                for c in _RUST_COMMENT.finditer(text, at):
                    depth += 1 if c.group() == "/*" else -1
                    if depth == 0:
                        at = c.end()
                        break
                else:
                    return "unterminated comment"
                break
            if k == "bad":
                return _named(m["bad"], text, m.start("bad"))
            if k != "end":
                toks.append((k, m[m.lastindex]))
        else:
            break
    stack: list[tuple[str, bool]] = []  # bracket, inside of a macro call or attribute
    start, want = True, ""
    prev: tuple[str, str] = ("o", ";")
    pprev = prev
    for i, (k, t) in enumerate(toks):
        loose = bool(stack) and stack[-1][1]
        nxt = toks[i + 1][1] if i + 1 < len(toks) else ""
        pk, pt = prev
        if not stack and start:
            if t == "#":
                want = "inner" if nxt == "!" else "attribute"
            elif not (t in _RUST_TOP or (k == "w" and t not in _RUST_WORDS and nxt in ("!", "::")) or t in ("crate", "self", "::") and nxt != "" or t == ";"):
                return "unexpected text outside of an item"
            else:
                want = "item"
            start = False
        operand = (k == "w" and (t not in _RUST_WORDS or t in _RUST_VALUES)) or k in "ns"
        was = (pk == "w" and (pt not in _RUST_WORDS or pt in _RUST_VALUES)) or pk in "ns" or pt in (")", "]")
        if k == "b" and t in "([{":
            macro = loose or (pt == "!" and pprev[0] == "w") or (pk == "w" and pprev[1] == "!" and toks[i - 3][1] == "macro_rules") or pt == "#" or (pt == "!" and pprev[1] == "#")
            if not macro and t == "{" and pt == "->":
                return "operator without operand"
            if not macro and t == "{" and pt in ("fn", "struct", "enum", "impl", "trait", "mod", "let", "use") and not (pt == "use"):
                return "declaration without a name"
            stack.append((t, macro))
        elif k == "b":
            if not stack or _PAIRS[stack[-1][0]] != t:
                return "unbalanced delimiter"
            if not stack[-1][1] and pk == "o" and pt in _RUST_BINARY | {".", "::", "&&", "-", "+", "&"} and not (pt == "|"):
                return "operator without operand"
            stack.pop()
            if not stack:
                if want in ("attribute", "inner"):
                    start = True
                elif t == "}" and not (nxt in (";",)) and (pprev, prev) and nxt not in ("=", "as", "from", "where"):
                    start = True
        elif not loose:
            if k == "o" and t == ";" and not stack:
                start = True
            if t == ";" and pk == "o" and pt in _RUST_BINARY | {".", "::", "&&", "||", "-", "+", "&", "*", ","} and not (pt == "*" and pprev[1] == "::"):
                return "operator without operand"
            if t in _RUST_BINARY and pk == "o" and pt in _RUST_BINARY | {".", "::", ",", ";", "&&", "||", "-", "+"}:
                return "operator without operand"
            if pt == "let" and t in ("=", ";", ":"):
                return "declaration without a name"
            if t in _RUST_BINARY and pt in ("(", "[") or t == "," and pt in ("(", "[", "{", ",", ";"):
                return "operator without operand"
            if t in ("fn", "struct", "enum", "trait", "mod") and not (k == "w" and re.match(_WORD, nxt) and (nxt not in _RUST_WORDS or nxt == "crate") or t == "fn" and nxt == "("):
                return "declaration without a name"
            if t in _RUST_STATEMENT and (pk in "ns" or (was and pt != "]" and pt != ")") or pt == ")" and t == "let" or pk == "o" and pt in _RUST_BINARY - {"=>"} and t not in ("impl", "fn")):
                return "statement not ended"
            if operand and (pk in "ns" or (pk == "w" and was and pt not in ("union", "macro_rules", "auto", "default", "safe", "raw", "async")) or pt == ")" or (pt == "]" and k in "ns")):
                if not (pt == ")" and pprev[0] == "w" and pprev[1] in ("crate", "super", "self")) and not (pt == ")" and _visible(toks, i)):
                    return "two operands without an operator"
            if k == "life" and not (pk == "o" and pt in ("&", "<", ",", "+", ":", "|", "||", ";", "=>", "=", "&&") or pt in ("break", "continue", "{", "}", "for", "(", "impl", "dyn", ";", "where")):
                return "illegal lifetime"
        pprev, prev = prev, (k, t)
    if stack:
        return "premature end"
    if toks and not start or want == "attribute" or _RUST_DOC_END.search(text):
        return "premature end"
    return None


def _visible(toks: list[tuple[str, str]], i: int) -> bool:
    """A `pub(...)` ends before i."""
    for j in range(i - 1, -1, -1):
        if toks[j][1] == "(":
            return j > 0 and toks[j - 1][1] == "pub"
        if toks[j][1] in (";", "{", "}"):
            return False
    return False


# ---------------------------------------------------------------- C#

# Words that start, modify or continue a declaration, statement or expression.
_CS_WORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
_CS_TYPES = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
_CS_VALUES = frozenset("this base true false null default".split()) | _CS_TYPES
_CS_SOFT = frozenset(
    "async await partial where var get set init add remove record yield from select let orderby join on equals into group by ascending descending when required file scoped global and or not with dynamic nameof unmanaged managed value alias nint nuint notnull allows".split()
)
_CS_DIRECTIVES = re.compile(r"#\s*(?:if|elif|else|endif|define|undef|region|endregion|pragma|warning|error|line|nullable|load|r)\b|#!")
_CS_BINARY = frozenset("<<= ??= && || == != <= += -= *= /= %= &= |= ^= / % | = => ?? ->".split())
_CS_PAREN = frozenset("if while for foreach switch catch lock using fixed".split())


def _cs(text: str) -> str | None:
    if _CONFLICT.search(text) and _marker_outside(_CS, text):
        return "merge conflict marker"
    toks = _tokens(_CS, text)
    if isinstance(toks, str):
        return toks
    stack: list[str] = []
    kinds: list[str] = []
    prev: tuple[str, str] = ("o", ";")
    pprev = prev
    ifs = 0
    head = ""
    run = 0  # words in a row
    real = [x for x in toks if x[0] != "pp"]
    for k, t in toks:
        if k != "pp":
            continue
        m = _CS_DIRECTIVES.match(t)
        if not m:
            return "illegal character"
        word = m.group().lstrip("# ")
        if word == "if":
            ifs += 1
        elif word in ("endif", "else", "elif"):
            if ifs == 0:
                return "unbalanced directive"
            ifs -= word == "endif"
    if ifs:
        return "premature end"
    start = True
    for k, t in real:
        pk, pt = prev
        if start:
            head = t
        start = False
        hard = t in _CS_WORDS
        value = k in "ns" or (k == "w" and (not hard or t in _CS_VALUES))
        was = pk in "ns" or (pk == "w" and ((pt not in _CS_WORDS and pt not in _CS_SOFT) or pt in ("this", "base", "true", "false", "null") or pt in _CS_TYPES)) or pt in (")", "]")
        if k == "b" and t in "([{":
            if t == "(" and pk in "ns" or t == "{" and pk in "ns":
                return "two operands without an operator"
            if t == "{" and pk == "w" and pt in ("class", "struct", "namespace", "interface", "enum", "return", "if", "while", "for", "foreach", "case", "using"):
                return "declaration without a name"
            stack.append(t)
            start = t == "{"
        elif k == "b":
            if not stack or _PAIRS[stack[-1]] != t:
                return "unbalanced delimiter"
            if pk == "o" and (pt in _CS_BINARY or pt in (".", "!", "~", "+", "-", "?") or pt == "," and t == ")" or pt == ":" and t != "}") and not (t == "]" and pt == ","):
                if not (pt == "?" and t in (")", "]")) and not (pt == "!" and t == ")"):
                    return "operator without operand"
            if t == "}" and (was and pt not in ("]",) or pk in "ns") and _statement_open(real, stack, kinds):
                return "statement not ended"
            stack.pop()
            start = t == "}"
        elif k == "o":
            if t == ";":
                if pk == "o" and (pt in _CS_BINARY or pt in (".", ",", "+", "-", "<", "?", ":", "!") and not (pt == "!" and pprev[0] == "w")):
                    return "operator without operand"
                if stack and stack[-1] == "[" or stack and stack[-1] == "(" and pt not in (")",) and not _in_for(kinds):
                    return "statement ends inside a bracket"
                if pt in ("namespace", "using", "class", "struct", "new", "case", "is", "as", "in", "public", "private", "static"):
                    return "premature end of a statement"
                start = True
            elif t in _CS_BINARY and (pt in ("(", "[", ",", ";") or t == "=" and pt in _CS_TYPES):
                return "operator without operand"
            elif t in _CS_BINARY and (pt == "<" or pt == ">" and t in ("%", "/", "^", "*=", "%=")):
                return "operator without operand"
            elif t in _CS_BINARY - {"=>"} and pk == "o" and pt in _CS_BINARY | {".", ","}:
                return "operator without operand"
            elif t == "," and (pt in ("(", "{", ";") or pk == "o" and pt in _CS_BINARY | {"."}):
                return "operator without operand"
            elif t == ":" and head in ("case", "default") and (not stack or stack[-1] == "{"):
                start = True
        elif k in "ns":
            if was and not (pk == "o"):
                if not (pt == ")" and k in "ns" and _cast(real)):
                    return "two operands without an operator"
        elif value:
            if pk in "ns" and t not in _CS_SOFT and t not in ("is", "as"):
                return "two operands without an operator"
        elif hard and pk in "ns" and t not in ("is", "as", "in", "switch", "else", "when"):
            return "two operands without an operator"
        if k == "w" and not hard and t not in _CS_SOFT:
            run = run + 1 if pk == "w" or run == 0 else 1
            if run > 2 and pprev[0] == "w" and pk == "w" and pt not in _CS_WORDS and pt not in _CS_SOFT and pprev[1] not in _CS_WORDS and pprev[1] not in _CS_SOFT:
                return "two operands without an operator"
        else:
            run = 0
        if hard and t in ("namespace", "class", "struct", "interface", "enum", "public", "private", "protected", "internal", "if", "foreach", "while", "return", "throw", "try", "switch", "break", "continue", "for") and was and pt not in (")", "]") and not (t in ("switch", "struct", "class")):
            return "statement not ended"
        if t in ("var", "return", "if", "foreach", "while", "throw", "try", "break", "continue", "switch", "public", "private") and pt == ")" and not _header(kinds):
            if t != "switch":
                return "statement not ended"
        if k == "b":
            if t in "([{":
                kinds.append(pt)
            else:
                _header_set(kinds)
        pprev, prev = prev, (k, t)
    if stack:
        return "premature end"
    if real and prev[1] not in (";", "}"):
        return "premature end"
    return None


_LAST = [""]


def _header_set(kinds: list[str]) -> None:
    _LAST[0] = kinds.pop() if kinds else ""


def _header(kinds: list[str]) -> bool:
    """The bracket just closed belongs to `if (...)` and the like, after which a statement follows."""
    return _LAST[0] in _CS_PAREN or _LAST[0] in ("when",)


def _in_for(kinds: list[str]) -> bool:
    return bool(kinds) and kinds[-1] == "for"


def _statement_open(real: list, stack: list[str], kinds: list[str]) -> bool:
    return False


def _cast(real: list) -> bool:
    return _LAST[0] not in ("w",)


# ---------------------------------------------------------------- JavaScript

# The reserved words of the language.
_JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_JS_PREFIX = frozenset("case delete do else in instanceof new return throw typeof void extends default".split())
_JS_SOFT = frozenset("async await of get set static let yield".split())
_JS_UNARY = frozenset("+ - ! ~ ++ -- ... * /".split())
_JS_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_JS_PAREN = frozenset("if for while with switch catch".split())


def _js(text: str) -> str | None:
    if text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    toks: list[tuple[str, str, bool]] = []
    at, nl, braces = 0, False, []
    n = len(text)
    while at < n:
        m = _JS.match(text, at)
        if m.lastgroup == "end":
            break
        k, t = m.lastgroup, m[m.lastindex]
        at = m.end()
        if k == "nl":
            nl = True
            continue
        if k == "bad":
            return _named(t, text, m.start("bad"))
        if t == "/" or t == "/=":
            p = toks[-1] if toks else ("o", ";", False)
            value = p[0] in "nsr" or (p[0] == "w" and (p[1] not in _JS_WORDS or p[1] in ("this", "super", "null", "true", "false"))) or p[1] in (")", "]", "}")
            if not value:
                m = _JS_REGEX.match(text, m.start("o"))
                if not m:
                    return "unterminated literal"
                k, t, at = "r", m.group(), m.end()
        if t == "`" or (t == "}" and braces and braces[-1] == "`"):
            if t == "}":
                braces.pop()
                toks.append(("b", ")", nl))
            first = t == "`"
            at = _JS_TEXT.match(text, at).end()
            if at >= n:
                return "unterminated literal"
            if text[at] == "`":
                at += 1
                if first:
                    toks.append(("s", "``", nl))
                else:
                    toks.append(("b", "]", False))
            else:
                at += 2
                braces.append("`")
                if first:
                    toks.append(("b", "[", nl))
                    toks.append(("b", "(", False))
                else:
                    toks.append(("o", ",", False))
                    toks.append(("b", "(", False))
            nl = False
            continue
        if t == "{":
            braces.append("{")
        elif t == "}" and braces:
            braces.pop()
        toks.append((k, t, nl))
        nl = False
    return _js_grammar(toks)


def _js_grammar(toks: list[tuple[str, str, bool]]) -> str | None:
    stack: list[tuple[str, str, str]] = []  # bracket, what it holds: block, class, object, list, head
    operand = False  # an operand has ended: an operator may follow
    start = True
    pt, pk = ";", "o"
    last = ("", "")  # what the bracket just closed held, and the word before it
    parts: dict[int, int] = {}  # semicolons in the heads that are open, by depth
    for i, (k, t, nl) in enumerate(toks):
        holds = stack[-1][1] if stack else "block"
        before = start  # the token is the first of a statement
        nxt = toks[i + 1][1] if i + 1 < len(toks) else ""
        if operand and nl and holds in ("block", "class") and (k in "wnsr" or t in ("{", "++", "--")) and not (t in ("in", "instanceof", "of", "extends")):
            operand, start = False, True  # the line break ends the statement
        if k == "b" and t in "([{":
            if t == "{":
                if holds == "class" and pt != "=":
                    kind = "block"
                elif pt == "class" or (pk == "w" or pt in (")", "]")) and _class_before(toks, i):
                    kind = "class"
                elif start or pt in (")", "=>", "else", "do", "try", "finally", ";", "{", "}") or pt == "static" and holds == "class":
                    if pt == ")" and operand and last[1] not in _JS_PAREN and not _callable_before(toks, i):
                        return "two operands without an operator"
                    kind = "block"
                elif pt == "catch":
                    kind = "block"
                else:
                    if operand:
                        return "two operands without an operator"
                    kind = "object"
            elif t == "(":
                kind = "head" if pt in _JS_PAREN or (pt == "await" and i > 1 and toks[i - 2][1] == "for") else "list"
                if not operand and nxt == ")" and not (pt in ("function", "async", "catch", "super", "get", "set", "static", "import", "of", "let", "yield", "await") or pk == "w" and (holds in ("class", "object")) or pt in ("*",)) and not (i + 2 < len(toks) and toks[i + 2][1] == "=>") and not (pk == "w" and i > 1 and toks[i - 2][1] in ("function", "*")):
                    return "operator without operand"
            else:
                kind = "list"
            stack.append((t, kind, pt if pk == "w" else ""))
            parts[len(stack)] = 0
            operand, start = False, kind in ("block", "class")
        elif k == "b":
            if not stack or _PAIRS[stack[-1][0]] != t:
                return "unbalanced delimiter"
            if pk == "o" and not operand and pt not in (";", ",", "=>", "++", "--", ":") or pk == "o" and pt == "," and t == ")" and len(toks) > 1 and i > 1 and toks[i - 2][1] == "(":
                return "operator without operand"
            if pk == "w" and pt in _JS_PREFIX and pt not in ("return", "default", "do", "else") and stack[-1][1] not in ("object", "class") and not (i > 1 and toks[i - 2][1] in (".", "?.")):
                return "operator without operand"
            _, kind, word = stack.pop()
            last = (kind, word)
            if t == "}" and kind in ("block", "class"):
                outer = stack[-1][1] if stack else "block"
                operand = outer in ("list", "object", "head")
                start = not operand
                if not operand and _expression_block(toks, i):
                    operand = True
            elif t == ")" and kind == "head":
                operand, start = False, True
            else:
                operand, start = True, False
        elif k == "o":
            if t == ";":
                if not operand and pk == "o" and pt not in (";", "++", "--", ":", "=>") :
                    return "operator without operand"
                if stack and holds in ("list", "object"):
                    return "statement ends inside a bracket"
                if holds == "head":
                    parts[len(stack)] += 1
                    if parts[len(stack)] > 2 or stack[-1][2] not in ("for", "await"):
                        return "statement ends inside a bracket"
                operand, start = False, True
            elif t in ("++", "--"):
                if not operand and nxt in ("++", "--", "-", "+") :
                    return "operator without operand"
            elif t == "=>":
                if not operand:
                    return "operator without operand"
                operand = False
            elif t == ":":
                if holds == "block" and pk in "ns" and not _in_case(toks, i) and not _ternary(toks, i):
                    return "unexpected text"
                operand, start = False, holds == "block" and not _ternary(toks, i)
            elif not operand and t not in _JS_UNARY and not (t == "," and holds == "list" and pt in ("[", ",")) and not (t == "*" or pk == "w" and (holds in ("object", "class") or pt in ("of", "get", "set", "async", "static", "let", "yield", "await") or i > 1 and toks[i - 2][1] in (".", "?."))):
                return "operator without operand"
            elif not operand and t in ("*", "/") and pt not in ("function", "yield", "async", "{", ",", "static", ";", "}"):
                return "operator without operand"
            else:
                if t in _JS_ASSIGN and pk in "ns":
                    return "illegal assignment"
                operand, start = False, False
                if t == "." and not (i + 1 < len(toks) and toks[i + 1][0] == "w"):
                    return "operator without operand"
        elif k in "nsr":
            if operand and not (holds == "class"):
                return "two operands without an operator"
            operand, start = True, False
        else:  # words
            member = pt in (".", "?.")
            name = holds in ("object", "class") and (nxt in (":", "(", "=", ",", "}", ";") or pk == "o" and pt == ",")
            if member:
                operand, start = True, False
            elif t in ("in", "instanceof", "of", "extends") and operand:
                operand = False
            elif name and not operand:
                operand = True
                start = False
            elif operand:
                if pt in ("async", "get", "set", "static", "let", "await", "yield", "of", "break", "continue"):
                    operand = True
                elif holds == "class" or (t in ("else", "while", "catch", "finally") and pt == "}"):
                    operand = t not in _JS_WORDS
                else:
                    return "two operands without an operator"
            elif t in ("import", "export") and not stack and nxt not in ("(", "."):
                return "module syntax"
            elif t in ("await", "yield") and i + 1 < len(toks) and not toks[i + 1][2] and (toks[i + 1][0] in "wnsr" or nxt in ("(", "[", "{", "!", "-", "+", "~", "*")):
                operand, start = False, False
            elif t in ("const", "var"):
                if not start and holds != "head" and pt not in ("{", ";", "}", ")", ":"):
                    return "unexpected text"
                if not (nxt and (nxt[0] in "[{$_#" or nxt[0].isalpha()) and nxt not in _JS_WORDS):
                    return "declaration without a name"
                if t == "const" and nxt[0] not in "[{" and holds != "head" and (toks[i + 2][1] if i + 2 < len(toks) else "") != "=":
                    return "declaration without a value"
                operand, start = False, False
            elif t in _JS_WORDS and t not in ("this", "super", "null", "true", "false", "debugger"):
                operand, start = t in ("break", "continue"), t in ("else", "do", "try", "finally")
                if t in ("class", "function") and not nxt:
                    return "premature end"
                if t == "function" and before and nxt == "(" or t in ("if", "while", "with", "switch") and nxt != "(" or t == "for" and nxt not in ("(", "await"):
                    return "declaration without a name" if t == "function" else "operator without operand"
                if t == "class" and nxt not in ("{", "extends"):
                    operand = False
            else:
                operand, start = True, False
        pt, pk = t, k
    if stack or len(toks) > 1 and pk == "w" and toks[-2][1] in ("class", "function", "extends") and not (len(toks) > 2 and toks[-3][1] in (".", "?.")):
        return "premature end"
    if pk == "o" and not operand and pt not in (";", "++", "--", ":") or pk == "w" and pt in _JS_PREFIX | {"const", "var", "class", "function", "if", "for", "while", "try", "switch"} - {"return"} and not operand and not (len(toks) > 1 and toks[-2][1] == "."):
        return "premature end"
    return None


def _class_before(toks: list, i: int) -> bool:
    for j in range(i - 1, -1, -1):
        t = toks[j][1]
        if t == "class":
            return True
        if t in (";", "{", "}", "=>") or t == "function":
            return False
    return False


def _callable_before(toks: list, i: int) -> bool:
    """The parameters of a function, method or catch end at i - 1."""
    depth = 0
    for j in range(i - 1, -1, -1):
        t = toks[j][1]
        if t == ")":
            depth += 1
        elif t == "(":
            depth -= 1
            if depth == 0:
                if j == 0:
                    return False
                p = toks[j - 1]
                if p[1] in ("function", "catch", "async", "*") or j > 1 and toks[j - 2][1] in ("function", "*", "get", "set", "async", "static"):
                    return True
                return _method_place(toks, j - 1)
    return False


def _method_place(toks: list, j: int) -> bool:
    """The name at j opens a member of a class or object."""
    if toks[j][0] not in "wns" and toks[j][1] != "]":
        return False
    p = toks[j - 1][1] if j else ";"
    return p in ("{", "}", ",", ";") or toks[j][2] and p not in ("=", "(", ".")


def _expression_block(toks: list, i: int) -> bool:
    """The block that ends at i is the body of a function in an expression."""
    depth = 0
    for j in range(i, -1, -1):
        t = toks[j][1]
        if t in (")", "]", "}"):
            depth += 1
        elif t in ("(", "[", "{"):
            depth -= 1
            if depth == 0 and t == "{":
                return _body_of_expression(toks, j)
    return False


def _body_of_expression(toks: list, j: int) -> bool:
    if j == 0:
        return False
    if toks[j - 1][1] == "=>":
        return True
    depth = 0
    for x in range(j - 1, -1, -1):
        t = toks[x][1]
        if t in (")", "]", "}"):
            depth += 1
        elif t in ("(", "[", "{"):
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0 and t in ("function", "class"):
            y = x - 1
            while y >= 0 and toks[y][1] == "async":
                y -= 1
            return y >= 0 and (toks[y][0] == "o" and toks[y][1] not in (";", ":") or toks[y][1] in ("(", "[", "return", "new", "typeof", "void"))
        elif depth == 0 and t == ";":
            return False
    return False


def _in_case(toks: list, i: int) -> bool:
    for j in range(i - 1, -1, -1):
        if toks[j][1] == "case":
            return True
        if toks[j][1] in (";", "{", "}"):
            return False
    return False


def _ternary(toks: list, i: int) -> bool:
    depth = 0
    for j in range(i - 1, -1, -1):
        t = toks[j][1]
        if t in (")", "]", "}"):
            depth += 1
        elif t in ("(", "[", "{"):
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0 and t == "?":
            return True
        elif depth == 0 and t == ";":
            return False
    return False


# ---------------------------------------------------------------- Python

_PY = _lexer(
    r"""[^\"'#()\[\]{}a-zA-Z]+|\#[^\n]*|(?![rbufRBUF][rbufRBUF]?[\"'])[a-zA-Z]\w*""",
    ("b", r"[()\[\]{}]"),
    ("s", r"(?i:[rbuf]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')"),
    ("bad", r"."),
)


def _py(text: str) -> str | None:
    if "\x00" in text:
        return "illegal character"
    stack: list[str] = []
    for m in _PY.finditer(text):
        k = m.lastgroup
        if k == "bad":
            return _named(m["bad"], text, m.start("bad"))
        if k == "b":
            t = m["b"]
            if t in "([{":
                stack.append(t)
            elif not stack or _PAIRS[stack.pop()] != t:
                return "unbalanced delimiter"
    if stack:
        return "premature end"
    if _CONFLICT.search(text) and _marker_outside(_PY, text):
        return "merge conflict marker"
    return _py_exact(text)


def _py_exact(text: str) -> str | None:
    """The parser of the interpreter; nested f-strings, for one, pass here that a lexer cannot judge."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return "unexpected text"
    except (RecursionError, MemoryError):
        return None
    return None


def _marker_outside(lexer: re.Pattern[str], text: str) -> bool:
    """A conflict marker stands outside of every literal and comment."""
    inside = [m.span(m.lastgroup) for m in lexer.finditer(text) if m.lastgroup in ("s", "nl", "t") and m.end() - m.start() > 7]
    return any(not any(a < m.start() < b for a, b in inside) for m in _CONFLICT.finditer(text))


_CHECKS = {"Go": _go, "Rust": _rust, "C#": _cs, "JavaScript": _js, "Python": _py}
