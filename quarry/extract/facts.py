"""Semantic facts of source files: sources, sinks, guards, resources, propagation, calls, control.

The events of each function (`quarry.extract.events`) get their meaning from
tables: which call of which package, or on a receiver of which type, is what.
Types of Go receivers come from parameters, fields and what is known to return them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.extract.events import READERS, Assign, Call, Control, Function, Place, Return, Start, Unit, read

SCHEMA = (
    "id string, kind string, operation string, file string, function string, receiver string, expression string, start_line int, start_column int, end_line int, end_column int, "
    "arguments array<string>, argument_inputs array<array<string>>, inputs array<string>, outputs array<string>, metadata map<string,string>"
)

# What the functions of Go packages do: package, names, kind and operation of the fact.
GO_CALLS = [
    ("os/exec", ("Command", "CommandContext"), "command_execution", "command.exec"),
    ("os", ("Open", "OpenFile"), "file_operation", "file.open"),
    ("os", ("ReadFile",), "file_operation", "file.read"),
    ("os", ("WriteFile", "Create"), "file_operation", "file.write"),
    ("os", ("Chmod", "Mkdir", "MkdirAll"), "file_operation", "file.permission"),
    ("path/filepath", ("Join", "Clean"), "file_operation", "path.construct"),
    ("crypto/md5", ("New", "Sum"), "crypto_operation", "crypto.weak.md5"),
    ("crypto/sha1", ("New", "Sum"), "crypto_operation", "crypto.weak.sha1"),
]
GO_ASSIGNED = [
    ("os", ("Getenv", "LookupEnv"), "source", "environment"),
    ("os", ("ReadFile",), "source", "file.input"),
    ("context", ("WithCancel", "WithTimeout", "WithDeadline", "WithCancelCause", "WithDeadlineCause", "WithTimeoutCause"), "resource_acquire", "context.cancel"),
    ("net/http", ("Get", "Post"), "resource_acquire", "http.response.body"),
    ("os", ("Open", "OpenFile", "Create"), "resource_acquire", "file"),
    ("time", ("NewTicker",), "resource_acquire", "ticker"),
    ("bufio", ("NewScanner",), "resource_acquire", "scanner"),
]
# Position of the error among the results, and of the file mode among the arguments.
GO_ERRORS = [
    ("os", ("WriteFile",), 0), ("net/http", ("Get", "Post"), 1), ("os", ("Open", "OpenFile", "Create", "ReadFile"), 1), ("strconv", ("Atoi", "ParseBool", "ParseFloat", "ParseInt", "ParseUint"), 1),
]
GO_TYPE_ERRORS = [("database/sql.", ("Scan", "Close"), 0), ("database/sql.", ("Query", "QueryContext", "Exec", "ExecContext"), 1), ("os.File", ("Close",), 0), ("os.File", ("Read", "Write"), 1)]
GO_MODES = [("os", ("OpenFile", "WriteFile"), 2), ("os", ("Chmod", "Mkdir", "MkdirAll"), 1)]
# The type of the first result of known calls, by package or by receiver type.
GO_RESULTS = [
    ("github.com/gin-gonic/gin", ("New", "Default"), "github.com/gin-gonic/gin.Engine"), ("github.com/gofiber/fiber", ("New",), "github.com/gofiber/fiber.App"), ("gorm.io/gorm", ("Open",), "gorm.io/gorm.DB"),
    ("database/sql", ("Open",), "database/sql.DB"), ("bufio", ("NewScanner",), "bufio.Scanner"), ("net/http", ("Get", "Post"), "net/http.Response"), ("os", ("Open", "OpenFile", "Create"), "os.File"), ("time", ("NewTicker",), "time.Ticker"),
]
GO_TYPE_RESULTS = [("database/sql.", ("Query", "QueryContext"), "database/sql.Rows"), ("database/sql.", ("QueryRow", "QueryRowContext"), "database/sql.Row"), ("database/sql.", ("Begin", "BeginTx"), "database/sql.Tx"), ("database/sql.", ("Prepare", "PrepareContext"), "database/sql.Stmt")]
# Inputs of web frameworks: type of the receiver, framework, methods of each operation; a trailing selector for plain requests.
GO_INPUTS = [
    ("github.com/gin-gonic/gin.Context", "gin", {"http.query": ("Query", "DefaultQuery", "QueryArray", "QueryMap"), "http.path": ("Param",), "http.header": ("GetHeader",), "http.body": ("ShouldBind", "ShouldBindJSON", "Bind", "BindJSON")}),
    ("github.com/gofiber/fiber.Ctx", "fiber", {"http.query": ("Query", "Queries"), "http.path": ("Params", "AllParams"), "http.header": ("Get",), "http.body": ("Body", "BodyRaw", "Bind")}),
]
GO_REQUEST = {".URL.Query().Get": "http.query", ".FormValue": "http.query", ".Header.Get": "http.header"}
GO_BINDERS = ("ShouldBind", "ShouldBindJSON", "Bind", "BindJSON", "Body")
GO_ROUTERS = ("github.com/gin-gonic/gin.Engine", "github.com/gin-gonic/gin.RouterGroup", "github.com/gofiber/fiber.App", "github.com/gofiber/fiber.Group", "github.com/gofiber/fiber.Router")
GO_ROUTES = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "Get", "Post", "Put", "Delete", "Patch", "Head", "Options", "Any", "All", "Handle")
GORM_TERMINAL = ("First", "Find", "Take", "Last", "Scan", "Create", "Save", "Delete", "Updates", "Transaction", "Begin", "Commit", "Rollback", "Unscoped", "Session")
SQL_METHODS = ("Query", "QueryRow", "Exec", "QueryContext", "QueryRowContext", "ExecContext", "Prepare", "PrepareContext")
GO_RELEASES = {"Close": "close", "Stop": "stop", "Commit": "commit", "Rollback": "rollback", "Unlock": "unlock", "RUnlock": "unlock"}
SHELLS = ("sh", "bash", "cmd", "cmd.exe", "powershell", "pwsh", "/bin/sh", "/bin/bash")
SHELL_FLAGS = ("-c", "/c", "-command", "/C", "-Command")
# Python: assigned expression of an imported framework; called names with the import they need.
PY_SOURCES = [("flask", ("request.args",), "http.query"), ("flask", ("request.form",), "http.form"), ("flask", ("request.get_json", "request.json", "request.get_data"), "http.body"), ("django", ("request.GET",), "http.query"), ("django", ("request.POST",), "http.form")]
PY_FASTAPI = {"Query": "http.query", "Path": "http.path", "Body": "http.body", "Header": "http.header", "Form": "http.form"}
RUST_HANDLERS = [("axum", r"\b(?:Query|Path|Json|Form)\b"), ("actix_web", r"\bweb::(?:Query|Path|Json|Form)\b"), ("tonic", r"\bRequest\b")]
RUST_KINDS = {"Query": "http.query", "Path": "http.path", "Json": "http.body", "Form": "http.form", "Request": "http.body"}
CS_INPUTS = {"FromQuery": "http.query", "FromRoute": "http.path", "FromBody": "http.body", "FromForm": "http.form", "FromHeader": "http.header"}
CS_MEMBERS = {".Query": "http.query", ".RouteValues": "http.path", ".Headers": "http.header", ".Form": "http.form", ".Body": "http.body"}


def fact_id(kind: str, operation: str, file: str, line: int, column: int) -> str:
    """24 hex digits of the SHA-256 over what a fact is and where it begins, parted by NUL."""
    return hashlib.sha256("\0".join((kind, operation, file, str(line), str(column))).encode("utf-8", "replace")).hexdigest()[:24]


def _literal(text: str) -> bool:
    t = text.strip()
    return len(t) > 1 and t[0] in "\"'`" and t[-1] == t[0]


def _parameterized(args: list[str], at: int) -> bool:
    return len(args) > 1 and at < len(args) and ("?" in args[at] or re.search(r"\$[1-9]", args[at]) is not None)


class _Facts:
    """Collects the facts of one file."""

    def __init__(self, unit: Unit, file: str) -> None:
        self.unit, self.file, self.rows = unit, file, []
        self.fn: Function | None = None

    def imports(self, prefix: str) -> bool:
        return any(p == prefix or p.startswith((prefix + ".", prefix + "::", prefix + "{", prefix + "/v")) for p in self.unit.imports.values())

    def add(self, kind: str, op: str, at: Place, text: str = "", ins: list[str] = (), outs: list[str] = (), meta: dict[str, str] | None = None, call: Call | None = None) -> None:
        args, by = (call.args, call.arg_names) if call is not None else ([], [])
        known = self.unit.imports if self.unit.language == "Go" else ()
        clean = lambda xs: [x for x in dict.fromkeys(xs) if x and x not in known]
        self.rows.append((fact_id(kind, op, self.file, at[0], at[1]), kind, op, self.file, self.fn.name if self.fn else "", self.fn.receiver if self.fn else "", text, *at, list(args), [clean(x) for x in by], clean(ins), clean(outs), {k: v for k, v in (meta or {}).items() if v}))

    def common(self, e: object) -> None:
        if isinstance(e, Control):
            self.add("control", e.what, e.place, e.text)
        elif isinstance(e, Return):
            self.add("return", "return", e.place, e.text, e.names)

    def called(self, c: Call, op: str | None = None, kind: str = "call", meta: dict[str, str] | None = None) -> None:
        ins = [x for xs in c.arg_names for x in xs]
        self.add(kind, op or c.callee, c.place, c.text, ins, c.outputs, {"in_loop": "true" if c.loop else ""} | (meta or {}), call=c)


def _types(f: _Facts, text: str) -> str:
    """A Go type with its package's path in place of the alias."""
    t = re.sub(r"^[*&\[\].\s]+", "", text)
    pkg, _, name = t.partition(".")
    path = f.unit.imports.get(pkg)
    return f"{re.sub(r'/v[0-9]+$', '', path)}.{name}" if name and path else t


def _go(f: _Facts) -> None:
    unit = f.unit
    fields = {k: _types(f, v) for k, v in unit.fields.items()}

    def package(callee: str) -> tuple[str, str]:
        root, _, rest = callee.partition(".")
        return (re.sub(r"/v\d+$", "", unit.imports.get(root, "")), rest) if rest and "." not in rest else ("", "")

    def known(table: list, callee: str) -> list:
        path, name = package(callee)
        return [row[2:] if len(row) > 3 else row[2] for row in table if row[0] == path and name in row[1]]

    def receiver(c: Call, types: dict[str, str]) -> str:
        """Type of what the method is called on: the variable's, else that of the last field on the way."""
        parts = re.split(r"\.", re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", c.callee)))
        if len(parts) < 2:
            return ""
        own = types.get(parts[0], fields.get(parts[0], ""))
        for p in parts[1:-1]:
            if not own.startswith(("gorm.io/gorm.", "database/sql.", "net/http.", "github.com/")):
                own = fields.get(p, own)
        return own

    for fn in unit.functions:
        f.fn = fn
        types = {n: _types(f, t) for n, t, _ in fn.params}
        fixed: set[str] = set()
        events = fn.events
        for n, e in enumerate(events):
            f.common(e)
            if isinstance(e, Start):
                f.add("concurrency_operation", "goroutine.start", e.place, e.text, e.inputs)
                heads = [h for h in e.loops if not re.search(r"\b(?:Accept|accept)\w*\(", h) and not re.fullmatch(r"for\s+(?:\w+\s*:=\s*)?.*;\s*\w+\s*(?:<|<=|>|>=)\s*\d+\s*;.*|for\s+\w+\s*:?=\s*range\s+\d+|for\s+range\s+\d+", h, re.S)]
                accept = any(re.search(r"\.Accept\(\)", x.text) for x in events if isinstance(x, Call) and x.loop)
                if heads and not accept:
                    m = re.search(r"\brange\s+(.+)$", heads[-1], re.S)
                    over = (m[1].strip() if m else "")
                    kind = next((t for p, t, _ in fn.params if p == over), "")
                    finite = bool(m) and not kind.startswith(("chan", "<-chan"))
                    f.add("concurrency_operation", "goroutine.loop", e.place, e.text, e.inputs, meta={"loop_bound": "finite_collection" if finite else "unknown", "loop_expression": over})
            elif isinstance(e, Control) and e.what == "if":
                m = re.match(r"if\s+!\s*([\w.]*(?:allowed|valid|validate)\w*)\((.*)\)$", e.text, re.I | re.S)
                body = [x for x in events[n + 1 :] if getattr(x, "place", (0,))[0] <= e.place[2] and isinstance(x, Return)]
                if m and body:
                    names = re.findall(r"(?<![\w.\"])[A-Za-z_]\w*(?![\w(\"])", m[2])
                    f.add("sanitizer", "validation.allowlist", e.place, e.text, names, names)
            elif isinstance(e, Assign):
                _go_assign(f, e, types, fixed, package, known, receiver)
            elif isinstance(e, Call):
                _go_call(f, e, types, fixed, package, known, receiver)
        for m in re.finditer(r"(\w+(?:\s*,\s*\w+)?)?\s*(:?=)?\s*([\w.]+)\.\((?!type\b)([\w.*]+)\)", fn.text):
            if "," not in (m[1] or ""):
                line = fn.place[0] + fn.text.count("\n", 0, m.start(3))
                f.add("guard", "type_assertion.unchecked", (line, 1, line, 1), m[0].strip(), [m[3].split(".")[0]])
        for m in re.finditer(r"\b(InsecureSkipVerify|AllowGlobalUpdate)\s*:\s*true\b", fn.text):
            line = fn.place[0] + fn.text.count("\n", 0, m.start())
            tls = m[1] == "InsecureSkipVerify"
            around = fn.text[: m.start()]
            if re.search(r"\btls\.Config\s*\{[^{}]*$" if tls else r"\bgorm\.Session\s*\{[^{}]*$", around):
                f.add("crypto_operation" if tls else "database_operation", "tls.insecure_skip_verify" if tls else "gorm.allow_global_update", (line, 1, line, 1), m[0])
        for m in re.finditer(r"\b(\w+)\.Error\b(?!\()", fn.text):
            if types.get(m[1], "") == "gorm.io/gorm.DB":
                line = fn.place[0] + fn.text.count("\n", 0, m.start())
                f.add("guard", "gorm.error.checked", (line, 1, line, 1), m[0], [m[1]])
        for m in re.finditer(r"(<-\s*\w+)|(\b\w+\s*<-)", fn.text):
            line = fn.place[0] + fn.text.count("\n", 0, m.start())
            f.add("concurrency_operation", "channel.receive" if m[1] else "channel.send", (line, m.start() - fn.text.rfind("\n", 0, m.start()), line, 1), m[0], [re.sub(r"\W", "", m[0])])


def _go_input(f: _Facts, c: Call, kind: str) -> tuple[str, str] | None:
    """Operation and framework of a call that reads a request."""
    method = c.callee.rsplit(".", 1)[-1]
    if kind.startswith("net/http.Request"):
        for tail, op in GO_REQUEST.items():
            if c.callee.endswith(tail):
                return op, "net/http"
    for of, framework, methods in GO_INPUTS:
        if kind == of:
            for op, names in methods.items():
                if method in names:
                    return op, framework
    return None


def _mark(c: Call) -> str:
    """The name of a source that no variable holds."""
    return f"@source:{c.place[0]}:{c.place[1]}"


def _go_assign(f: _Facts, e: Assign, types: dict[str, str], fixed: set[str], package, known, receiver) -> None:  # noqa: ANN001
    c, ins = e.call, list(e.inputs)
    kind = receiver(c, types) if c is not None else ""
    gorm = kind == "gorm.io/gorm.DB"
    meta = {"conditional": "true" if e.conditional else "", "database": "gorm" if gorm else "", "external_import": "true" if c is not None and package(c.callee)[0] else ""}
    method = c.callee.rsplit(".", 1)[-1] if c is not None else ""
    f.add("propagation", e.callee or "assignment", e.place, e.text, ins, e.outputs, meta, call=c)
    if c is None:
        if len(e.outputs) == 1:
            (fixed.add if _literal(e.right) else fixed.discard)(e.outputs[0])
            if m := re.match(r"&?([\w.]+)\s*\{", e.right):
                types[e.outputs[0]] = _types(f, m[1])
            elif e.right in types:
                types[e.outputs[0]] = types[e.right]
        return
    for out in e.outputs:
        fixed.discard(out)
    for made in known(GO_ASSIGNED, c.callee):
        outs = e.outputs[-1:] if made[1] == "context.cancel" else e.outputs
        f.add(made[0], made[1], e.place, e.text, [], outs, {"user_controlled": "true" if made[0] == "source" else ""})
    if kind.startswith("database/sql.") and method in ("Query", "QueryContext"):
        f.add("resource_acquire", "database.rows", e.place, e.text, [], e.outputs)
    if method in ("Begin", "BeginTx") and (gorm or kind.startswith("database/sql.")):
        f.add("resource_acquire", "gorm.transaction" if gorm else "database.transaction", e.place, e.text, [], e.outputs)
    if kind in GO_ROUTERS and method == "Group":
        f.add("route", "http.route.group", e.place, e.text, [], e.outputs, {"path": c.args[0].strip("\"`") if c.args else ""})
        types[e.outputs[0] if e.outputs else ""] = kind
    made = [t for t in known(GO_RESULTS, c.callee)] or [t for of, names, t in GO_TYPE_RESULTS if kind.startswith(of) and method in names] or (["gorm.io/gorm.DB"] if gorm else [])
    if made and e.outputs:
        types[e.outputs[0]] = made[0]


def _go_call(f: _Facts, c: Call, types: dict[str, str], fixed: set[str], package, known, receiver) -> None:  # noqa: ANN001
    method, kind = c.callee.rsplit(".", 1)[-1], receiver(c, types)
    path, _ = package(c.callee)
    ins = [x for xs in c.arg_names for x in xs]
    found = _go_input(f, c, kind)
    if found:
        outs = [re.sub(r"\W", "", a) for a in c.args[:1]] if method in GO_BINDERS and c.args else c.outputs or [_mark(c)]
        meta = {"framework": found[1], "user_controlled": "true"}
        f.add("http_input", found[0], c.place, c.text, [], outs, meta)
        f.add("source", found[0], c.place, c.text, [], outs, meta)
    for op in [op for op, p in _pending(f, c)]:
        ins.append(op)
    gorm, sql = kind == "gorm.io/gorm.DB", kind.startswith("database/sql.") and method in SQL_METHODS
    if gorm and method in ("Raw", "Exec", "Where", *GORM_TERMINAL) or sql:
        at = 1 if method.endswith("Context") else 0
        query = c.args[at] if at < len(c.args) else ""
        names = c.arg_names[at] if at < len(c.arg_names) else []
        plain = re.fullmatch(r"[A-Za-z_]\w*", query.strip()) is not None
        dynamic = bool(query) and not _literal(query) and not (plain and query.strip() in fixed) and not (method == "Where" and query.strip()[:1] in "&[")
        bound = not dynamic and _parameterized(c.args, at)
        if sql:
            op = f"database/sql.{method.lower()}"
        elif method in ("Raw", "Exec"):
            op = f"sql.{method.lower()}"
        elif method == "Where":
            op = f"gorm.where.{'dynamic' if dynamic else 'parameterized' if bound else 'literal'}"
        else:
            op, bound, dynamic = f"gorm.{method.lower()}", True, False
        meta = {"parameterized": "true" if bound else "", "dynamic": "true" if dynamic else "", "database": "gorm" if gorm else "database/sql", "error_checked_inline": "true" if c.then == "Error" else ""}
        f.add("database_operation", op, c.place, c.text, ins, c.outputs, meta, call=c)
        if dynamic and not bound:
            f.add("sink", op, c.place, c.text, [*names, *[x for x, p in _pending(f, c)]], [], meta, call=c)
        if gorm and "Unscoped()" in c.callee and method in ("Delete", "Updates"):
            f.add("database_operation", f"gorm.unscoped.{method.lower()}", c.place, c.text, ins)
    for what in known(GO_CALLS, c.callee):
        meta = {"callee": c.callee, "arguments": "\x1f".join(c.args), "mode_index": "".join(str(n) for n in known(GO_MODES, c.callee)[:1])}
        f.add(what[0], what[1], c.place, c.text, ins, c.outputs, meta, call=c)
        marks = [x for x, p in _pending(f, c)]
        if what[1] == "command.exec":
            first = 1 if method == "CommandContext" else 0
            args, names = c.args[first:], c.arg_names[first:]
            shell = bool(args) and _literal(args[0]) and args[0].strip("\"`") in SHELLS and any(a.strip("\"`") in SHELL_FLAGS for a in args[1:2])
            if args and not _literal(args[0]) or shell:
                f.add("sink", "command.exec", c.place, c.text, [x for xs in (names[2:] if shell else names[:1]) for x in xs] + marks, call=c)
        elif what[1] in ("file.open", "file.read", "file.write"):
            f.add("sink", what[1], c.place, c.text, [*(c.arg_names[0] if c.arg_names else []), *marks], call=c)
    if path == "net/http" and method == "Redirect" or kind.startswith("github.com/") and method == "Redirect":
        f.add("sink", "http.redirect", c.place, c.text, ins, call=c)
    if method in ("Lock", "RLock") and re.match(r"sync\.(?:RW)?(?:Mutex|Locker)", kind):
        f.add("resource_acquire", "mutex", c.place, c.text, [], [c.callee.rsplit(".", 1)[0]])
    release = GO_RELEASES.get(method) if "." in c.callee else "context.cancel" if "cancel" in c.callee.lower() else None
    if release:
        f.add("resource_release", release, c.place, c.text, [*c.names, *ins, c.callee.rsplit(".", 1)[0]], [], {"deferred": "true" if c.deferred else ""})
    errors = [n for n in known(GO_ERRORS, c.callee)] + [n for of, names, n in GO_TYPE_ERRORS if kind.startswith(of) and method in names]
    if errors and (c.bare or errors[0] in c.blank):
        f.add("guard", "error.ignored", c.place, c.text, ins, c.outputs)
    if c.deferred and c.loop:
        f.add("concurrency_operation", "defer.in_loop", c.place, c.text, ins)
    if method == "Add" and kind == "sync.WaitGroup" and c.go:
        f.add("concurrency_operation", "waitgroup.add_in_goroutine", c.place, c.text, c.names)
    if kind in GO_ROUTERS and method in GO_ROUTES and c.args:
        f.add("route", "http.route", c.place, c.text, ins, meta={"path": c.args[0].strip("\"`"), "method": method.upper(), "handler": c.args[-1], "group": c.names[0] if c.names else "", "protection_semantics": "unknown"}, call=c)
    if kind in GO_ROUTERS and method == "Use":
        f.add("middleware", "http.middleware", c.place, c.text, ins, meta={"group": c.names[0] if c.names else "", "handler": ",".join(c.args)}, call=c)
    f.called(c, meta={"external_import": "true" if path else ""})


def _pending(f: _Facts, c: Call) -> list[tuple[str, Place]]:
    """Sources without a variable inside the call."""
    out = []
    for fn in [f.fn] if f.fn else []:
        for e in fn.events:
            if isinstance(e, Call) and e is not c and not e.outputs and c.place[:2] < e.place[:2] and e.place[2:] <= c.place[2:]:
                out.append((_mark(e), e.place))
    return out


def _py(f: _Facts) -> None:
    unit = f.unit
    declared = {fn.name for fn in unit.functions if fn.name}
    links: set[str] = set()
    cursors: set[str] = set()
    for fn in unit.functions:
        f.fn = fn if fn.name else None
        for name, _, default in fn.params:
            m = re.match(r"(?:fastapi\.)?(\w+)\(", default)
            if m and m[1] in PY_FASTAPI and f.imports("fastapi"):
                for kind in ("http_input", "source"):
                    f.add(kind, PY_FASTAPI[m[1]], fn.place, default, [], [name], {"framework": "fastapi", "user_controlled": "true"})
            if re.match(r"[\[{]|(?:list|dict|set)\(\)", default):
                f.add("guard", "python.mutable_default", fn.place, f"{name}={default}", [], [name])
        for e in fn.events:
            f.common(e)
            if isinstance(e, Control) and e.what == "if" and "None" in e.text:
                f.add("guard", "python.opencv.image_checked", e.place, e.text, re.findall(r"[A-Za-z_]\w*", e.text))
            elif isinstance(e, Assign):
                declared.update(e.outputs)
                op = "string.interpolation" if re.match(r"[rb]?f[\"']", e.right) else "string.construction" if re.search(r"[\"'].*[+%]|[+%].*[\"']", e.right) else e.callee or "assignment"
                f.add("propagation", op, e.place, e.text, e.inputs, e.outputs, {"conditional": "true" if e.conditional else ""})
                for package, texts, what in PY_SOURCES:
                    if f.imports(package) and any(x in e.right for x in texts):
                        for kind in ("http_input", "source"):
                            f.add(kind, what, e.place, e.text, [], e.outputs, {"framework": package, "user_controlled": "true"})
                        break
                if "sqlite3.connect(" in e.right:
                    links.update(e.outputs[:1])
                if e.right.rstrip().endswith(".cursor()") and e.right.strip()[: -len(".cursor()")] in links:
                    cursors.update(e.outputs[:1])
                if f.imports("cv2") and "cv2.imread(" in e.right:
                    f.add("call", "python.opencv.imread", e.place, e.text, e.inputs, e.outputs)
                if f.imports("cv2") and "cv2.VideoCapture(" in e.right:
                    f.add("resource_acquire", "python.opencv.capture", e.place, e.text, [], e.outputs)
            elif isinstance(e, Call):
                _py_call(f, e, declared, cursors)


def _py_call(f: _Facts, c: Call, declared: set[str], cursors: set[str]) -> None:
    op, owner = c.callee, c.callee.rpartition(".")[0]
    ins = [x for xs in c.arg_names for x in xs]
    has = lambda text: any(a.replace(" ", "") == text for a in c.args)
    sink = (
        f"python.builtin.{op}" if op in ("eval", "exec") and op not in declared and ins
        else "python.shell.command" if op == "os.system" and f.imports("os") or op in ("subprocess.run", "subprocess.Popen", "subprocess.call") and f.imports("subprocess") and has("shell=True")
        else "python.sql.dynamic" if op.endswith(".execute") and owner in cursors and c.args and not _literal(c.args[0]) or op in ("sqlalchemy.text", "text") and f.imports("sqlalchemy") and ins
        else "python.filesystem.path" if op == "open" and "open" not in declared and ins
        else "python.deserialize.unsafe" if op in ("pickle.load", "pickle.loads") and f.imports("pickle") and ins
        else "python.torch.load.unsafe" if op == "torch.load" and f.imports("torch") and has("weights_only=False")
        else None
    )
    if sink:
        f.called(c, sink, "sink")
    elif op in ("requests.get", "requests.post", "requests.request") and f.imports("requests") and has("verify=False"):
        f.called(c, "python.tls.verify_disabled", "guard")
    elif op in ("cv2.resize", "cv2.cvtColor") and f.imports("cv2"):
        f.called(c, "python.opencv.image_consumer", "guard")
    elif op.endswith(".release") and f.imports("cv2"):
        f.add("resource_release", "python.opencv.capture.release", c.place, c.text, [owner], call=c)
    else:
        f.called(c, "python.torch.load" if op == "torch.load" and f.imports("torch") else "python.ultralytics.model" if op == "YOLO" and f.imports("ultralytics") else op)


def _rust(f: _Facts) -> None:
    for fn in f.unit.functions:
        f.fn = fn if fn.name else None
        for name, kind, whole in fn.params:
            for package, pattern in RUST_HANDLERS:
                m = re.search(pattern, kind)
                if m and f.imports(package):
                    what = RUST_KINDS[m[0].rpartition("::")[2]]
                    for k in ("http_input", "source"):
                        f.add(k, what, fn.place, whole, [], [name], {"framework": package, "user_controlled": "true"})
                    break
        sleepy = f.imports("tokio") and re.search(r"\basync\b", fn.head) is not None
        for e in fn.events:
            if isinstance(e, Control) and e.what == "unsafe":
                f.add("control", "rust.unsafe_block", e.place, e.text)
            elif isinstance(e, Assign):
                f.add("propagation", e.callee or ("binding" if e.text.startswith("let") else "assignment"), e.place, e.text, e.inputs, e.outputs, {"conditional": "true" if e.conditional else ""}, call=e.call)
            elif isinstance(e, Call):
                text, low = e.text, [x for xs in [e.names, *e.arg_names] for x in xs if x[:1].islower()]
                method = re.split(r"\.|::", e.callee)[-1]
                literal = bool(e.args) and e.args[0].lstrip("& ").startswith('"')
                if sleepy and text.startswith("std::thread::sleep(") and not any("spawn_blocking" in x for x in e.inside):
                    f.called(e, "rust.async.blocking_sleep", "guard")
                elif (f.imports("sqlx") and e.callee in ("sqlx::query", "sqlx::query_as", "sqlx::query_scalar") or f.imports("diesel") and e.callee == "diesel::sql_query") and e.args and not literal:
                    f.called(e, "rust.sql.dynamic", "sink")
                elif "std::process::Command::new(" in text and ('"sh"' in text or '"bash"' in text) and '.arg("-c")' in text and low:
                    f.add("sink", "rust.shell.command", e.place, text, low, call=e)
                elif text.startswith("std::fs::") and low:
                    f.called(e, "rust.filesystem.path", "sink")
                elif f.imports("reqwest") and (text.startswith("reqwest::get(") or "Client::get(" in text) and low:
                    f.called(e, "rust.http.outbound_url", "sink")
                elif f.imports("reqwest") and method == "danger_accept_invalid_certs" and [a.strip() for a in e.args] == ["true"]:
                    f.called(e, "rust.tls.invalid_certs", "guard")
                else:
                    f.called(e)
            else:
                f.common(e)


def _cs(f: _Facts) -> None:
    for fn in f.unit.functions:
        f.fn = fn
        external: set[str] = set()
        built: set[str] = set()
        contexts = {n for n, t, _ in fn.params if t.split("[")[0].strip().endswith("DbContext")}
        for name, _, whole in fn.params:
            what = next((op for mark, op in CS_INPUTS.items() if mark in whole), None)
            if what and f.imports("Microsoft.AspNetCore"):
                external.add(name)
                for k in ("http_input", "source"):
                    f.add(k, what, fn.place, whole, [], [name], {"framework": "aspnetcore", "user_controlled": "true"})
        kinds = [t.split()[-1] if t else "" for _, t, _ in fn.params]
        handler = len(kinds) == 2 and kinds[0] == "object" and kinds[1].endswith("EventArgs")
        concurrent = re.search(r"\basync\b", fn.head) is not None
        if concurrent:
            void = re.search(r"\bvoid\s+\w+\s*\(", fn.head) is not None and not handler
            f.add("guard" if void else "control", "csharp.async_void" if void else "csharp.async_task", fn.place, fn.head)
        if f.imports("System.Net.Http") and "ServerCertificateCustomValidationCallback" in fn.text and "=> true" in fn.text:
            f.add("guard", "csharp.tls.validation_bypass", fn.place, fn.head)
        for e in fn.events:
            f.common(e)
            if isinstance(e, Assign):
                f.add("propagation", e.callee or "assignment", e.place, e.text, e.inputs, e.outputs, {"conditional": "true" if e.conditional else ""}, call=e.call)
                if e.right.startswith("$") and e.inputs or "+" in e.right and e.inputs or any(x in built for x in e.inputs):
                    built.update(e.outputs)
                if any(x in external for x in e.inputs):
                    external.update(e.outputs)
                what = next((op for mark, op in CS_MEMBERS.items() if re.search(rf"\b[Rr]equest\{mark}\b", e.right)), None)
                if what and f.imports("Microsoft.AspNetCore"):
                    external.update(e.outputs)
                    for k in ("http_input", "source"):
                        f.add(k, what, e.place, e.text, [], e.outputs, {"framework": "aspnetcore", "user_controlled": "true"})
            elif isinstance(e, Call):
                owner, _, method = e.callee.rpartition(".")
                ins = [x for xs in e.arg_names for x in xs]
                first = e.arg_names[0] if e.arg_names else []
                args = [*e.args, "", ""]
                if method in ("ExecuteSqlRaw", "FromSqlRaw") and owner.endswith(".Database") and owner[: -len(".Database")] in contexts and f.imports("Microsoft.EntityFrameworkCore"):
                    dynamic = args[0].lstrip().startswith("$") or bool(first) and (first[0] in built or first[0] in external)
                    f.called(e, f"csharp.ef.raw_sql.{'dynamic' if dynamic else 'parameterized'}", "sink" if dynamic else "database_operation")
                elif f.imports("System.Diagnostics") and e.callee == "Process.Start" and len(e.args) > 1 and re.search(r"cmd\.exe|powershell|pwsh", args[0]) and "/c" in args[1]:
                    f.called(e, "csharp.shell.command", "sink")
                elif f.imports("System.IO") and e.callee.startswith(("File.", "Directory.")) and ins:
                    f.called(e, "csharp.filesystem.path", "sink")
                elif f.imports("System.Net.Http") and "HttpClient" in e.text and method in ("GetAsync", "SendAsync") and ins:
                    f.called(e, "csharp.http.outbound_url", "sink")
                elif f.imports("System.Threading.Tasks") and method == "Wait" and "Task." in e.text and not e.args and concurrent:
                    f.called(e, "csharp.task.blocking", "guard")
                else:
                    f.called(e, method)


def symbols(unit: Unit) -> list[tuple[str, str, int]]:
    """(kind, name, line) of the variables, constants and packages that a file declares."""
    text, out = unit.text, []
    line = lambda at: text.count("\n", 0, at) + 1
    if unit.language == "Go":
        if m := re.search(r"(?m)^package\s+(\w+)", text):
            out.append(("Package", m[1], line(m.start())))
        for m in re.finditer(r"(?m)^[ \t]*(var|const)\s+(\w+)", text):
            out.append(("Variable" if m[1] == "var" else "Constant", m[2], line(m.start(1))))
        for m in re.finditer(r"(?m)^(var|const)\s*\(\n(.*?)^\)", text, re.S):
            for x in re.finditer(r"(?m)^\t(\w+)", m[2]):
                out.append(("Variable" if m[1] == "var" else "Constant", x[1], line(m.start(2) + x.start(1))))
    elif unit.language == "Python":
        out += [("Variable", o, e.place[0]) for fn in unit.functions if not fn.name for e in fn.events if isinstance(e, Assign) for o in e.outputs]
    elif unit.language == "Rust":
        out += [("Constant" if m[1] == "const" else "Variable", m[2], line(m.start(1))) for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(const|static)\s+(?:mut\s+)?(\w+)\s*:", text)]
        out += [("Variable", o, e.place[0]) for fn in unit.functions for e in fn.events if isinstance(e, Assign) and e.text.startswith("let") for o in e.outputs]
    else:
        out += [("Variable", m[1], line(m.start(1))) for m in re.finditer(r"\b[A-Za-z_][\w<>\[\],?.]*\s+([A-Za-z_]\w*)\s*\{\s*(?:get|set|init)\b", text)]
        out += [("Variable", o, e.place[0]) for fn in unit.functions for e in fn.events if isinstance(e, Assign) and len(e.text.split("=")[0].split()) > 1 for o in e.outputs]
    return sorted(set(out), key=lambda x: (x[2], x[1], x[0]))


_RULES = {"Go": _go, "Python": _py, "Rust": _rust, "C#": _cs}


def facts_of(language: str, file: str, text: str) -> tuple[list[tuple], Unit] | None:
    """The facts of a file in the order of their places, and what they were read from; None if it cannot be read."""
    unit = read(language, text)
    if unit is None:
        return None
    out = _Facts(unit, file)
    _RULES[language](out)
    return sorted(out.rows, key=lambda r: (r[7], r[8], r[1], r[2])), unit


def semantic_facts(files: DataFrame, key: str = "file_id", path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """(key, fact...) of every file, one scan and no shuffle; see `SCHEMA`.

    A row of kind `function` (operation and function: its name; arguments: its
    parameters) comes for each function, one of kind `import` (operation: the
    path, expression: the alias) for each import, one of kind `symbol`
    (operation: the name, expression: its kind) for each declaration. Files that cannot be read,
    null contents and other languages give no row.
    """
    key_type = files.schema[key].dataType.simpleString()
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    text, many = pa.string(), pa.list_(pa.string())
    types = [text] * 7 + [pa.int32()] * 4 + [many, pa.list_(many), many, many, pa.map_(text, text)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            rows: list[tuple] = []
            for i, (file, lang, body) in enumerate(zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), strict=True)):
                if body is None or lang not in READERS:
                    continue
                found = facts_of(lang, file or "", body)
                if found is None:
                    continue
                own, unit = found
                own = own + [(fact_id("function", fn.name, file or "", *fn.place[:2]), "function", fn.name, file, fn.name, fn.receiver, fn.head, *fn.place, [p[0] for p in fn.params], [], [], [], {}) for fn in unit.functions if fn.name]
                own = own + [(fact_id("import", p, file or "", 0, n), "import", p, file, "", "", a, 0, 0, 0, 0, [], [], [], [], {}) for n, (a, p) in enumerate(sorted(unit.imports.items()))]
                own = own + [(fact_id("symbol", f"{k}:{x}", file or "", n, 0), "symbol", x, file, "", "", k, n, 0, n, 0, [], [], [], [], {}) for k, x, n in symbols(unit)]
                rows += own
                take += [i] * len(own)
                if len(rows) > 20_000:
                    yield _batch(batch, key, take, rows, types, names)
                    take, rows = [], []
            if rows:
                yield _batch(batch, key, take, rows, types, names)

    return files.select(key, path, language, content).mapInArrow(extract, f"`{key}` {key_type}, {SCHEMA}")


def _batch(batch: pa.RecordBatch, key: str, take: list[int], rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)]
    cols[-1] = [list(m.items()) for m in cols[-1]]
    return pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *names])
