"""Nested JSON records as flat tables by shared inlining.

`schema_graph` reads every record once and gives the graph of element types:
which member occurs below which, and whether as an array, an object or a
scalar. `layout` decides from that graph which elements get a table of their
own: repeated ones (an array holds them, or a map keyed by data), shared ones
(they occur below more than one element) and recursive ones; every other
descendant is inlined into the table of its nearest tabled ancestor. `shred`
walks each record along the layout: every object of a tabled element becomes a
row of its table, with its path, the path of the row around it as a foreign
key, and the inlined members as columns.

A record that is JSON text inside a JSON string is read as the JSON it holds, a
leading byte order mark is skipped, and records may be nested to any depth; a
null, empty, incomplete or otherwise unreadable record gives no row. A lone
object where an array belongs has position 0; null and scalar elements of a
tabled array give no row but keep their position.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

#: An object type with more member names than this over all records is a map keyed by data: its members share one node.
MAP_WIDTH = 1000
#: Most nodes of a schema graph; more is no schema, and an error.
MAX_NODES = 50_000
ANY = "*"

Path = tuple[str, ...]

_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<mark>[\[\]{},])|(?P<word>true|false|null|NaN|-?Infinity)|(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(?P<quote>")|(?P<end>\Z))')
_COLON = re.compile(r"[ \t\n\r]*:")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _parse(text: str) -> object:
    """A JSON value of any depth; ValueError when it is not one complete value."""
    root: object = None
    stack: list[dict | list] = []
    names: list[str] = []  # the name that waits for its value, for each open container
    want, at = "value", 0
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError("no JSON")
        at, kind, mark = m.end(), m.lastgroup, m["mark"]
        if want == "end":
            if kind != "end":
                raise ValueError("text after the value")
            return root
        if mark and mark in "]}":
            if not stack or (mark == "}") != (type(stack[-1]) is dict) or want not in ("next", "first"):
                raise ValueError("unbalanced")
            stack.pop()
            names.pop()
            want = "next" if stack else "end"
            continue
        if mark == ",":
            if want != "next":
                raise ValueError("comma")
            want = "more"
            continue
        inside = stack[-1] if stack else None
        if type(inside) is dict and want in ("first", "more"):
            if kind != "quote":
                raise ValueError("no name")
            names[-1], at = scanstring(text, at, True)
            colon = _COLON.match(text, at)
            if colon is None:
                raise ValueError("no colon")
            at, want = colon.end(), "value"
            continue
        if want == "next" or kind == "end":
            raise ValueError("incomplete")
        if mark:
            value: object = {} if mark == "{" else []
        elif kind == "quote":
            value, at = scanstring(text, at, True)
        elif kind == "word":
            value = _WORDS[m["word"]]
        else:
            value = json.loads(m["num"])
        if type(inside) is dict:
            inside[names[-1]] = value
        elif inside is not None:
            inside.append(value)
        else:
            root = value
        if mark:
            stack.append(value)
            names.append("")
            want = "first"
        else:
            want = "next" if stack else "end"


def read_json(text: str | None) -> object:
    """The value of a record, or None when it cannot be read."""
    for _ in range(2):
        if not text:
            return None
        if text[0] == "﻿":
            text = text[1:]
        try:
            value = json.loads(text)
        except RecursionError:
            try:
                value = _parse(text)
            except ValueError:
                return None
        except ValueError:
            return None
        if not isinstance(value, str):
            return value
        text = value
    return None


class _Node:
    """An element of the schema graph. A member named like an element around it is that element again."""

    __slots__ = ("arrays", "kids", "loops", "name", "objects", "scalars", "up")

    def __init__(self, name: str | None = None, up: _Node | None = None) -> None:
        self.name, self.up = name, up
        self.kids: dict[str, _Node] = {}
        self.arrays = self.objects = self.scalars = self.loops = 0

    def kid(self, name: str) -> _Node:
        around: _Node | None = self
        while around is not None and around.name != name:
            around = around.up
        out = self.kids[name] = around or _Node(name, self)
        return out


def _observe(value: object, root: _Node) -> None:
    todo = [(value, root)]
    while todo:
        value, node = todo.pop()
        if type(value) is dict:
            node.objects += 1
            kids = node.kids
            for name, x in value.items():
                kid = kids.get(name) or node.kid(name)
                if type(x) is dict or type(x) is list:
                    kid.loops += kid.up is not node
                    todo.append((x, kid))
                else:
                    kid.scalars += 1
        elif type(value) is list:
            node.arrays += 1
            for x in value:
                if type(x) is dict or type(x) is list:
                    todo.append((x, node))
        else:
            node.scalars += 1


_COUNTS = ("arrays", "objects", "scalars", "loops")


def schema_graph(df: DataFrame, body: str) -> DataFrame:
    """(path, arrays, objects, scalars, loops): one row for each structural path, with how often it was each of these.

    path: member names from the root, without positions. A member named like an
    element around it counts as a loop of that element, so paths hold no name
    twice. Members of maps keyed by data are not folded here; see `folded`.
    """

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _Node()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                value = read_json(text)
                if value is not None:
                    _observe(value, root)
        out: list[tuple] = []
        todo: list[tuple[list[str], _Node]] = [([], root)]
        while todo:
            at, node = todo.pop()
            out.append((at, node.arrays, node.objects, node.scalars, node.loops))
            todo += [([*at, name], kid) for name, kid in node.kids.items() if kid.up is node]
            if len(out) >= 10_000:
                yield _graph_batch(out)
                out = []
        if out:
            yield _graph_batch(out)

    seen = df.select(body).mapInArrow(observe, "path array<string>, arrays bigint, objects bigint, scalars bigint, loops bigint")
    return seen.groupBy("path").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _graph_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    names = [[x.encode("utf-8", "replace").decode() for x in p] for p in cols[0]]
    return pa.record_batch([pa.array(names, pa.list_(pa.string())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["path", *_COUNTS])


def folded(graph: DataFrame, width: int = MAP_WIDTH, most: int = MAX_NODES) -> dict[Path, tuple[int, int, int, int]]:
    """The schema graph on the driver, with the members of maps keyed by data folded into one node `*`.

    An element with more than `width` member names over all records is such a
    map, from the root downwards, so the graph is the same however the records
    are split into tasks. At most `most` rows are collected: larger graphs are
    folded by Spark first, level by level. One that is larger even so is an error.
    """
    level = 0
    rows = graph.limit(most + 1).collect()
    while len(rows) > most:
        if level == 0:
            graph = materialize(graph, "graph")
        deep = F.size("path") > level
        if graph.filter(deep).isEmpty():
            raise ValueError(f"a schema of more than {most} nodes")
        head = F.slice("path", 1, level)
        wide = graph.filter(deep).groupBy(head.alias("_head")).agg(F.count_distinct(F.element_at("path", level + 1)).alias("_n")).filter(F.col("_n") > width).select("_head", F.lit(True).alias("_wide"))
        star = F.concat(head, F.array(F.lit(ANY)), F.slice("path", level + 2, F.greatest(F.size("path") - level - 1, F.lit(0))))
        joined = graph.join(wide, deep & (head == F.col("_head")), "left").withColumn("path", F.when(F.col("_wide"), star).otherwise(F.col("path")))
        graph = materialize(joined.groupBy("path").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "graph")
        level += 1
        rows = graph.limit(most + 1).collect()
    out = {tuple(r.path): tuple(r[c] for c in _COUNTS) for r in rows}
    for at in range(max(map(len, out), default=0)):
        names: dict[Path, set[str]] = {}
        for p in out:
            if len(p) > at:
                names.setdefault(p[:at], set()).add(p[at])
        merged: dict[Path, tuple[int, int, int, int]] = {}
        for p, n in out.items():
            if len(p) > at and (len(names[p[:at]]) > width or p[at] == ANY):
                p = (*p[:at], ANY, *p[at + 1 :])
            merged[p] = tuple(a + b for a, b in zip(n, merged.get(p, (0, 0, 0, 0)), strict=True))
        out = merged
    return out


@dataclass
class Layout:
    """Which elements have tables, why, and which members are columns of each table."""

    tabled: dict[Path, str] = field(default_factory=dict)  # path -> root, repeated, shared, recursive
    columns: dict[Path, list[Path]] = field(default_factory=dict)  # path of a table -> member paths below it
    nodes: set[Path] = field(default_factory=set)
    arrays: set[Path] = field(default_factory=set)  # tables whose rows have positions

    def home(self, table: Path, member: Path) -> tuple[Path, Path]:
        """The table that holds a member below `table`, and its column there."""
        at, column = table, member
        for i in range(1, len(member)):
            if (*table, *member[:i]) in self.tabled:
                at, column = (*table, *member[:i]), member[i:]
        return at, column


def layout(graph: Mapping[Path, tuple[int, int, int, int]], repeated: Iterable[Path] = ()) -> Layout:
    """Tables by shared inlining over the nodes of `folded`.

    repeated: elements that are arrays by declaration even if these data hold none.
    """
    declared = {tuple(p) for p in repeated}
    known = {p[:i] for p in declared for i in range(len(p) + 1)} | {()}
    objects = {p for p, (_, n, _, _) in graph.items() if n} | known
    around: dict[str, set[str]] = {}
    for p in objects:
        if p:
            around.setdefault(p[-1], set()).add(p[-2] if len(p) > 1 else "")
    out = Layout(nodes=set(graph) | known, arrays=declared | {p for p, n in graph.items() if n[0]})
    for p in sorted(objects, key=lambda x: (len(x), x)):
        arrays, _, _, loops = graph.get(p, (0, 0, 0, 0))
        if not p:
            out.tabled[p] = "root"
        elif loops:
            out.tabled[p] = "recursive"
        elif arrays or p in declared or p[-1] == ANY:
            out.tabled[p] = "repeated"
        elif len(around[p[-1]]) > 1:
            out.tabled[p] = "shared"
    for p, (arrays, n, scalars, _) in sorted(graph.items()):
        if p and (scalars or (arrays and not n)):
            home = p[:-1]
            while home not in out.tabled:
                home = home[:-1]
            out.columns.setdefault(home, []).append(p[len(home) :])
    return out


class _Plan:
    """How to walk an element: its table if it is wanted, its members, and the columns asked for."""

    __slots__ = ("asked", "kids", "live", "positions", "star", "table", "wanted")

    def __init__(self, table: str | None, positions: bool, wanted: bool, asked: list[tuple[str, Path]] | None) -> None:
        self.table, self.positions, self.wanted, self.asked = table, positions, wanted, asked
        self.kids: dict[str, tuple[_Plan, int]] = {}  # member -> element and the levels of recursion it adds
        self.star: _Plan | None = None
        self.live = wanted


def _plan(tables: Layout, select: Mapping[Path, Sequence[Path]] | None) -> _Plan:
    plans: dict[Path, _Plan] = {}
    for p in sorted({q[:i] for q in tables.nodes for i in range(len(q) + 1)}, key=len):
        why = tables.tabled.get(p)
        wanted = why is not None and (select is None or p in select)
        asked = None if select is None else [("/".join(w), tuple(w)) for w in select.get(p, ())]
        plans[p] = own = _Plan(json.dumps(p) if why else None, p != () and p in tables.arrays and p[-1] != ANY, wanted, asked)
        if p and p[-1] == ANY:
            plans[p[:-1]].star = own
        elif p:
            plans[p[:-1]].kids[p[-1]] = (own, 0)
    for p in sorted(plans, key=len, reverse=True):
        own = plans[p]
        own.live = own.wanted or select is None or any(k.live for k, _ in own.kids.values()) or (own.star is not None and own.star.live)
    for p, own in plans.items():
        for i in range(len(p), 0, -1):  # a member named like an element around it is that element
            own.kids.setdefault(p[i - 1], (plans[p[:i]], 1))
    return plans[()]


def shred(df: DataFrame, id_col: str, body: str, tables: Layout, select: Mapping[Path, Sequence[Path]] | None = None, levels: int | None = None) -> DataFrame:
    """(`id_col`, node, element, path, parent, level, members): the rows of the layout's tables.

    node: the table, a JSON list of member names; element: its last name. path:
    names and positions as written. parent: the path of the row around it, '' if
    none. level: how often a recursive element was entered again. members: the
    inlined members by their path below the row; a scalar is its text, an array
    of scalars JSON.

    select: only these tables, with the members named; the others are passed
    over, so parent is the nearest row selected. A member that the layout keeps
    in a table below, by a singleton on the way, is read through that table's
    foreign key while the record is at hand; a missing or null one is absent, a
    nested one its JSON text. levels: the greatest level that is followed.
    """
    if select is not None and (unknown := [p for p in select if p not in tables.tabled]):
        raise ValueError(f"no table for {unknown}")
    plan = _plan(tables, select)
    id_type = df.schema[id_col].dataType
    deepest = float("inf") if levels is None else levels

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, take, rows = batch.column(0), [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                value = read_json(text)
                if type(value) is not dict and type(value) is not list:
                    continue
                before = len(rows)
                _emit(value, plan, deepest, rows)
                take += [i] * (len(rows) - before)
                if len(rows) > 20_000:
                    yield _batch(id_col, ids, take, rows)
                    take, rows = [], []
            if rows:
                yield _batch(id_col, ids, take, rows)

    return df.select(id_col, body).mapInArrow(write, f"`{id_col}` {id_type.simpleString()}, node string, element string, path string, parent string, level int, members map<string,string>")


def _emit(value: object, plan: _Plan, deepest: float, rows: list[tuple]) -> None:
    """Adds (node, path, parent, level, members) for each object of a wanted table."""
    todo: list[tuple] = [(value, plan, "", "", "", None, 0)]
    while todo:
        value, own, path, parent, way, members, level = todo.pop()
        if type(value) is list:
            if own.table is None:  # scalars, or a shape that no record had when the layout was made
                if members is not None:
                    members[way] = _text(value)
                continue
            for i in range(len(value) - 1, -1, -1):
                x = value[i]
                if type(x) is dict or type(x) is list:
                    todo.append((x, own, f"{path}/{i}", parent, way, members, level))
            continue
        if own.table is not None:
            way, members = "", None
            if own.wanted:
                if own.asked is None:
                    members = {}
                else:
                    found = [(name, _member(value, w)) for name, w in own.asked]
                    rows.append((own.table, path, parent, level, {k: x for k, x in found if x is not None}))
                if members is not None:
                    rows.append((own.table, path, parent, level, members))
                parent = path
        kids, star = own.kids, own.star
        if members is None:  # only the way to wanted tables
            for k, (kid, deeper) in kids.items():
                if kid.live and level + deeper <= deepest:
                    x = value.get(k)
                    if type(x) is dict or type(x) is list:
                        todo.append(_step(x, kid, k, path, parent, "", None, level + deeper))
            if star is not None and star.live:
                for k, x in value.items():
                    if k not in kids and (type(x) is dict or type(x) is list):
                        todo.append(_step(x, star, k, path, parent, "", None, level))
            continue
        for k, x in value.items():
            kid, deeper = kids.get(k) or (star, 0)
            at = f"{way}/{k}" if way else k
            if type(x) is not dict and type(x) is not list or kid is None:
                if x is not None:
                    members[at] = _text(x)
            elif level + deeper <= deepest:
                todo.append(_step(x, kid, k, path, parent, at, members, level + deeper))


def _step(x: object, kid: _Plan, k: str, path: str, parent: str, way: str, members: dict | None, level: int) -> tuple:
    at = f"{path}/{k}" if path else k
    return (x, kid, f"{at}/0" if kid.positions and type(x) is dict else at, parent, way, members, level)


def _member(value: object, way: Path) -> str | None:
    for k in way:
        if type(value) is not dict:
            return None
        value = value.get(k)
    return None if value is None else _text(value)


def _text(value: object) -> str:
    if type(value) is str:
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return _dump(value)


def _dump(value: object) -> str:
    """JSON text of a value of any depth."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        ready, x = todo.pop()
        if ready:
            out.append(x)
        elif type(x) is dict:
            todo.append((True, "}"))
            for i, (k, y) in enumerate(reversed(x.items())):
                todo += [(True, ", ")] * (i > 0)
                todo += [(False, y), (True, json.dumps(k, ensure_ascii=False) + ": ")]
            todo.append((True, "{"))
        elif type(x) is list:
            todo.append((True, "]"))
            for i, y in enumerate(reversed(x)):
                todo += [(True, ", ")] * (i > 0)
                todo.append((False, y))
            todo.append((True, "["))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _batch(id_col: str, ids: pa.Array, take: list[int], rows: list[tuple]) -> pa.RecordBatch:
    node, path, parent, level, members = zip(*rows, strict=True)
    text, pairs = pa.string(), [list(m.items()) for m in members]
    try:
        vals, paths, parents = pa.array(pairs, pa.map_(text, text)), pa.array(path, text), pa.array(parent, text)
    except (UnicodeEncodeError, pa.ArrowInvalid):  # lone surrogates, which JSON escapes can spell
        clean = lambda x: x.encode("utf-8", "replace").decode()
        vals = pa.array([list({clean(k): clean(v) for k, v in m}.items()) for m in pairs], pa.map_(text, text))
        paths, parents = pa.array(map(clean, path), text), pa.array(map(clean, parent), text)
    elements = {n: (json.loads(n) or ["record"])[-1] for n in set(node)}
    return pa.record_batch([ids.take(pa.array(take, pa.int64())), pa.array(node, text), pa.array([elements[n] for n in node], text), paths, parents, pa.array(level, pa.int32()), vals], names=[id_col, "node", "element", "path", "parent", "level", "members"])
