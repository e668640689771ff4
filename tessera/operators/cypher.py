"""Read-only graph queries as text, over operators.graph.

[OPTIONAL] MATCH paths with labels, inline properties and typed hops in either direction, WHERE, WITH, RETURN [DISTINCT],
ORDER BY, SKIP, LIMIT, UNION [ALL], and the aggregates count, sum, avg, min, max and collect. A name.prop reads a
property (text; it is a number beside a number), id(x), labels(x) and type(r) read the rest. Writing, paths of variable
length, UNWIND and CALL are refused.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import Graph

_CLAUSE = re.compile(r"'(?:[^'\\]|\\.)*'|\b(OPTIONAL\s+MATCH|MATCH|WHERE|WITH|RETURN|ORDER\s+BY|SKIP|LIMIT)\b", re.I)
_NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(?:\{([^}]*)\})?\s*\)")
_HOP = re.compile(r"(<)?-\s*(?:\[\s*(\w+)?\s*(?::\s*(\w+))?\s*\])?\s*-(>)?")
_REFUSED = re.compile(r"\b(CREATE|MERGE|SET|DELETE|REMOVE|UNWIND|CALL|DETACH)\b|\[[^\]]*\*", re.I)
_AGGREGATE = re.compile(r"^\s*(count|sum|avg|min|max|collect)\s*\(", re.I)


def _outside(text: str, pattern: str, new) -> str:
    """re.sub on what is not in quotes."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", text)
    parts[::2] = [re.sub(pattern, new, p, flags=re.I) for p in parts[::2]]
    return "".join(parts)


def _expression(text: str) -> str:
    """Spark SQL of an expression."""
    number = r"-?\d+(?:\.\d+)?"
    text = _outside(text, rf"\b([a-z_]\w*)\.([a-z_]\w*)(\s*(?:<=|>=|<>|=|<|>)\s*)(?={number}\b)", r"try_cast(\1.props[`\2`] AS DOUBLE)\3")
    text = _outside(text, r"\b(sum|avg|min|max)\s*\(\s*([a-z_]\w*)\.([a-z_]\w*)\s*\)", r"\1(try_cast(\2.props[`\3`] AS DOUBLE))")
    text = _outside(text, r"\b([a-z_]\w*)\.(?!props\b)([a-z_]\w*)", r"\1.props[`\2`]")
    text = _outside(text, r"\bid\s*\(\s*(\w+)\s*\)", r"\1.id")
    text = _outside(text, r"\blabels\s*\(\s*(\w+)\s*\)", r"\1.labels")
    text = _outside(text, r"\btype\s*\(\s*(\w+)\s*\)", r"\1.type")
    text = _outside(text, r"\bcollect\s*\(", "collect_list(")
    return re.sub(r"\[`(\w+)`\]", r"['\1']", text)


def _split(text: str) -> list[str]:
    """At commas outside brackets and quotes."""
    out, depth, part = [], 0, ""
    for x in re.findall(r"'(?:[^'\\]|\\.)*'|.", text, re.S):
        depth += x in "([{"
        depth -= x in ")]}"
        if x == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += x
    return [*out, part]


def _props(text: str | None) -> dict[str, str]:
    return {k.strip(): v.strip().strip("'\"") for k, v in (p.split(":", 1) for p in _split(text))} if text and text.strip() else {}


class _Names:
    def __init__(self):
        self.n = 0

    def new(self) -> str:
        self.n += 1
        return f"_anon{self.n}"


def _path(graph: Graph, rows: DataFrame | None, text: str, optional: bool, names: _Names) -> DataFrame:
    """rows extended by one path pattern; its first node must be known already, or rows be None or joined crosswise by single rows."""
    at = 0
    m = _NODE.match(text.strip())
    text = text.strip()
    if not m:
        raise ValueError(f"no node pattern: {text}")
    here = m[1] or names.new()
    if rows is None:
        rows = graph.match_nodes(here, m[2], _props(m[3]))
    elif here not in rows.columns:
        raise ValueError(f"a further path must start at a name that is bound: {text}")
    at = m.end()
    while at < len(text):
        h = _HOP.match(text, at)
        n = h and _NODE.match(text, h.end())
        if not n:
            raise ValueError(f"no hop pattern: {text[at:]}")
        direction = "in" if h[1] else "out" if h[4] else "either"
        to = n[1] or names.new()
        bound = to in rows.columns
        target = names.new() if bound else to
        rows = graph.hop(rows, here, target, n[2], _props(n[3]), h[3], direction, h[2], optional)
        if bound:
            rows = rows.where(F.col(target)["id"].eqNullSafe(F.col(to)["id"])).drop(target)
        here, at = to, n.end()
    return rows


def _project(rows: DataFrame, body: str) -> DataFrame:
    distinct = re.match(r"\s*DISTINCT\b", body, re.I)
    items = []
    for item in _split(body[distinct.end() :] if distinct else body):
        m = re.match(r"(.*?)(?:\s+AS\s+(\w+))?\s*$", item.strip(), re.I | re.S)
        expr = m[1].strip()
        items.append((expr, m[2] or re.sub(r"\W+", "_", expr).strip("_") or "value"))
    columns = [F.expr(_expression(e)).alias(a) for e, a in items]
    if any(_AGGREGATE.match(e) for e, _ in items):
        keys = [c for c, (e, _) in zip(columns, items) if not _AGGREGATE.match(e)]
        aggs = [c for c, (e, _) in zip(columns, items) if _AGGREGATE.match(e)]
        out = (rows.groupBy(*keys) if keys else rows).agg(*aggs).select(*[a for _, a in items])
    else:
        out = rows.select(*columns)
    return out.distinct() if distinct else out


def _single(graph: Graph, text: str) -> DataFrame:
    marks = [m for m in _CLAUSE.finditer(text) if m[1]]
    clauses = [(re.sub(r"\s+", " ", m[1].upper()), text[m.end() : (marks[i + 1].start() if i + 1 < len(marks) else len(text))].strip()) for i, m in enumerate(marks)]
    rows, names = None, _Names()
    for kind, body in clauses:
        if kind in ("MATCH", "OPTIONAL MATCH"):
            for path in _split(body):
                rows = _path(graph, rows, path, kind != "MATCH", names)
        elif kind == "WHERE":
            rows = rows.where(_expression(body))
        elif kind in ("WITH", "RETURN"):
            rows = _project(rows, body)
        elif kind == "ORDER BY":
            keys = [re.match(r"(.*?)(\s+DESC|\s+ASC)?\s*$", k.strip(), re.I | re.S) for k in _split(body)]
            rows = rows.orderBy(*[F.expr(_expression(k[1])).desc() if (k[2] or "").strip().upper() == "DESC" else F.expr(_expression(k[1])).asc() for k in keys])
        else:
            rows = rows.offset(int(body)) if kind == "SKIP" else rows.limit(int(body))
    if not clauses or not any(k == "RETURN" for k, _ in clauses):
        raise ValueError("a query ends in RETURN")
    return rows


def cypher(graph: Graph, text: str) -> DataFrame:
    if m := _REFUSED.search(re.sub(r"'(?:[^'\\]|\\.)*'", "''", text)):
        raise ValueError(f"not supported: {m[0]}")
    parts = re.split(r"\bUNION(\s+ALL)?\b", text, flags=re.I)
    out = _single(graph, parts[0])
    for all_, part in zip(parts[1::2], parts[2::2]):
        out = out.union(_single(graph, part))
        if not all_:
            out = out.distinct()
    return out
