"""JSON functions on text. Reading ones are built-in expressions; those that change documents run in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf


def json_valid(s: Column) -> Column:
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def json_extract(s: Column, path: str) -> Column:
    """NULL for bad JSON and for a missing path."""
    return F.get_json_object(s, path)


def json_length(s: Column) -> Column:
    """Members of an object or elements of an array, 1 for another value."""
    v = F.try_parse_json(s)
    keys = F.size(F.json_object_keys(s))
    return F.when(v.isNull(), None).when(F.ltrim(s).startswith("["), F.json_array_length(s)).when(F.ltrim(s).startswith("{"), keys).otherwise(1).cast("bigint")


def json_type(s: Column) -> Column:
    """object, array, text, integer, real, true, false or null; NULL for bad JSON."""
    return _text(lambda doc: kind_of(doc), s)


def kind_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return {dict: "object", list: "array", str: "text", int: "integer", float: "real"}[type(v)]


def parse_path(path: str) -> list[str | int]:
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path}")
    return [int(a) if a else b or c for a, b, c in re.findall(r"\[(\d+)\]|\.\"([^\"]+)\"|\.([^.\[]+)", path[1:])]


def _load(s: str | None):
    try:
        return json.loads(s), True
    except (TypeError, ValueError):
        return None, False


def _dump(v) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _text(f: Callable, s: Column, kind: str = "string") -> Column:
    """f over parsed documents; NULL for NULL and bad JSON."""

    @pandas_udf(kind)
    def run(docs: pd.Series) -> pd.Series:
        return pd.Series([f(v) if ok else None for v, ok in map(_load, docs)], dtype=object)

    return run(s)


def depth_of(v) -> int:
    return 1 + max(map(depth_of, v.values() if isinstance(v, dict) else v), default=0) if isinstance(v, (dict, list)) else 1


def json_depth(s: Column) -> Column:
    return _text(depth_of, s, "bigint")


def _change(doc, path: list, value, insert: bool, replace: bool):
    if not path:
        return value if replace else doc
    at = doc
    for p in path[:-1]:
        try:
            at = at[p]
        except (KeyError, IndexError, TypeError):
            return doc
    p = path[-1]
    if isinstance(at, dict) and isinstance(p, str):
        if (p in at and replace) or (p not in at and insert):
            at[p] = value
    elif isinstance(at, list) and isinstance(p, int):
        if p < len(at):
            if replace:
                at[p] = value
        elif insert:
            at.append(value)
    return doc


def json_set(s: Column, path: str, value) -> Column:
    """Inserts or replaces."""
    return _text(lambda d: _dump(_change(d, parse_path(path), value, True, True)), s)


def json_insert(s: Column, path: str, value) -> Column:
    return _text(lambda d: _dump(_change(d, parse_path(path), value, True, False)), s)


def json_replace(s: Column, path: str, value) -> Column:
    return _text(lambda d: _dump(_change(d, parse_path(path), value, False, True)), s)


def _removed(doc, path: list):
    at = doc
    try:
        for p in path[:-1]:
            at = at[p]
        del at[path[-1]]
    except (KeyError, IndexError, TypeError):
        pass
    return doc


def json_remove(s: Column, path: str) -> Column:
    return _text(lambda d: _dump(_removed(d, parse_path(path))), s)


def merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: merged(a[k], v) if k in a else v for k, v in b.items()}}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def json_merge(a: Column, b: Column) -> Column:
    """Objects by key, anything else as arrays put together."""

    @pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = zip(map(_load, x), map(_load, y))
        return pd.Series([_dump(merged(p, q)) if ok1 and ok2 else None for (p, ok1), (q, ok2) in pairs], dtype=object)

    return run(a, b)


def contains(doc, part) -> bool:
    if isinstance(doc, dict) and isinstance(part, dict):
        return all(k in doc and contains(doc[k], v) for k, v in part.items())
    if isinstance(doc, list):
        return all(any(contains(d, p) for d in doc) for p in part) if isinstance(part, list) else any(contains(d, part) for d in doc)
    return type(doc) is type(part) and doc == part


def json_contains(s: Column, part) -> Column:
    return _text(lambda d: contains(d, part), s, "boolean")


def json_quote(s: Column) -> Column:
    return F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)


def _rows(doc, path: str, recursive: bool) -> Iterator[tuple]:
    """key, value, type, atom, id, parent, fullkey, path in document order; json_each gives one level, json_tree all."""
    ids = iter(range(1 << 62))

    def row(key, v, parent, full, at):
        leaf = not isinstance(v, (dict, list))
        text = v if isinstance(v, str) else _dump(v)
        return (key, text, kind_of(v), text if leaf and v is not None else None, next(ids), parent, full, at)

    def walk(v, full, me):
        items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        for k, x in items:
            sub = f"{full}[{k}]" if isinstance(k, int) else f"{full}.{k}"
            r = row(str(k), x, me if recursive else None, sub, full)
            yield r
            if recursive:
                yield from walk(x, sub, r[4])

    at = doc
    for p in parse_path(path):
        try:
            at = at[p]
        except (KeyError, IndexError, TypeError):
            return
    if recursive or not isinstance(at, (dict, list)):
        r = row(None, at, None, path, path)
        yield r
        yield from walk(at, path, r[4])
    else:
        yield from walk(at, path, None)


_SCHEMA = "key string, value string, type string, atom string, id bigint, parent bigint, fullkey string, path string"


@udtf(returnType=_SCHEMA)
class JsonEach:
    def eval(self, doc: str, path: str = "$"):
        v, ok = _load(doc)
        if ok:
            yield from _rows(v, path or "$", False)


@udtf(returnType=_SCHEMA)
class JsonTree:
    def eval(self, doc: str, path: str = "$"):
        v, ok = _load(doc)
        if ok:
            yield from _rows(v, path or "$", True)


def register(spark) -> None:
    """json_each and json_tree for SQL: FROM t, LATERAL json_each(t.doc, '$')."""
    spark.udtf.register("json_each", JsonEach)
    spark.udtf.register("json_tree", JsonTree)
