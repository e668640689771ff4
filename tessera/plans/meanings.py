"""What functions of the SQL dialect mean where Spark has no namesake or one that differs, as SQL expressions.

Each rewriter takes the arguments as texts and returns the expression, or None to leave the call as it is. They are the
meanings of tessera.functions.scalar; an argument may be written out several times, so it should have no side effects.
"""

from __future__ import annotations

import re

from tessera.functions.scalar import _DATE_FORMAT, _STRFTIME, _translate

_NUMBER = r"^[+-]?(\\d+\\.?\\d*([eE][+-]?\\d+)?|\\.\\d+)"


def _literal(x: str) -> str | None:
    """The text of a string literal."""
    x = x.strip()
    return x[1:-1].replace("''", "'") if len(x) > 1 and x[0] == x[-1] == "'" else None


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _substr(s, n, *length):
    long = "".join(f", {x}" for x in length)
    return f"CASE WHEN {n} = 0 AND {s} IS NOT NULL THEN '' WHEN {n} < 0 AND length({s}) < -({n}) THEN '' ELSE substring({s}, {n}{long}) END"


def _make_set(bits, *names):
    each = ", ".join(f"CASE WHEN ({bits} & {1 << i}) <> 0 THEN {x} END" for i, x in enumerate(names))
    return f"CASE WHEN {bits} IS NOT NULL THEN concat_ws(',', {each}) END"


def _export_set(bits, on, off, separator="','", n="64"):
    return f"CASE WHEN {bits} IS NOT NULL THEN array_join(transform(sequence(0, {n} - 1), i -> CASE WHEN (shiftright({bits}, i) & 1) = 1 THEN {on} ELSE {off} END), {separator}) END"


def _difference(a, b):
    return "(" + " + ".join(f"CAST(substring(soundex({a}), {i}, 1) = substring(soundex({b}), {i}, 1) AS INT)" for i in range(1, 5)) + ")"


def _truncate(x, digits="0"):
    if _literal(digits) is not None:
        return None  # of a date
    return f"(signum({x}) * floor(abs({x}) * pow(10, {digits})) / pow(10, {digits}))"


def _log(*args):
    if len(args) == 1:
        return f"CASE WHEN {args[0]} > 0 THEN ln({args[0]}) END"
    base, x = args
    return f"CASE WHEN {x} > 0 AND {base} > 0 AND {base} <> 1 THEN log({base}, {x}) END"


def _interval(n, *bounds):
    if not bounds:
        return None
    return "coalesce(" + " + ".join(f"CAST({n} >= {b} AS INT)" for b in bounds) + ", -1)"


def _all_known(name):
    def rewrite(*args):
        known = " AND ".join(f"{x} IS NOT NULL" for x in args)
        return f"CASE WHEN {known} THEN {name}({', '.join(args)}) END"

    return rewrite


def _strftime(fmt, d):
    f = _literal(fmt)
    return None if f is None else f"date_format({_moment(d)}, {_quoted(_translate(f, _STRFTIME))})"


def _date_format(d, fmt):
    f = _literal(fmt)
    return None if f is None or "%" not in f else f"date_format({d}, {_quoted(_translate(f, _DATE_FORMAT))})"


def _date_trunc(unit, d):
    u, formats = (_literal(unit) or "").lower(), {"year": "yyyy-01-01", "quarter": "yyyy-MM-dd", "month": "yyyy-MM-01", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00:00"}
    if u not in formats:
        raise ValueError(f"unknown unit {unit}")
    return f"date_format(date_trunc('quarter', {d}), 'yyyy-MM-dd')" if u == "quarter" else f"date_format({d}, '{formats[u]}')"


def _moment(x, *modifiers):
    """A time stamp without zone: 'now', a text or a date, changed by modifiers."""
    out = "current_timestamp()" if _literal(x) == "now" else x
    out = f"CAST({out} AS TIMESTAMP_NTZ)"
    for m in map(_literal, modifiers):
        if m and (s := re.fullmatch(r"start of (day|month|year)", m.strip())):
            out = f"CAST(date_trunc('{s[1]}', {out}) AS TIMESTAMP_NTZ)"
        elif m and (s := re.fullmatch(r"([+-]?\d+) (second|minute|hour|day|month|year)s?", m.strip())):
            out = f"({out} + INTERVAL '{int(s[1])}' {s[2].upper()})"
        else:
            raise ValueError(f"unknown modifier {m}")
    return out


def _date(*args):
    return None if len(args) == 1 and _literal(args[0]) != "now" else f"CAST({_moment(*args)} AS DATE)"


def _number(x):
    """Text in arithmetic: its leading number, 0 if it has none."""
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(try_cast(regexp_extract(trim(CAST({x} AS STRING)), '{_NUMBER}', 0) AS DOUBLE), 0.0D) END"


def _signed(x):
    n = _number(x)
    return f"coalesce(try_cast({x} AS BIGINT), CAST(CASE WHEN ({n}) >= 0 THEN floor({n}) ELSE ceil({n}) END AS BIGINT))"


def _unsigned(x):
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({_signed(x)}, 0L) END"


_TYPES = {
    "SIGNED": _signed, "SIGNED INTEGER": _signed, "UNSIGNED": _unsigned, "UNSIGNED INTEGER": _unsigned, "REAL": _number,
    "TEXT": lambda x: f"CAST({x} AS STRING)", "CHAR": lambda x: f"CAST({x} AS STRING)", "DATETIME": lambda x: f"CAST({x} AS TIMESTAMP_NTZ)",
}


def cast(x: str, kind: str) -> str | None:
    """CAST or CONVERT to a type that Spark does not know, or converts less leniently."""
    kind = " ".join(kind.upper().split())
    return _TYPES[kind](x) if kind in _TYPES else None


def _json_pair(k, v):
    return f"concat(substring(to_json(array(CAST({k} AS STRING))), 2, length(to_json(array(CAST({k} AS STRING)))) - 2), ':', substring(to_json(array({v})), 2, length(to_json(array({v}))) - 2))"


def _quantile_cont(x, f):
    f = f.strip()
    if not f.startswith("["):
        return f"percentile({x}, {f})"
    return f"concat('[', array_join(transform(percentile({x}, array({f[1:-1]})), v -> CAST(round(v, 6) AS STRING)), ', '), ']')"


MEANINGS = {
    "CONCAT": lambda *a: "concat(" + ", ".join(f"coalesce(CAST({x} AS STRING), '')" for x in a) + ")",
    "SUBSTR": lambda *a: _substr(*a) if len(a) > 1 else None,
    "SUBSTRING": lambda *a: _substr(*a) if len(a) > 1 else None,
    "MID": lambda *a: _substr(*a),
    "FIELD": lambda x, *a: f"coalesce(CAST(array_position(array({', '.join(a)}), {x}) AS BIGINT), 0L)",
    "ELT": lambda i, *a: f"get(array({', '.join(a)}), CAST({i} AS INT) - 1)",
    "FIND_IN_SET": lambda x, s: f"CAST(find_in_set({x}, {s}) AS BIGINT)",
    "STRCMP": lambda a, b: f"CASE WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1 WHEN {a} = {b} THEN 0 END",
    "QUOTE": lambda s: f"coalesce(concat('\\'', replace({s}, '\\'', '\\'\\''), '\\''), 'NULL')",
    "MAKE_SET": _make_set,
    "EXPORT_SET": _export_set,
    "DIFFERENCE": _difference,
    "INSERT": lambda s, p, n, new: f"CASE WHEN {p} < 1 OR {p} > length({s}) THEN {s} ELSE overlay({s} PLACING {new} FROM {p} FOR {n}) END",
    "OCT": lambda x: f"conv(CAST({x} AS STRING), 10, 8)",
    "TRUNC": _truncate,
    "TRUNCATE": _truncate,
    "MOD": lambda a, b: f"try_mod({a}, {b})",
    "SQRT": lambda x: f"CASE WHEN {x} >= 0 THEN sqrt({x}) END",
    "LN": _log,
    "LOG": _log,
    "LOG2": lambda x: f"CASE WHEN {x} > 0 THEN log2({x}) END",
    "LOG10": lambda x: f"CASE WHEN {x} > 0 THEN log10({x}) END",
    "INTERVAL": _interval,
    "GREATEST": _all_known("greatest"),
    "LEAST": _all_known("least"),
    "JULIANDAY": lambda d: f"(unix_micros(CAST({_moment(d)} AS TIMESTAMP)) / 86400000000.0D + 2440587.5D)",
    "STRFTIME": _strftime,
    "DATE_FORMAT": _date_format,
    "DATE_TRUNC": _date_trunc,
    "DATE": _date,
    "TIME": lambda *a: f"date_format({_moment(*a)}, 'HH:mm:ss')",
    "DATETIME": lambda *a: f"date_format({_moment(*a)}, 'yyyy-MM-dd HH:mm:ss')",
    "STD": lambda x: f"stddev_pop({x})",
    "STDDEV": lambda x: f"stddev_pop({x})",
    "VARIANCE": lambda x: f"var_pop({x})",
    "JSON_GROUP_ARRAY": lambda x: f"to_json(transform(collect_list(struct({x} AS v)), s -> s.v), map('ignoreNullFields', 'false'))",
    "JSON_GROUP_OBJECT": lambda k, v: f"concat('{{', array_join(collect_list({_json_pair(k, v)}), ','), '}}')",
    "QUANTILE_CONT": _quantile_cont,
    "QUANTILE_DISC": lambda x, f: f"get(sort_array(collect_list({x})), CAST(floor({f} * (count({x}) - 1)) AS INT))",
    "CONVERT": lambda *a: None if len(a) != 2 else cast(*a) or f"CAST({a[0]} AS {a[1].strip()})",
    "NTILE": lambda *a: None if a else "ntile(1)",
}


_WHOLE = re.compile(r"[\w.]+|'(?:[^']|'')*'|-?\d+(?:\.\d+)?|\w+\([^()]*\)|\[.*\]|DISTINCT\s.*", re.S | re.I)


def meaning(name: str, args: list[str]) -> str | None:
    """The expression for a call, or None if Spark's own meaning stands."""
    if name not in MEANINGS:
        return None
    try:
        return MEANINGS[name](*[x if _WHOLE.fullmatch(x) else f"({x})" for x in args])
    except TypeError as e:
        raise ValueError(f"{name} does not take {len(args)} arguments") from e
