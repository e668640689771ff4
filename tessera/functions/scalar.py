"""Column helpers for scalar functions whose Spark namesake is missing or means something else.

All are built-in expressions (no Python per row). NULL arguments give NULL unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings


def concat(*cols: Column) -> Column:
    """Concatenation with NULL as the empty string."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """1-based, from the end if start is negative, '' if start is 0 or beyond the front."""
    if start == 0:
        return F.when(s.isNotNull(), F.lit(""))
    out = F.substring(s, start, length if length is not None else 2**31 - 1)
    return F.when(F.length(s) < -start, "").otherwise(out) if start < 0 else out


def field(x: Column, *values) -> Column:
    """1-based position of x among values, 0 if absent or NULL."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), x), F.lit(0)).cast("bigint")


def elt(i: Column, *values) -> Column:
    """The i-th value, NULL out of range."""
    return F.get(F.array(*map(F.lit, values)), (i - 1).cast("int"))


def find_in_set(x: Column, items: Column) -> Column:
    return F.find_in_set(x, items).cast("bigint")


def insert(s: Column, position: int, length: int, new: Column) -> Column:
    """s with `length` characters from position replaced; s itself if position is outside."""
    return F.when(F.lit(position < 1) | (F.lit(position) > F.length(s)), s).otherwise(F.overlay(s, new, F.lit(position), F.lit(length)))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def quote(s: Column) -> Column:
    """An SQL literal; NULL gives the text NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def make_set(bits: Column, *names: str) -> Column:
    """Names whose bit is set, joined by commas."""
    return F.when(bits.isNotNull(), F.concat_ws(",", *[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(names)]))


def export_set(bits: Column, on: str, off: str, separator: str = ",", n: int = 64) -> Column:
    """One text per bit, lowest first."""
    return F.when(bits.isNotNull(), F.concat_ws(separator, *[F.when(F.shiftright(bits, i).bitwiseAND(F.lit(1)) == 1, on).otherwise(off) for i in range(n)]))


def difference(a: Column, b: Column) -> Column:
    """How many of the four characters of the Soundex codes agree (0 to 4)."""
    x, y = F.soundex(a), F.soundex(b)
    return sum(((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(2, 5)), (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("int"))


def glob_pattern(pattern: str) -> str:
    """The regular expression of a shell pattern."""
    out, i = [], 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 2)
        if c == "[" and end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(s: Column, pattern: str) -> Column:
    """Shell pattern with *, ? and [...], case-sensitive, over the whole string."""
    return s.rlike(glob_pattern(pattern))


def oct_(x: Column) -> Column:
    return F.conv(x.cast("string"), 10, 8)


def char_equal(a: Column, b: Column) -> Column:
    """Equality of CHAR values: spaces at the end do not count."""
    return F.rtrim(a) == F.rtrim(b)


# Numbers


def truncate(x: Column, digits: int = 0) -> Column:
    """Cut towards zero at a decimal place, which may be negative."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def mod(a: Column, b: Column) -> Column:
    """NULL for a divisor of 0."""
    return F.try_mod(a, b)


def div(a: Column, b: Column) -> Column:
    """Integer division towards zero, NULL for a divisor of 0."""
    q = a.cast("double") / F.when(b != 0, b.cast("double"))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def log(x: Column, base: float | None = None) -> Column:
    """NULL outside the domain."""
    ok = F.when(x > 0, x)
    return F.log(ok) if base is None else F.log(float(base), ok)


def interval(n: Column, *bounds: float) -> Column:
    """How many of the ascending bounds are at or below n; -1 for NULL."""
    return F.coalesce(sum((F.when(n >= b, 1).when(n < b, 0) for b in bounds[1:]), F.when(n >= bounds[0], 1).when(n < bounds[0], 0)), F.lit(-1))


def greatest_strict(*cols: Column) -> Column:
    """NULL if any argument is."""
    ok = cols[0].isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    return F.when(ok, F.greatest(*cols))


def number(s: Column) -> Column:
    """Text in arithmetic: its leading number, 0 if it has none."""
    head = F.regexp_extract(F.trim(s), r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+)", 0)
    return F.when(s.isNotNull(), F.coalesce(head.try_cast("double"), F.lit(0.0)))


def cast_signed(s: Column) -> Column:
    n = number(s.cast("string"))
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("bigint")


def cast_unsigned(s: Column) -> Column:
    """Negative numbers become 0."""
    return F.when(s.isNotNull(), F.greatest(cast_signed(s), F.lit(0).cast("bigint")))


# Dates

_UNITS = {"year": "yyyy-01-01", "quarter": None, "month": "yyyy-MM-01", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00:00"}
_STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%M": "mm", "%S": "ss", "%s": "ss", "%j": "DDD", "%f": "SSSSSS", "%%": "%"}
_DATE_FORMAT = _STRFTIME | {"%M": "MMMM", "%b": "MMM", "%c": "M", "%e": "d", "%h": "hh", "%p": "a", "%T": "HH:mm:ss", "%a": "EEE", "%W": "EEEE", "%k": "H"}


def _translate(fmt: str, table: dict[str, str]) -> str:
    out = []
    for part in re.findall(r"%.|[^%]+", fmt):
        if part.startswith("%"):
            if part not in table:
                raise ValueError(f"unknown date format {part}")
            out.append(table[part] if part != "%%" else "'%'")
        else:
            out.append("'" + part.replace("'", "''") + "'" if re.search(r"[A-Za-z']", part) else part)
    return "".join(out)


def strftime(fmt: str, d: Column) -> Column:
    return F.date_format(d, _translate(fmt, _STRFTIME))


def date_format(d: Column, fmt: str) -> Column:
    return F.date_format(d, _translate(fmt, _DATE_FORMAT))


def date_trunc(unit: str, d: Column) -> Column:
    """As text; units year, quarter, month, day and hour, others are an error."""
    if unit.lower() not in _UNITS:
        raise ValueError(f"unknown unit {unit}")
    if unit.lower() == "quarter":
        return F.date_format(F.date_trunc("quarter", d), "yyyy-MM-dd")
    return F.date_format(d, _UNITS[unit.lower()])


def date_modify(d: Column, *modifiers: str) -> Column:
    """Modifiers such as '+7 days', '-1 month', 'start of month', 'start of year', 'start of day'."""
    for m in modifiers:
        if s := re.fullmatch(r"start of (day|month|year)", m.strip()):
            d = F.date_trunc(s[1], d)
        elif s := re.fullmatch(r"([+-]?\d+) (second|minute|hour|day|month|year)s?", m.strip()):
            k, unit = int(s[1]), s[2]
            d = d + F.make_interval(**{f"{unit}s" if unit not in ("minute", "second") else {"minute": "mins", "second": "secs"}[unit]: F.lit(k)})
        else:
            raise ValueError(f"unknown modifier {m}")
    return d


def julianday(d: Column) -> Column:
    return F.unix_micros(d.cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(2440587.5)
