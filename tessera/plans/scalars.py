"""Scalar function queries: constants and table columns run through the helpers of tessera.functions, beside plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json as J
from tessera.functions import scalar as S
from tessera.session import table

L = F.lit


def _sql_one(values: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in values.items())


def _big(c: Column) -> Column:
    return c.cast("bigint")


def _pairs() -> dict:
    """name: {column: (our expression, made when there is a session; its value in SQL)}"""
    null = lambda: L(None).cast("string")
    ts = lambda: L("2024-03-15 13:45:30").cast("timestamp_ntz")
    day = lambda: L("2024-03-15").cast("date")
    doc = lambda: L('{"a": {"b": [1, 2.5, "x"]}, "c": null, "d": true}')
    return {
        "fn_string_concat": {
            "c_null": (lambda: S.concat(L("a"), null(), L("b")), "'ab'"), "c_op": (lambda: F.expr("'a' || 'b'"), "'a' || 'b'"), "c_op_null": (lambda: F.expr("'a' || CAST(NULL AS STRING)"), "'a' || CAST(NULL AS VARCHAR)"),
            "c_ws": (lambda: F.concat_ws("-", L("a"), null(), L("b")), "concat_ws('-', 'a', NULL, 'b')"), "rep": (lambda: F.repeat(L("ab"), 3), "repeat('ab', 3)"), "sp": (lambda: F.repeat(L(" "), L(4)), "'    '"), "rev": (lambda: F.reverse(L("abc")), "reverse('abc')"), "repl": (lambda: F.replace(L("banana"), L("an"), L("o")), "replace('banana', 'an', 'o')"),
        },
        "fn_string_length": {
            "len": (lambda: _big(F.length(L("你好a"))), "length('你好a')"), "chars": (lambda: _big(F.char_length(L("héllo"))), "length('héllo')"), "octets": (lambda: _big(F.octet_length(L("你好"))), "CAST(6 AS BIGINT)"),
            "up": (lambda: F.ucase(L("aBc")), "upper('aBc')"), "low": (lambda: F.lcase(L("aBc")), "lower('aBc')"), "tr": (lambda: F.trim(L("  x ")), "trim('  x ')"), "lt": (lambda: F.ltrim(L("  x ")), "ltrim('  x ')"), "rt": (lambda: F.rtrim(L("  x ")), "rtrim('  x ')"),
            "lead": (lambda: F.expr("TRIM(LEADING 'x' FROM 'xxabx')"), "ltrim('xxabx', 'x')"), "trail": (lambda: F.expr("TRIM(TRAILING 'x' FROM 'xxabx')"), "rtrim('xxabx', 'x')"), "both_": (lambda: F.expr("TRIM(BOTH 'x' FROM 'xxabx')"), "trim('xxabx', 'x')"),
            "lp": (lambda: F.lpad(L("7"), 3, "0"), "lpad('7', 3, '0')"), "rp": (lambda: F.rpad(L("abcd"), 2, "*"), "rpad('abcd', 2, '*')"), "l_": (lambda: F.left(L("abcdef"), L(2)), "left('abcdef', 2)"), "r_": (lambda: F.right(L("abcdef"), L(2)), "right('abcdef', 2)"),
        },
        "fn_string_substr": {
            "mid": (lambda: S.substr(L("abcdef"), 2, 3), "substr('abcdef', 2, 3)"), "neg": (lambda: S.substr(L("abcdef"), -3, 2), "'de'"), "zero": (lambda: S.substr(L("abc"), 0, 2), "''"), "far": (lambda: S.substr(L("abc"), 9), "''"), "over": (lambda: S.substr(L("abc"), -9, 2), "''"),
            "frm": (lambda: F.expr("SUBSTRING('abcdef' FROM 3 FOR 2)"), "substring('abcdef' FROM 3 FOR 2)"), "idx": (lambda: F.substring_index(L("a.b.c"), ".", 2), "'a.b'"), "idxn": (lambda: F.substring_index(L("a.b.c"), ".", -1), "'c'"), "ins": (lambda: S.insert(L("Quadratic"), 3, 4, L("What")), "'QuWhattic'"), "ins_out": (lambda: S.insert(L("abc"), 9, 1, L("x")), "'abc'"),
        },
        "fn_string_search": {
            "ins": (lambda: _big(F.instr(L("foobar"), "bar")), "CAST(instr('foobar', 'bar') AS BIGINT)"), "none": (lambda: _big(F.instr(L("foobar"), "Bar")), "CAST(0 AS BIGINT)"), "loc": (lambda: _big(F.locate("bc", L("a%bc%bc"), 3)), "CAST(3 AS BIGINT)"), "pos": (lambda: _big(F.expr("position('b' IN 'abc')")), "CAST(position('b' IN 'abc') AS BIGINT)"), "pos_null": (lambda: _big(F.expr("position(CAST(NULL AS STRING) IN 'abc')")), "CAST(NULL AS BIGINT)"), "empty": (lambda: _big(F.locate("", L("abc"), 1)), "CAST(1 AS BIGINT)"),
            "fld": (lambda: S.field(L("b"), "a", "b", "c"), "CAST(2 AS BIGINT)"), "fld0": (lambda: S.field(L("z"), "a", "b"), "CAST(0 AS BIGINT)"), "el": (lambda: S.elt(L(2), "x", "y"), "'y'"), "el_out": (lambda: S.elt(L(5), "x", "y"), "CAST(NULL AS VARCHAR)"), "fis": (lambda: S.find_in_set(L("b"), L("a,b,c")), "CAST(2 AS BIGINT)"), "cmp": (lambda: S.strcmp(L("a"), L("b")), "-1"), "cmp0": (lambda: S.strcmp(L("b"), L("b")), "0"),
        },
        "fn_string_code": {
            "asc_": (lambda: F.ascii(L("A")), "ascii('A')"), "hx": (lambda: F.hex(L("abc")), "hex('abc')"), "hxi": (lambda: F.hex(L(255)), "'FF'"), "unhx": (lambda: F.unhex(L("616263")).cast("string"), "'abc'"), "m5": (lambda: F.md5(L("abc")), "md5('abc')"), "s1": (lambda: F.sha1(L("abc")), "'a9993e364706816aba3e25717850c26c9cd0d89d'"), "s2": (lambda: F.sha2(L("abc"), 256), "sha256('abc')"),
            "sdx": (lambda: F.soundex(L("Robert")), "'R163'"), "dif": (lambda: S.difference(L("Robert"), L("Rupert")), "4"), "q": (lambda: S.quote(L("it's")), "'''it''''s'''"), "qn": (lambda: S.quote(null()), "'NULL'"), "fmt": (lambda: F.format_number(L(12345.678), 2), "'12,345.68'"), "pf": (lambda: F.format_string("%05d|%s", L(42), L("x")), "'00042|x'"),
            "ms": (lambda: S.make_set(L(5), "a", "b", "c"), "'a,c'"), "es": (lambda: S.export_set(L(5), "Y", "N", ",", 4), "'Y,N,Y,N'"), "gl": (lambda: S.glob(L("file7.txt"), "file[0-9].t?t"), "true"), "cheq": (lambda: S.char_equal(L("ab  "), L("ab")), "true"),
        },
        "fn_numeric": {
            "ab": (lambda: F.abs(L(-5)), "5"), "sg": (lambda: F.signum(L(-2.5)), "CAST(-1 AS DOUBLE)"), "ce": (lambda: _big(F.ceil(L(1.2))), "CAST(2 AS BIGINT)"), "fl": (lambda: _big(F.floor(L(-1.2))), "CAST(-2 AS BIGINT)"), "rd": (lambda: F.round(L(2.5)), "CAST(3 AS DOUBLE)"), "rdn": (lambda: F.round(L(-3.5)), "CAST(-4 AS DOUBLE)"), "rd2": (lambda: F.round(L(3.14159), 2), "CAST(3.14 AS DOUBLE)"),
            "tr": (lambda: S.truncate(L(3.789), 1), "CAST(3.7 AS DOUBLE)"), "trn": (lambda: S.truncate(L(-3.789)), "CAST(-3 AS DOUBLE)"), "tr100": (lambda: S.truncate(L(1234.0), -2), "CAST(1200 AS DOUBLE)"), "md": (lambda: S.mod(L(17), L(5)), "2"), "md0": (lambda: S.mod(L(17), L(0)), "CAST(NULL AS INTEGER)"), "dv": (lambda: _big(S.div(L(-7), L(2))), "CAST(-3 AS BIGINT)"), "dv0": (lambda: _big(S.div(L(7), L(0))), "CAST(NULL AS BIGINT)"),
            "pw": (lambda: F.pow(L(2.0), L(10.0)), "pow(2, 10)"), "sq": (lambda: S.sqrt(L(16.0)), "sqrt(16)"), "sqn": (lambda: S.sqrt(L(-1.0)), "CAST(NULL AS DOUBLE)"), "ex": (lambda: F.round(F.exp(L(1.0)), 9), "round(exp(1), 9)"), "ln_": (lambda: F.round(S.log(L(10.0)), 9), "round(ln(10), 9)"), "lg0": (lambda: S.log(L(0.0)), "CAST(NULL AS DOUBLE)"), "lgb": (lambda: F.round(S.log(L(8.0), 2), 9), "CAST(3 AS DOUBLE)"), "lg2": (lambda: F.log2(L(8.0)), "CAST(3 AS DOUBLE)"), "lg10": (lambda: F.log10(L(1000.0)), "log10(1000)"),
            "gr": (lambda: F.greatest(L(1), L(3), L(2)), "3"), "le": (lambda: F.least(L(1), L(3), L(2)), "1"), "grn": (lambda: S.greatest_strict(L(1), L(None).cast("int")), "CAST(NULL AS INTEGER)"), "bi": (lambda: F.bin(L(10)), "'1010'"), "oc": (lambda: S.oct_(L(64)), "'100'"), "cv": (lambda: F.conv(L("ff"), 16, 10), "'255'"), "iv": (lambda: S.interval(L(23), 1, 15, 17, 30, 44), "3"),
            "an": (lambda: F.expr("6 & 3"), "6 & 3"), "orr": (lambda: F.expr("6 | 3"), "6 | 3"), "xo": (lambda: F.expr("6 ^ 3"), "xor(6, 3)"), "no": (lambda: F.expr("~6"), "~6"), "shl": (lambda: F.shiftleft(L(1), 4), "16"), "shr": (lambda: F.shiftright(L(256), 4), "16"), "nul": (lambda: L(None).cast("int") + L(1), "CAST(NULL AS INTEGER) + 1"),
        },
        "fn_trig": {k: ((lambda c=c: F.round(c(), 9)), f"round({s}, 9)") for k, (c, s) in {
            "a": (lambda: F.sin(L(1.0)), "sin(1)"), "b": (lambda: F.cos(L(1.0)), "cos(1)"), "c": (lambda: F.tan(L(1.0)), "tan(1)"), "d": (lambda: F.cot(L(1.0)), "cot(1)"), "e": (lambda: F.asin(L(0.5)), "asin(0.5)"), "f": (lambda: F.acos(L(0.5)), "acos(0.5)"), "g": (lambda: F.atan(L(2.0)), "atan(2)"), "h": (lambda: F.atan2(L(1.0), L(2.0)), "atan2(1, 2)"),
            "i": (lambda: F.sinh(L(1.0)), "sinh(1)"), "j": (lambda: F.cosh(L(1.0)), "cosh(1)"), "k": (lambda: F.tanh(L(1.0)), "tanh(1)"), "l": (lambda: F.asinh(L(1.0)), "asinh(1)"), "m": (lambda: F.acosh(L(2.0)), "acosh(2)"), "n": (lambda: F.atanh(L(0.5)), "atanh(0.5)"), "o": (lambda: F.pi(), "pi()"), "p": (lambda: F.degrees(L(1.0)), "degrees(1)"), "q": (lambda: F.radians(L(90.0)), "radians(90)"),
        }.items()},
        "fn_conditional": {
            "co": (lambda: F.coalesce(null(), L("x")), "coalesce(NULL, 'x')"), "ifn": (lambda: F.ifnull(null(), L("y")), "ifnull(NULL, 'y')"), "nif": (lambda: F.nullif(L("a"), L("a")), "CAST(NULL AS VARCHAR)"), "nif2": (lambda: F.nullif(L("a"), L("b")), "nullif('a', 'b')"), "if_": (lambda: F.expr("if(1 < 2, 'yes', 'no')"), "'yes'"), "typ": (lambda: F.typeof(L(1.5)), "'double'"),
        },
        "fn_cast_lenient": {
            "s": (lambda: S.cast_signed(L("12abc")), "CAST(12 AS BIGINT)"), "g": (lambda: S.cast_signed(L("abc")), "CAST(0 AS BIGINT)"), "u": (lambda: S.cast_unsigned(L("-5")), "CAST(0 AS BIGINT)"), "n": (lambda: S.number(L(" 3.5e1x")), "CAST(35 AS DOUBLE)"), "nn": (lambda: S.number(null()), "CAST(NULL AS DOUBLE)"), "ar": (lambda: S.number(L("7")) + S.number(L("x")), "CAST(7 AS DOUBLE)"), "t": (lambda: L(12).cast("string"), "'12'"), "d": (lambda: L("2024-02-29").cast("date"), "DATE '2024-02-29'"), "bad": (lambda: L("2024-02-30").try_cast("date"), "TRY_CAST('2024-02-30' AS DATE)"),
        },
        "fn_date": {
            "y": (lambda: _big(F.year(day())), "year(DATE '2024-03-15')"), "mo": (lambda: _big(F.month(day())), "month(DATE '2024-03-15')"), "dd": (lambda: _big(F.dayofmonth(day())), "day(DATE '2024-03-15')"), "ex": (lambda: _big(F.expr("extract(QUARTER FROM DATE '2024-03-15')")), "extract(QUARTER FROM DATE '2024-03-15')"), "df": (lambda: _big(F.datediff(L("2024-12-31").cast("date"), L("2024-01-01").cast("date"))), "datediff('day', DATE '2024-01-01', DATE '2024-12-31')"),
            "ad": (lambda: F.date_add(day(), 20), "DATE '2024-04-04'"), "sb": (lambda: F.date_sub(day(), 20), "DATE '2024-02-24'"), "im": (lambda: F.add_months(L("2024-01-31").cast("date"), 1), "DATE '2024-02-29'"), "td": (lambda: _big(F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-03-15 01:00:00', TIMESTAMP_NTZ '2024-03-16 03:30:00')")), "CAST(26 AS BIGINT)"),
            "sf": (lambda: S.strftime("%Y-%m-%d %H:%M:%S day %j", ts()), "'2024-03-15 13:45:30 day 075'"), "fm": (lambda: S.date_format(ts(), "%e %M %Y, %h:%i %p"), "'15 March 2024, 01:45 PM'"), "jd": (lambda: S.julianday(ts()), "epoch(TIMESTAMP '2024-03-15 13:45:30') / 86400 + 2440587.5"), "ux": (lambda: F.unix_timestamp(ts().cast("timestamp")), "CAST(epoch(TIMESTAMP '2024-03-15 13:45:30') AS BIGINT)"), "fu": (lambda: F.from_unixtime(L(0).cast("bigint")), "'1970-01-01 00:00:00'"),
            "m7": (lambda: S.date_modify(ts(), "+7 days").cast("date"), "DATE '2024-03-22'"), "sm": (lambda: S.date_modify(ts(), "start of month", "-1 day").cast("date"), "DATE '2024-02-29'"), "cmp": (lambda: F.expr("DATE '2024-03-15' > '2024-03-01'"), "DATE '2024-03-15' > DATE '2024-03-01'"),
        },
        "fn_date_trunc": {
            "y": (lambda: S.date_trunc("year", ts()), "'2024-01-01'"), "q": (lambda: S.date_trunc("quarter", ts()), "'2024-01-01'"), "m": (lambda: S.date_trunc("month", ts()), "'2024-03-01'"), "d": (lambda: S.date_trunc("day", ts()), "'2024-03-15'"), "h": (lambda: S.date_trunc("hour", ts()), "'2024-03-15 13:00:00'"),
        },
        "fn_json": {
            "v": (lambda: J.json_valid(doc()), "true"), "vb": (lambda: J.json_valid(L("{bad")), "false"), "x": (lambda: J.json_extract(doc(), "$.a.b[2]"), "'x'"), "xm": (lambda: J.json_extract(doc(), "$.zz"), "CAST(NULL AS VARCHAR)"), "t": (lambda: J.json_type(doc()), "'object'"), "tn": (lambda: J.json_type(L("3")), "'integer'"), "le": (lambda: J.json_length(doc()), "CAST(3 AS BIGINT)"), "dp": (lambda: J.json_depth(doc()), "CAST(4 AS BIGINT)"), "q": (lambda: J.json_quote(L('a"b')), "'\"a\\\"b\"'"),
            "st": (lambda: J.json_set(L('{"a":1}'), "$.b", 2), "'{\"a\":1,\"b\":2}'"), "ins": (lambda: J.json_insert(L('{"a":1}'), "$.a", 9), "'{\"a\":1}'"), "rp": (lambda: J.json_replace(L('{"a":1}'), "$.a", 9), "'{\"a\":9}'"), "rm": (lambda: J.json_remove(L('{"a":1,"b":[1,2]}'), "$.b[0]"), "'{\"a\":1,\"b\":[2]}'"), "mg": (lambda: J.json_merge(L('{"a":1}'), L('{"a":2,"b":3}')), "'{\"a\":[1,2],\"b\":3}'"), "ct": (lambda: J.json_contains(L('{"a":[1,2]}'), {"a": [2]}), "true"), "ar": (lambda: F.to_json(F.array(L(1), L(2))), "'[1,2]'"), "ob": (lambda: F.to_json(F.named_struct(L("k"), L("v"))), "'{\"k\":\"v\"}'"),
        },
    }


NAMES = ("fn_string_concat", "fn_string_length", "fn_string_substr", "fn_string_search", "fn_string_code", "fn_numeric", "fn_trig", "fn_conditional", "fn_cast_lenient", "fn_date", "fn_date_trunc", "fn_json")


def _lazy(name: str):
    return lambda spark, d: spark.range(1).select(*[c().alias(k) for k, (c, _) in _pairs()[name].items()])


def json_each(spark: SparkSession, d: str) -> DataFrame:
    J.register(spark)
    table(spark, d, "events").createOrReplaceTempView("events")
    return spark.sql("SELECT e.event_id, j.key, j.value, j.type, j.fullkey FROM events e, LATERAL json_each(e.props, '$') j")


def json_tree(spark: SparkSession, d: str) -> DataFrame:
    J.register(spark)
    return spark.sql("""SELECT key, value, type, atom, id, parent, fullkey, path FROM json_tree('{"a":[1,{"b":"x"}],"c":null}', '$')""")


def events_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", J.json_extract(F.col("props"), "$.k").cast("bigint").alias("k"), J.json_valid(F.col("props")).alias("ok"))


def date_parts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", _big(F.year("o_orderdate")).alias("y"), S.date_trunc("quarter", F.col("o_orderdate")).alias("q"), S.strftime("%Y/%m", F.col("o_orderdate")).alias("ym"), S.date_modify(F.col("o_orderdate"), "start of month", "+1 month", "-1 day").cast("date").alias("last_day"))


def string_columns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", S.substr(F.col("p_name"), -3).alias("tail"), S.field(F.col("p_type"), "PROMO", "SMALL").alias("f"), S.strcmp(F.col("p_name"), F.lit("m")).alias("c"), F.substring_index("p_name", " ", 1).alias("first_word"), S.truncate(F.col("p_retailprice"), -1).alias("tens"))


API = {
    "json_each": (json_each, "SELECT event_id, j.key, CAST(j.value AS VARCHAR) AS value, 'integer' AS type, '$.' || j.key AS fullkey FROM events, json_each(props) j"),
    "json_tree": (json_tree, """SELECT * FROM (VALUES (NULL, '{"a":[1,{"b":"x"}],"c":null}', 'object', NULL, 0::BIGINT, NULL::BIGINT, '$', '$'), ('a', '[1,{"b":"x"}]', 'array', NULL, 1, 0, '$.a', '$'), ('0', '1', 'integer', '1', 2, 1, '$.a[0]', '$.a'), ('1', '{"b":"x"}', 'object', NULL, 3, 1, '$.a[1]', '$.a'), ('b', 'x', 'text', 'x', 4, 3, '$.a[1].b', '$.a[1]'), ('c', 'null', 'null', NULL, 5, 0, '$.c', '$')) v(key, value, type, atom, id, parent, fullkey, path)"""),
    "fn_json_columns": (events_json, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events"),
    "fn_date_columns": (date_parts, "SELECT o_orderkey, year(o_orderdate) AS y, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS q, strftime(o_orderdate, '%Y/%m') AS ym, last_day(o_orderdate) AS last_day FROM orders"),
    "fn_string_columns": (string_columns, "SELECT p_partkey, right(p_name, 3) AS tail, CASE p_type WHEN 'PROMO' THEN 1::BIGINT WHEN 'SMALL' THEN 2 ELSE 0 END AS f, CASE WHEN p_name < 'm' THEN -1 WHEN p_name > 'm' THEN 1 ELSE 0 END AS c, split_part(p_name, ' ', 1) AS first_word, floor(p_retailprice / 10) * 10 AS tens FROM part"),
}


QUERIES = {n: _lazy(n) for n in NAMES} | {k: f for k, (f, _) in API.items()}


ORACLES = {n: _sql_one({k: s for k, (_, s) in p.items()}) for n, p in _pairs().items()} | {k: s for k, (_, s) in API.items()}
