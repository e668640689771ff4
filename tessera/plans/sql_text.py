"""The function meanings and clauses of the dialect as SQL text, each beside plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.common import sql_query
from tessera.plans.dialect import run

TS = "TIMESTAMP_NTZ '2024-03-15 13:45:30'"


def _row(*pairs: tuple[str, str]) -> tuple[str, str]:
    """Our and their text of one row of constants."""
    return tuple("SELECT " + ", ".join(f"{p[side]} AS c{i}" for i, p in enumerate(pairs)) for side in (0, 1))


# name: (ours, theirs)
PAIRS = {
    "sql_fn_concat": _row(("CONCAT('a', NULL, 'b')", "'ab'"), ("CONCAT('n', 1 + 1)", "'n2'"), ("'a' || CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"), ("CONCAT(NULL)", "''"), ("CONCAT_WS('-', 'a', NULL, 'b')", "'a-b'")),
    "sql_fn_substr": _row(("SUBSTR('abcdef', 2, 3)", "'bcd'"), ("SUBSTRING('abcdef', -3, 2)", "'de'"), ("SUBSTR('abc', 0, 2)", "''"), ("SUBSTR('abc', 9)", "''"), ("MID('abc', -9, 2)", "''"), ("SUBSTRING('abcdef' FROM 3 FOR 2)", "'cd'"), ("SUBSTR('abcdef', 1 - 3)", "'ef'"), ("INSERT('Quadratic', 3, 4, 'What')", "'QuWhattic'"), ("INSERT('abc', 9, 1, 'x')", "'abc'"), ("SUBSTR(NULL, 0)", "CAST(NULL AS VARCHAR)")),
    "sql_fn_search": _row(("FIELD('b', 'a', 'b', 'c')", "CAST(2 AS BIGINT)"), ("FIELD('z', 'a', 'b')", "CAST(0 AS BIGINT)"), ("FIELD(NULL, 'a')", "CAST(0 AS BIGINT)"), ("ELT(2, 'x', 'y')", "'y'"), ("ELT(5, 'x', 'y')", "CAST(NULL AS VARCHAR)"), ("ELT(0, 'x')", "CAST(NULL AS VARCHAR)"), ("FIND_IN_SET('b', 'a,b,c')", "CAST(2 AS BIGINT)"), ("STRCMP('a', 'b')", "-1"), ("STRCMP('b', 'b')", "0"), ("STRCMP('c', CONCAT('b', 'z'))", "1"), ("STRCMP('c', NULL)", "CAST(NULL AS INTEGER)")),
    "sql_fn_code": _row(("DIFFERENCE('Robert', 'Rupert')", "4"), ("DIFFERENCE('Robert', 'Zulu')", "0"), ("QUOTE('it''s')", "'''it''''s'''"), ("QUOTE(NULL)", "'NULL'"), ("MAKE_SET(5, 'a', 'b', 'c')", "'a,c'"), ("MAKE_SET(0, 'a')", "''"), ("EXPORT_SET(5, 'Y', 'N', ',', 4)", "'Y,N,Y,N'"), ("EXPORT_SET(6, '1', '0', '', 3)", "'011'"), ("OCT(64)", "'100'"), ("SOUNDEX('Robert')", "'R163'")),
    "sql_fn_numeric": _row(("TRUNCATE(3.789D, 1)", "CAST(3.7 AS DOUBLE)"), ("TRUNC(-3.789D)", "CAST(-3 AS DOUBLE)"), ("TRUNCATE(1234.0D, -2)", "CAST(1200 AS DOUBLE)"), ("MOD(17, 5)", "2"), ("MOD(17, 0)", "CAST(NULL AS INTEGER)"), ("MOD(3 + 4, 5 - 1)", "3"), ("17 DIV 5", "CAST(3 AS BIGINT)"), ("SQRT(16)", "CAST(4 AS DOUBLE)"), ("SQRT(-1)", "CAST(NULL AS DOUBLE)"), ("LN(0)", "CAST(NULL AS DOUBLE)"), ("LOG(-5.0D)", "CAST(NULL AS DOUBLE)"), ("ROUND(LOG(2, 8), 9)", "CAST(3 AS DOUBLE)"), ("LOG2(0)", "CAST(NULL AS DOUBLE)"), ("ROUND(LOG10(1000), 9)", "CAST(3 AS DOUBLE)"), ("INTERVAL(23, 1, 15, 17, 30, 44)", "3"), ("INTERVAL(0, 1, 2)", "0"), ("INTERVAL(NULL, 1)", "-1"), ("GREATEST(1, 3, 2)", "3"), ("GREATEST(1, NULL)", "CAST(NULL AS INTEGER)"), ("LEAST(4, 2 + 1)", "3"), ("LEAST(NULL, 2)", "CAST(NULL AS INTEGER)")),
    "sql_fn_cast": _row(("CAST('12abc' AS SIGNED)", "CAST(12 AS BIGINT)"), ("CAST('abc' AS SIGNED)", "CAST(0 AS BIGINT)"), ("CAST('-7.9' AS SIGNED INTEGER)", "CAST(-7 AS BIGINT)"), ("CAST('9007199254740993' AS SIGNED)", "CAST(9007199254740993 AS BIGINT)"), ("CAST('-5' AS UNSIGNED)", "CAST(0 AS BIGINT)"), ("CONVERT('8x', UNSIGNED)", "CAST(8 AS BIGINT)"), ("CAST(' 3.5e1x' AS REAL)", "CAST(35 AS DOUBLE)"), ("CAST(12 AS TEXT)", "'12'"), ("CONVERT(12, CHAR)", "'12'"), ("CAST(NULL AS SIGNED)", "CAST(NULL AS BIGINT)"), ("CAST('2024-02-29' AS DATE)", "DATE '2024-02-29'"), ("CONVERT('4', INT)", "4")),
    "sql_fn_date": _row((f"STRFTIME('%Y-%m-%d %H:%M:%S day %j', {TS})", "'2024-03-15 13:45:30 day 075'"), (f"DATE_FORMAT({TS}, '%e %M %Y, %h:%i %p')", "'15 March 2024, 01:45 PM'"), (f"JULIANDAY({TS})", "CAST(2460385.0732638887 AS DOUBLE)"), (f"DATE({TS}, '+7 days')", "DATE '2024-03-22'"), ("DATE('2024-03-15', 'start of month', '-1 day')", "DATE '2024-02-29'"), ("DATE('2024-03-15')", "DATE '2024-03-15'"), (f"TIME({TS})", "'13:45:30'"), (f"TIME({TS}, '+30 minutes')", "'14:15:30'"), ("DATETIME('2024-03-15', '+1 month')", "'2024-04-15 00:00:00'"), ("DATE('now') = CURRENT_DATE", "true"), ("length(DATETIME('now'))", "19")),
    "sql_fn_date_trunc": _row(*[(f"DATE_TRUNC('{u}', {TS})", f"'{v}'") for u, v in (("year", "2024-01-01"), ("quarter", "2024-01-01"), ("month", "2024-03-01"), ("day", "2024-03-15"), ("hour", "2024-03-15 13:00:00"))]),
    "sql_fn_columns": ("SELECT p_partkey, CONCAT(p_name, ' ', nullif(p_size, 7)) AS a, FIELD(p_type, 'PROMO', 'SMALL') AS f, SUBSTR(p_name, -3) AS tail, TRUNCATE(p_retailprice, -1) AS tens, MOD(p_partkey, p_size - 1) AS m, GREATEST(p_size, nullif(p_size, 3) * 2) AS g FROM part", "SELECT p_partkey, p_name || ' ' || coalesce(CAST(nullif(p_size, 7) AS VARCHAR), '') AS a, CASE p_type WHEN 'PROMO' THEN 1::BIGINT WHEN 'SMALL' THEN 2 ELSE 0 END AS f, right(p_name, 3) AS tail, floor(p_retailprice / 10) * 10 AS tens, CASE WHEN p_size > 1 THEN p_partkey % (p_size - 1) END AS m, CASE WHEN p_size <> 3 THEN p_size * 2 END AS g FROM part"),
    "sql_stddev_population": ("SELECT l_returnflag, round(STDDEV(l_quantity), 6) AS s, round(STD(l_quantity), 6) AS t, round(VARIANCE(l_quantity), 6) AS v, round(STDDEV_SAMP(l_quantity), 6) AS ss FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS t, round(var_pop(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 6) AS ss FROM lineitem GROUP BY l_returnflag"),
    "sql_json_group": ("SELECT n_regionkey, length(JSON_GROUP_ARRAY(nullif(n_nationkey, 3))) AS a, length(JSON_GROUP_OBJECT(n_name, n_nationkey)) AS o FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(length(CAST(to_json(list(nullif(n_nationkey, 3))) AS VARCHAR)) AS INT) AS a, CAST(length(CAST(json_group_object(n_name, n_nationkey) AS VARCHAR)) AS INT) AS o FROM nation GROUP BY n_regionkey"),
    "sql_json_group_one": ("SELECT n_nationkey, JSON_GROUP_ARRAY(n_name) AS a, JSON_GROUP_OBJECT(n_name, nullif(n_regionkey, 0)) AS o FROM nation GROUP BY n_nationkey", "SELECT n_nationkey, '[\"' || any_value(n_name) || '\"]' AS a, '{\"' || any_value(n_name) || '\":' || coalesce(CAST(nullif(any_value(n_regionkey), 0) AS VARCHAR), 'null') || '}' AS o FROM nation GROUP BY n_nationkey"),
    "sql_quantile": ("SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.25), 6) AS q, quantile_disc(c_acctbal, 0.95) AS d FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.25), 6) AS q, list_sort(list(c_acctbal))[1 + CAST(floor(0.95 * (count(*) - 1)) AS INT)] AS d FROM customer GROUP BY c_nationkey"),
    "sql_quantile_cell": ("SELECT o_orderstatus, quantile_cont(CAST(o_orderkey AS DOUBLE), [0.0, 0.5, 1.0]) AS q FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, '[' || min(o_orderkey)::DOUBLE || ', ' || median(o_orderkey) || ', ' || max(o_orderkey)::DOUBLE || ']' AS q FROM orders GROUP BY o_orderstatus"),
    "sql_bare_column": ("SELECT c_nationkey, n_name, n.n_regionkey, count(*) AS n FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY c_nationkey", "SELECT c_nationkey, any_value(n_name) AS n_name, any_value(n_regionkey) AS n_regionkey, count(*) AS n FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY c_nationkey"),
    "sql_escape_long": ("SELECT p_partkey, p_name LIKE '%!!_%' ESCAPE '!!' AS none FROM part WHERE 'a%b' LIKE 'a##%_' ESCAPE '##' AND NOT 'axb' LIKE 'a##%_' ESCAPE '##'", "SELECT p_partkey, p_name LIKE '%!_%' ESCAPE '!' AS none FROM part"),
    "sql_regexp_call": ("SELECT p_partkey, REGEXP(p_name, '^r') AS r, REGEXP(p_name, CAST(NULL AS STRING)) AS n FROM part", "SELECT p_partkey, regexp_matches(p_name, '^r') AS r, CAST(NULL AS BOOLEAN) AS n FROM part"),
    "sql_ntile_edges": ("SELECT s_suppkey, CAST(NTILE() OVER (ORDER BY s_suppkey) AS BIGINT) AS one, CAST(NTILE(1000000) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS many FROM supplier", "SELECT s_suppkey, CAST(1 AS BIGINT) AS one, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS many FROM supplier"),
    "sql_natural_right": ("SELECT * FROM (SELECT s_nationkey AS k, s_suppkey FROM supplier WHERE s_acctbal < 0) b NATURAL RIGHT JOIN (SELECT n_nationkey AS k, n_name FROM nation) a",) * 2,
    "sql_natural_full": ("SELECT * FROM (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey > 1) a NATURAL FULL JOIN (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 4) b",) * 2,
    "sql_rollup_nulls_last": ("SELECT rn, o_orderstatus, n FROM (SELECT o_orderstatus, count(*) AS n, CAST(row_number() OVER (ORDER BY o_orderstatus DESC NULLS FIRST) AS BIGINT) AS rn FROM orders GROUP BY ROLLUP (o_orderstatus)) t",) * 2,
    "sql_empty_relation": ("SELECT 1 AS one, 'x' || 'y' AS two WHERE 1 = 1",) * 2,
    "sql_empty_relation_none": ("SELECT count(*) AS n FROM (SELECT 1 AS one WHERE 1 = 0) t",) * 2,
}


def null_order(spark: SparkSession, d: str) -> DataFrame:
    """The same sort under each setting; an explicit NULLS wins."""
    text = "SELECT '{0}' AS setting, v, CAST(row_number() OVER (ORDER BY v) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY v DESC) AS BIGINT) AS down, CAST(row_number() OVER (ORDER BY v NULLS LAST) AS BIGINT) AS said FROM (VALUES (1), (NULL), (3)) t(v)"
    out = None
    for setting in ("nulls_last", "nulls_first"):
        run(spark, f"SET default_null_order = '{setting}'")
        part = run(spark, text.format(setting))
        out = part if out is None else out.unionByName(part)
    run(spark, "SET default_null_order = 'default'")
    return out


_NULL_ORDER = " UNION ALL ".join(f"SELECT '{s}' AS setting, v, row_number() OVER (ORDER BY v NULLS {w}) AS up, row_number() OVER (ORDER BY v DESC NULLS {w}) AS down, row_number() OVER (ORDER BY v NULLS LAST) AS said FROM (VALUES (1), (NULL), (3)) t(v)" for s, w in (("nulls_last", "LAST"), ("nulls_first", "FIRST")))

QUERIES = {k: sql_query(ours) for k, (ours, _) in PAIRS.items()} | {"sql_null_order": null_order}
ORACLES = {k: theirs for k, (_, theirs) in PAIRS.items()} | {"sql_null_order": _NULL_ORDER}
