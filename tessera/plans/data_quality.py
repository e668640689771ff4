"""Queries of the general data problems: p1 (orphans), p3 (two copies), p4 (rolling totals), p6 (implausible readings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.copydiff import copy_differences
from tessera.operators.orphans import Children, Parents, orphan_counts, orphan_references
from tessera.operators.rolling import daily_totals, rolling_extremes, rolling_totals
from tessera.operators.spikes import Metric, Rules, implausible_readings, lay_out, profiles, sketches
from tessera.session import table

SOAK_METRICS = [
    Metric("rss_mb", "mem_mb", zero_ok=False),
    Metric("fd_count", "fd_limit", zero_ok=False),
    Metric("wal_mb"),
    Metric("cpu_pct", "100 * cores"),
]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    children = [
        Children("oltp_orders", table(spark, d, "oltp_orders"), "o_id", "o_loaded_at", {"o_customer_id": "customers"}),
        Children("order_items", table(spark, d, "order_items"), "oi_id", "oi_loaded_at", {"oi_order_id": "oltp_orders", "oi_product_id": "products"}),
    ]
    parents = [
        Parents("customers", table(spark, d, "customers"), "c_id", "c_loaded_at"),
        Parents("oltp_orders", table(spark, d, "oltp_orders"), "o_id", "o_loaded_at"),
        Parents("products", table(spark, d, "products"), "pr_id", "pr_loaded_at"),
    ]
    return orphan_references(children, parents, table(spark, d, "key_deletions"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p1_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    customer = copy_differences(table(spark, d, "customer_primary"), table(spark, d, "customer_replica"), "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_branch"], "c_copied_at")
    nation = copy_differences(table(spark, d, "nation_primary"), table(spark, d, "nation_replica"), "n_nationkey", ["n_name", "n_regionkey", "n_comment"])
    cols = lambda df, t: df.select(F.lit(t).alias("table_name"), F.col("row_key").cast("bigint").alias("row_key"), "difference")
    return cols(customer, "customer").unionByName(cols(nation, "nation"))


def _p4_rolling(spark: SparkSession, d: str, every_day: bool = True) -> DataFrame:
    daily = daily_totals(table(spark, d, "oltp_orders"), "o_customer_id", "o_total", "o_created_at", "o_id")
    known = table(spark, d, "customers").select(F.col("c_id").cast("bigint").alias("entity"))
    return rolling_totals(daily.join(known, "entity", "left_semi"), every_day=every_day)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling_extremes(_p4_rolling(spark, d, every_day=False)).select(F.col("entity").alias("o_customer_id"), "period_days", "extreme", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("trailing_day"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("trailing_day")
    money = [F.round(F.col(c).cast("double") / (100.0 if c.startswith("total") else 1.0), 4).alias(c) for c in ("total_7", "average_7", "total_30", "average_30")]
    return _p4_rolling(spark, d).select(F.col("entity").alias("o_customer_id"), day, *money)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "metrics"), "run_id", "ts", "sample_id", SOAK_METRICS).select("sample_id", "metric")


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """What is usual in each run, metric and hour of day, from the merged sketches."""
    short, cut = lay_out(table(spark, d, "metrics"), "run_id", "ts", "sample_id", SOAK_METRICS)
    sketch = sketches(short if cut is None else short.unionByName(cut), SOAK_METRICS, Rules())
    return profiles(sketch, ("source", "metric", "hour"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p3_found": p3_found, "p4_found": p4_found, "p4_rolling": p4_rolling, "p6_found": p6_found, "p6_profile": p6_profile}

_P1 = """
WITH parents AS (
  SELECT 'customers' AS ref_table, c_id AS ref_key, min(c_loaded_at) AS parent_loaded FROM customers WHERE c_id IS NOT NULL GROUP BY c_id
  UNION ALL SELECT 'oltp_orders', o_id, min(o_loaded_at) FROM oltp_orders WHERE o_id IS NOT NULL GROUP BY o_id
  UNION ALL SELECT 'products', pr_id, min(pr_loaded_at) FROM products WHERE pr_id IS NOT NULL GROUP BY pr_id),
deleted AS (SELECT DISTINCT table_name AS ref_table, key_id AS ref_key FROM key_deletions WHERE restored_at IS NULL),
children AS (
  SELECT 'oltp_orders' AS table_name, 'o_customer_id' AS field_name, 'customers' AS ref_table, o_id AS row_id, o_customer_id AS ref_key, min(o_loaded_at) AS loaded FROM oltp_orders WHERE o_customer_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'order_items', 'oi_order_id', 'oltp_orders', oi_id, oi_order_id, min(oi_loaded_at) FROM order_items WHERE oi_order_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'order_items', 'oi_product_id', 'products', oi_id, oi_product_id, min(oi_loaded_at) FROM order_items WHERE oi_product_id IS NOT NULL GROUP BY ALL),
found AS (
  SELECT c.table_name, c.field_name, c.row_id, strftime(c.loaded, '%Y-%m') AS period_month,
    CASE WHEN d.ref_key IS NOT NULL THEN 'deleted' WHEN p.ref_key IS NULL THEN 'missing' WHEN p.parent_loaded > c.loaded THEN 'late' END AS reason
  FROM children c LEFT JOIN parents p USING (ref_table, ref_key) LEFT JOIN deleted d USING (ref_table, ref_key))
"""

_P4 = """
WITH o AS (SELECT DISTINCT o_id, o_customer_id, o_total, o_created_at FROM oltp_orders
  WHERE o_customer_id IN (SELECT c_id FROM customers) AND o_total IS NOT NULL AND NOT isnan(o_total) AND o_created_at IS NOT NULL),
daily AS (SELECT o_customer_id, CAST(o_created_at AS DATE) AS day, CAST(sum(CAST(round(o_total * 100) AS BIGINT)) AS BIGINT) AS cents FROM o GROUP BY 1, 2),
span AS (SELECT o_customer_id, min(day) AS a, max(day) AS b FROM daily GROUP BY 1),
cal AS (SELECT o_customer_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
r AS (SELECT cal.o_customer_id, cal.day,
    CAST(sum(coalesce(cents, 0)) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS t7,
    CAST(sum(coalesce(cents, 0)) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS t30
  FROM cal LEFT JOIN daily USING (o_customer_id, day) WINDOW w AS (PARTITION BY cal.o_customer_id ORDER BY cal.day))
"""


def _extreme(n: int, e: str) -> str:
    return f"SELECT o_customer_id, CAST({n} AS BIGINT) AS period_days, '{e}' AS extreme, strftime(day, '%Y-%m-%d') AS trailing_day FROM (SELECT *, row_number() OVER (PARTITION BY o_customer_id ORDER BY t{n} {'DESC' if e == 'high' else 'ASC'}, day) AS rn FROM r) WHERE rn = 1"


def _same(a: str, b: str, kind: str) -> str:
    if kind == "string":
        return f"rtrim({a}, ' ') IS NOT DISTINCT FROM rtrim({b}, ' ')"
    if kind == "double":
        f = lambda c: f"CASE WHEN isnan({c}) THEN 'NaN' ELSE CAST(round({c}, 2) + 0.0 AS VARCHAR) END"
        return f"replace({f(a)}, '-0.0', '0.0') IS NOT DISTINCT FROM replace({f(b)}, '-0.0', '0.0')"
    return f"{a} IS NOT DISTINCT FROM {b}"


def _copies(name: str, key: str, fields: dict[str, str]) -> str:
    per = " UNION ALL ".join(f"SELECT '{name}' AS table_name, CAST(p.{key} AS BIGINT) AS row_key, '{f}' AS difference FROM {name}_p p JOIN {name}_r r ON p.{key} = r.{key} WHERE NOT ({_same('p.' + f, 'r.' + f, k)})" for f, k in fields.items())
    alone = " UNION ALL ".join(f"SELECT '{name}', CAST({key} AS BIGINT), 'missing_in_{w}' FROM {name}_{a} WHERE {key} NOT IN (SELECT {key} FROM {name}_{b})" for a, b, w in (("p", "r", "replica"), ("r", "p", "primary")))
    return per + " UNION ALL " + alone


_P3_WITH = "WITH " + ", ".join(f"{n}_{s[0]} AS (SELECT DISTINCT {', '.join([k, *f])} FROM {n}_{s} WHERE {k} IS NOT NULL)" for n, k, f in (("customer", "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_branch"]), ("nation", "n_nationkey", ["n_name", "n_regionkey", "n_comment"])) for s in ("primary", "replica"))

ORACLES = {
    "p1_found": _P1 + "SELECT * FROM found WHERE reason IS NOT NULL",
    "p1_counts": _P1 + "SELECT table_name, field_name, period_month, reason, count(*) AS orphans FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_found": _P3_WITH + " " + _copies("customer", "c_custkey", {"c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string", "c_branch": "int"}) + " UNION ALL " + _copies("nation", "n_nationkey", {"n_name": "string", "n_regionkey": "int", "n_comment": "string"}),
    "p4_found": _P4 + " UNION ALL ".join(_extreme(n, e) for n in (7, 30) for e in ("high", "low")),
    "p4_rolling": _P4 + "SELECT o_customer_id, strftime(day, '%Y-%m-%d') AS trailing_day, round(t7 / 100.0, 4) AS total_7, round(t7 / 700.0, 4) AS average_7, round(t30 / 100.0, 4) AS total_30, round(t30 / 3000.0, 4) AS average_30 FROM r",
}
