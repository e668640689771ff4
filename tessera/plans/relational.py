"""Relational queries: one per operator of the SQL surface, each beside the SQL it must agree with.

SAME holds texts that both engines read alike (ours through the dialect rewriter); PAIRS those spelled differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.common import sql_query
from tessera.session import table

SAME = {
    # scans, projection, filter, predicates
    "scan_columns": "SELECT c_custkey, c_name FROM customer",
    "scan_pk_point": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77",
    "scan_pk_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 250",
    "projection_alias": "SELECT c_custkey AS id, c_acctbal * 2 + 1 AS twice, upper(c_name) AS name FROM customer AS t",
    "projection_star": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "filter_comparisons": "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount <> 0.05 AND NOT (l_tax > 0.04 OR l_tax <= 0.01)",
    "filter_3vl": "WITH t AS (SELECT c_custkey, nullif(c_nationkey % 5, 0) AS x FROM customer) SELECT count(*) AS all_rows, count(x) AS known, CAST(sum(CASE WHEN x > 2 THEN 1 ELSE 0 END) AS BIGINT) AS above, CAST(sum(CASE WHEN NOT (x > 2) THEN 1 ELSE 0 END) AS BIGINT) AS not_above, CAST(sum(CASE WHEN x > 2 OR x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS above_or_null, CAST(sum(CASE WHEN x > 2 AND NULL THEN 1 ELSE 0 END) AS BIGINT) AS never FROM t",
    "filter_is_null": "SELECT o_id FROM oltp_orders WHERE o_total IS NULL AND o_status IS NOT NULL",
    "filter_equals_null": "SELECT c_custkey FROM customer WHERE c_name = NULL",
    "in_list": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 13) AND p_brand NOT IN ('Brand#1', 'Brand#2')",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "not_in_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(c_nationkey, 3) FROM customer)",
    "between_not_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 2 AND 49",
    "like_escape": "SELECT 'a_b' LIKE 'a!_b' ESCAPE '!' AS yes, 'axb' LIKE 'a!_b' ESCAPE '!' AS no, '50% off' LIKE '%!%%' ESCAPE '!' AS pct, 'abc' NOT LIKE 'A%' AS cased",
    "like_filter": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' AND p_name NOT LIKE '%widget'",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "case_subquery": "SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN 'rich' ELSE 'other' END AS kind FROM nation",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "any_greater": "SELECT s_suppkey FROM supplier WHERE s_acctbal > ANY (SELECT c_acctbal FROM customer WHERE c_nationkey = 3)",
    "all_greater": "SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal < 5000)",
    "all_empty": "SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_nationkey = 999)",
    "all_with_null": "SELECT s_suppkey FROM supplier WHERE s_suppkey <> ALL (SELECT nullif(n_nationkey, 5) FROM nation)",
    "any_equal_correlated": "SELECT n_nationkey FROM nation n WHERE n_nationkey = ANY (SELECT s_nationkey FROM supplier s WHERE s.s_suppkey > n.n_nationkey)",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) > 250000 AS far FROM orders WHERE o_totalprice > (SELECT 0.9 * max(o_totalprice) FROM orders)",
    "correlated_scalar": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "correlated_count": "SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
    "derived_table": "SELECT q.n_regionkey, max(q.c) AS most FROM (SELECT n_regionkey, c_nationkey, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, c_nationkey) AS q GROUP BY q.n_regionkey",
    "qualify": "SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3",
    # joins
    "join_inner": "SELECT c_name, o_orderkey FROM customer INNER JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000",
    "join_multi_way": "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name",
    "join_left": "SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT OUTER JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_nationkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 350000",
    "join_full": "SELECT p.c_custkey AS p_key, r.c_custkey AS r_key FROM (SELECT DISTINCT c_custkey FROM customer_primary) p FULL OUTER JOIN (SELECT DISTINCT c_custkey FROM customer_replica) r ON p.c_custkey = r.c_custkey WHERE p.c_custkey IS NULL OR r.c_custkey IS NULL",
    "join_cross": "SELECT r_name, s.o_orderstatus FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 10",
    "join_natural": "SELECT * FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY c_nationkey) a NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) b",
    "join_natural_left": "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL LEFT JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier WHERE s_acctbal < 0) b",
    "join_using": "SELECT * FROM (SELECT o_custkey AS id, o_orderstatus AS st, count(*) AS orders FROM orders GROUP BY o_custkey, o_orderstatus) a JOIN (SELECT c_custkey AS id, 'F' AS st, c_name FROM customer) b USING (id, st)",
    "join_theta": "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey * 3",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_null_keys": "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 1) AS k FROM customer) a JOIN (SELECT nullif(s_nationkey, 1) AS k FROM supplier) b ON a.k = b.k",
    "semi_residual": "SELECT count(*) AS n FROM lineitem l1 WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)",
    "anti_residual": "SELECT l_orderkey, l_linenumber FROM lineitem l1 WHERE NOT EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_linenumber <> l1.l_linenumber)",
    "lateral": "SELECT n_nationkey, x.top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey) x",
    # aggregation
    "agg_basic": "SELECT l_returnflag, count(*) AS n, count(l_tax) AS n_tax, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag",
    "agg_global": "SELECT count(*) AS n, sum(s_acctbal) IS NULL AS none, max(s_suppkey) AS m FROM supplier WHERE s_suppkey < 0",
    "agg_sum_int": "SELECT c_nationkey, CAST(sum(c_custkey) AS BIGINT) AS s, avg(c_custkey) AS a FROM customer GROUP BY c_nationkey",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_filter_case": "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(*) FILTER (WHERE o_orderstatus LIKE 'O%') AS open FROM orders GROUP BY o_orderpriority",
    "agg_expression": "SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(floor(o_totalprice / 100000) AS BIGINT) AS band, count(*) AS n FROM orders GROUP BY extract(YEAR FROM o_orderdate), floor(o_totalprice / 100000)",
    "agg_by_alias": "SELECT upper(o_orderstatus) AS st, count(*) AS n FROM orders GROUP BY st",
    "having": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 10 AND avg(c_acctbal) > 4000",
    "having_scalar_subquery": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT 2 * avg(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey) q)",
    "agg_stddev_var": "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs FROM lineitem GROUP BY l_returnflag",
    "agg_median": "SELECT c_nationkey, round(median(c_acctbal), 6) AS m FROM customer GROUP BY c_nationkey",
    "agg_percentile_cont": "SELECT c_nationkey, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c_acctbal), 6) AS q1, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal DESC), 6) AS d9 FROM customer GROUP BY c_nationkey",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    # windows
    "win_rank_family": "SELECT s_suppkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM (SELECT s_suppkey, floor(s_acctbal / 1000) AS k, s_nationkey FROM supplier) s WINDOW w AS (PARTITION BY s_nationkey ORDER BY k, s_suppkey)",
    "win_rank_ties": "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS dr FROM lineitem",
    "win_percent_cume": "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 8) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 8) AS cd FROM supplier",
    "win_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer",
    "win_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before1, lag(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before2, lead(o_orderstatus, 1, 'none') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after1 FROM orders",
    "win_first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_ignore_nulls": "SELECT o_id, last_value(o_total IGNORE NULLS) OVER (PARTITION BY o_customer_id ORDER BY o_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM (SELECT DISTINCT o_id, o_customer_id, o_total FROM oltp_orders) t",
    "win_aggregates": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey) AS BIGINT) AS s, avg(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey) AS a FROM orders",
    "win_running_range": "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS BIGINT) AS s FROM orders",
    "win_rows_frame": "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ahead FROM orders",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part",
    "topk_per_group": "SELECT * FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer) t WHERE rn <= 2",
    # sort and limit
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "order_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "order_nulls": "SELECT o_id, o_total FROM (SELECT DISTINCT o_id, o_total FROM oltp_orders) t ORDER BY o_total ASC NULLS FIRST, o_id",
    "order_nulls_last": "SELECT o_id, o_total FROM (SELECT DISTINCT o_id, o_total FROM oltp_orders) t ORDER BY o_total DESC NULLS LAST, o_id",
    # set operations, CTEs, values
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation",
    "set_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "set_intersect_all": "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "set_nulls_equal": "SELECT nullif(n_regionkey, 0) AS k FROM nation INTERSECT SELECT nullif(r_regionkey, 0) FROM region",
    "set_coercion": "SELECT n_nationkey AS v FROM nation UNION SELECT s_acctbal FROM supplier",
    "set_order_limit": "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) u ORDER BY k DESC LIMIT 7",
    "set_branch_limits": "(SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 3) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3)",
    "cte_multi": "WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY c_nationkey), b(k, suppliers) AS (SELECT s_nationkey, count(*) FROM supplier GROUP BY s_nationkey) SELECT a.k, customers, suppliers FROM a JOIN b ON a.k = b.k WHERE customers > (SELECT avg(customers) FROM a)",
    "cte_materialized": "WITH a AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS NOT MATERIALIZED (SELECT max(n) AS m FROM a) SELECT a.o_custkey, a.n FROM a, b WHERE a.n = b.m",
    "cte_recursive": "WITH RECURSIVE walk(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM walk WHERE n < 15) SELECT n, f FROM walk",
    "values_relation": "SELECT v.a, v.b, n_name FROM (VALUES (1, 'x'), (2, 'y'), (30, 'z')) AS v(a, b) LEFT JOIN nation ON n_nationkey = v.a",
    "theta_integer_division": "SELECT v.a, w.b FROM (VALUES (1), (2)) v(a) JOIN (VALUES (10), (20)) w(b) ON v.a = CAST(floor(w.b / 10) AS INT)",
    "view_query": "SELECT n_name, n FROM (SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name) v WHERE n > 50",
}

# name: (ours, theirs)
PAIRS = {
    "distinctrow": ("SELECT DISTINCTROW l_returnflag FROM lineitem", "SELECT DISTINCT l_returnflag FROM lineitem"),
    "regexp": ("SELECT p_partkey FROM part WHERE p_name REGEXP '^(red|blue) .*t$' OR p_name RLIKE 'gear'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$') OR regexp_matches(p_name, 'gear')"),
    "glob": ("SELECT p_partkey FROM part WHERE p_name GLOB 'r?d *'", "SELECT p_partkey FROM part WHERE p_name GLOB 'r?d *'"),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20"),
    "group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR ';') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "with_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "with_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH CUBE", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "rollup_mixed": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, ROLLUP (l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "any_value_group": ("SELECT c_nationkey, any_value(c_nationkey * 2) AS same, max(c_custkey) AS m FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, any_value(c_nationkey * 2) AS same, max(c_custkey) AS m FROM customer GROUP BY c_nationkey"),
    "json_group": ("SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey"),
    "quantile_array": ("SELECT c_nationkey, transform(percentile(c_acctbal, array(0.25, 0.5, 0.75)), x -> round(x, 6)) AS q FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, list_transform(quantile_cont(c_acctbal, [0.25, 0.5, 0.75]), lambda x: round(x, 6)) AS q FROM customer GROUP BY c_nationkey"),
    "iif_division": ("SELECT o_orderkey, IIF(o_totalprice > 200000, 'a', 'b') AS k, o_orderkey DIV 7 AS d, o_orderkey % 7 AS m FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'a' ELSE 'b' END AS k, o_orderkey // 7 AS d, o_orderkey % 7 AS m FROM orders"),
    "table_hints": ("SELECT /*+ BROADCAST(n) */ s_suppkey, n_name FROM supplier s USE INDEX (ix) JOIN nation n ON s_nationkey = n_nationkey FOR UPDATE SKIP LOCKED", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "generate_series": ("SELECT id AS value FROM range(3, 31, 4)", "SELECT CAST(unnest(generate_series(3, 30, 4)) AS BIGINT) AS value"),
    "unnest": ("SELECT s_suppkey, x FROM supplier LATERAL VIEW explode(array(s_nationkey, s_nationkey + 1)) t AS x", "SELECT s_suppkey, unnest([s_nationkey, s_nationkey + 1]) AS x FROM supplier"),
}


def right_semi(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").where("o_totalprice > 300000"), table(spark, d, "customer")
    return R.right_semi(o, c, o["o_custkey"] == c["c_custkey"]).select("c_custkey")


def right_anti(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").where("o_totalprice > 300000"), table(spark, d, "customer")
    return R.right_anti(o, c, o["o_custkey"] == c["c_custkey"]).select("c_custkey")


def null_aware_anti(spark: SparkSession, d: str) -> DataFrame:
    busy = table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey")
    return R.null_aware_anti(table(spark, d, "customer"), busy, "c_custkey", "o_custkey").select("c_custkey")


def broadcast_checked(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(R.broadcast_if_small(n), c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def range_join(spark: SparkSession, d: str) -> DataFrame:
    bands = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 25.0).alias("hi"))
    return R.range_join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal", "lo", "hi", 25.0).select("c_custkey", "s_suppkey")


def asof_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    buys = e.where("event_type = 'purchase'")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return R.asof_join(buys, clicks, ["user_id"], "ts", "ts", ["click_id"]).select("event_id", "click_id")


def salted_join(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "order_items").select(F.col("oi_product_id").alias("pr_id"), "oi_quantity")
    prices = table(spark, d, "products").select("pr_id", "pr_category").distinct()
    return R.salted_join(items, prices, ["pr_id"]).groupBy("pr_category").agg(F.sum("oi_quantity").alias("quantity"))


def quantile_disc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(R.quantile_disc_floor(F.col("c_acctbal"), 0.95).alias("q"))


def group_concat_function(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(R.group_concat(F.col("n_name"), "|", F.col("n_nationkey")).alias("names"))


def pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))


def win_groups_frame(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return R.over_groups(F.count, "p_partkey", ["p_brand"], "p_size", 1, 1)(p, "near").select("p_partkey", "near")


def win_exclude_current(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(-2, 2)
    return table(spark, d, "customer").select("c_custkey", F.round(R.sum_excluding_current("c_acctbal", w), 2).alias("others"))


def topk_per_group_api(spark: SparkSession, d: str) -> DataFrame:
    return R.top_per_group(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


def set_nocase(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "oltp_orders").where("o_status IS NOT NULL").select(F.trim("o_status").alias("s"))
    b = spark.createDataFrame([("SHIPPED",), ("Lost",)], "s string")
    return R.set_operation("intersect", a, b, nocase=["s"]).select(F.lower("s").alias("s"))


def set_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    b = table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    return R.set_operation("union_all", a, b, by_name=True)


def cte_recursive_distinct(spark: SparkSession, d: str) -> DataFrame:
    # nations reached from 1 by k -> (2k mod 25) or (k + 7 mod 25)
    start = spark.createDataFrame([(1,)], "k int")
    return R.recursive_distinct(start, lambda new: new.select(F.explode(F.array((F.col("k") * 2) % 24, (F.col("k") + 8) % 24)).alias("k")))


API = {
    "join_right_semi": (right_semi, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "join_right_anti": (right_anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "not_in_nullaware": (null_aware_anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "join_broadcast_checked": (broadcast_checked, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "join_range_bucketed": (range_join, "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal AND s_acctbal + 25.0"),
    "join_asof": (asof_join, "WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) SELECT b.event_id, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN c ON b.user_id = c.user_id AND b.ts >= c.ts"),
    "join_salted": (salted_join, "SELECT pr_category, CAST(sum(oi_quantity) AS BIGINT) AS quantity FROM order_items JOIN (SELECT DISTINCT pr_id, pr_category FROM products) p ON oi_product_id = pr_id GROUP BY pr_category"),
    "agg_quantile_disc": (quantile_disc, "SELECT c_nationkey, list_sort(list(c_acctbal))[1 + CAST(floor(0.95 * (count(*) - 1)) AS INT)] AS q FROM customer GROUP BY c_nationkey"),
    "agg_group_concat_api": (group_concat_function, "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"),
    "pivot": (pivot, 'SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = \'F\'), 0) AS "F", nullif(count(*) FILTER (WHERE l_linestatus = \'O\'), 0) AS "O" FROM lineitem GROUP BY l_returnflag'),
    "win_groups_frame": (win_groups_frame, "SELECT p_partkey, count(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM part"),
    "win_exclude_current": (win_exclude_current, "SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 2) AS others FROM customer"),
    "topk_per_group_api": (topk_per_group_api, "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3"),
    "set_nocase": (set_nocase, "SELECT DISTINCT lower(trim(o_status)) AS s FROM oltp_orders WHERE lower(trim(o_status)) IN ('shipped', 'lost')"),
    "set_by_name": (set_by_name, "SELECT n_nationkey, n_name AS name, NULL::INT AS r_regionkey FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region"),
    "cte_recursive_distinct": (cte_recursive_distinct, "WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT x FROM (SELECT unnest([(k * 2) % 24, (k + 8) % 24]) AS x FROM r) q) SELECT k FROM r"),
}

QUERIES = {k: sql_query(s) for k, s in SAME.items()} | {k: sql_query(s) for k, (s, _) in PAIRS.items()} | {k: f for k, (f, _) in API.items()}
ORACLES = dict(SAME) | {k: s for k, (_, s) in PAIRS.items()} | {k: s for k, (_, s) in API.items()}
