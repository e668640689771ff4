"""The 22 TPC-H queries over the driver's schema.

The driver has no partsupp, commit or receipt dates, ship modes, containers or phones; the parts of the queries that
need them use the nearest column there is. One SQL text serves both engines.
"""

from __future__ import annotations

from tessera.plans.common import sql_query

_REVENUE = "l_extendedprice * (1 - l_discount)"

SQL = {
    "tpch_q1": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '2001-08-01' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q2": """WITH ps AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, supplier, ps, nation, region
WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 3
  AND cost = (SELECT min(p2.cost) FROM ps p2, supplier s2, nation n2, region r2 WHERE p_partkey = p2.l_partkey AND s2.s_suppkey = p2.l_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_regionkey = 3)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q3": f"""SELECT l_orderkey, round(sum({_REVENUE}), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
    "tpch_q5": f"""SELECT n_name, round(sum({_REVENUE}), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_regionkey = 2 AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name""",
    "tpch_q6": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, {_REVENUE} AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))) shipping
GROUP BY supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {_REVENUE} AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
    AND r_regionkey = 1 AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') all_nations GROUP BY o_year""",
    "tpch_q9": f"""SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {_REVENUE} - p_retailprice * l_quantity * 0.1 AS amount
  FROM part, supplier, lineitem, orders, nation
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%') profit GROUP BY nation, o_year""",
    "tpch_q10": f"""SELECT c_custkey, c_name, round(sum({_REVENUE}), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": """WITH v AS (SELECT l_partkey, sum(l_extendedprice) AS value FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY l_partkey)
SELECT l_partkey, round(value, 2) AS value FROM v WHERE value > (SELECT 2 * avg(value) FROM v)""",
    "tpch_q12": """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus""",
    "tpch_q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders GROUP BY c_count""",
    "tpch_q14": f"""SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REVENUE} ELSE 0 END) / sum({_REVENUE}), 6) AS promo_revenue FROM lineitem, part
WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "tpch_q15": f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_REVENUE}), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "tpch_q16": """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "tpch_q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 180) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""SELECT round(sum({_REVENUE}), 2) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND (
  (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25)
  OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 35))""",
    "tpch_q20": """SELECT s_name, s_acctbal FROM supplier, nation WHERE s_suppkey IN (
  SELECT l_suppkey FROM lineitem l1 WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
    AND l_quantity > (SELECT 0.9 * max(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = l1.l_partkey AND l2.l_suppkey = l1.l_suppkey AND l2.l_shipdate >= DATE '1996-01-01'))
  AND s_nationkey = n_nationkey AND n_regionkey = 2""",
    "tpch_q21": """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_nationkey IN (3, 7, 11, 13, 17, 18, 23) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0 AND c_nationkey IN (3, 7, 11, 13, 17, 18, 23))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey""",
}

QUERIES = {k: sql_query(s) for k, s in SQL.items()}
ORACLES = dict(SQL)
