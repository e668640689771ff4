"""Data changes, functions of one's own, prepared statements, sources and streams, each beside SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dml
from tessera.session import shared_folder, table
from tessera.sources import catalog, files
from tessera.streaming import events as ev


def scratch(spark: SparkSession) -> str:
    """A new folder for files, in the shared folder the cluster names, else in the local temporary one."""
    return f"{shared_folder(spark, 'tessera-scratch')}/files-{uuid.uuid4().hex}"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def _news(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth supplier with a new balance, and as many new suppliers."""
    s = _suppliers(spark, d)
    changed = s.where("s_suppkey % 10 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    return changed.unionByName(s.where("s_suppkey % 10 = 1").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000))


_NEWS = "news AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 10 = 1)"
_T = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM"


def dml_insert(spark, d):
    return dml.insert(_suppliers(spark, d), _news(spark, d).where("s_suppkey > 1000000").select("s_suppkey", "s_name"))


def dml_upsert(spark, d):
    return dml.upsert(_suppliers(spark, d), _news(spark, d), ["s_suppkey"])


def dml_upsert_expression(spark, d):
    return dml.upsert(_suppliers(spark, d), _news(spark, d), ["s_suppkey"], {"s_acctbal": F.col("t.s_acctbal") + F.col("s.s_acctbal")})


def dml_replace(spark, d):
    return dml.replace_into(_suppliers(spark, d), _news(spark, d), ["s_suppkey"])


def dml_insert_ignore(spark, d):
    return dml.insert_ignore(_suppliers(spark, d), _news(spark, d), ["s_suppkey"])


def dml_update(spark, d):
    return dml.update(_suppliers(spark, d), {"s_acctbal": F.col("s_acctbal") * 2, "s_name": F.upper("s_name")}, F.col("s_nationkey") < 10)


def dml_update_limit(spark, d):
    return dml.update(_suppliers(spark, d), {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0, order=[F.col("s_acctbal"), F.col("s_suppkey")], limit=3)


def dml_update_join(spark, d):
    return dml.update_from(_suppliers(spark, d), _news(spark, d), ["s_suppkey"], {"s_acctbal": F.col("s.s_acctbal")})


def dml_delete(spark, d):
    return dml.delete(_suppliers(spark, d), F.nullif(F.col("s_nationkey"), F.lit(3)) < 10)


def dml_delete_using(spark, d):
    return dml.delete_using(_suppliers(spark, d), _news(spark, d), ["s_suppkey"])


def dml_merge(spark, d):
    return dml.merge(_suppliers(spark, d), _news(spark, d), ["s_suppkey"], {"s_acctbal": F.col("s.s_acctbal")}, update_if=F.col("s.s_acctbal") > 5000, delete_if=F.col("s.s_acctbal") < 0, insert={c: F.col(f"s.{c}") for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")})


def dml_ctas(spark, d):
    path = scratch(spark)
    files.write_parquet(_suppliers(spark, d).where("s_acctbal > 0"), path)
    files.bulk_insert(_suppliers(spark, d).where("s_acctbal <= 0"), path)
    return files.read_parquet(spark, path, ["s_suppkey", "s_acctbal"])


def dml_constraints(spark, d):
    items = table(spark, d, "oltp_orders")
    return dml.violations(items, not_null=["o_customer_id"], unique=[["o_id"]], checks={"total": F.col("o_total") >= 0}, foreign={"o_customer_id": (table(spark, d, "customers"), "c_id")})


def sql_udf(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION band(x DOUBLE) RETURNS STRING RETURN CASE WHEN x < 0 THEN 'debt' WHEN x < 5000 THEN 'some' ELSE upper('much') END")
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT band(c_acctbal) AS band, count(*) AS n FROM customer GROUP BY band(c_acctbal)")


def sql_udtf(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION of_nation(k INT) RETURNS TABLE (custkey BIGINT, balance DOUBLE) RETURN SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = k")
    return spark.sql("SELECT custkey, balance FROM of_nation(7)")


def prepared_params(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = :st AND o_totalprice > :least", args={"st": "F", "least": 200000.0})


def sql_script(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql("BEGIN DECLARE least DOUBLE DEFAULT 100000.0; IF least < 200000.0 THEN SET least = 250000.0; END IF; SELECT count(*) AS n FROM orders WHERE o_totalprice > least; END")


def grouped_pandas_udf(spark, d):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def spread(v):
        return float(v.max() - v.min())

    spread.__annotations__ = {"v": pd.Series, "return": float}  # a grouped aggregate
    spread = pandas_udf(spread, "double")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 4).alias("spread"))


def src_csv_tbl(spark, d):
    path = scratch(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.nullif(F.col("n_regionkey"), F.lit(0)).alias("n_regionkey"))
    n.select(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.coalesce(F.col("n_regionkey").cast("string"), F.lit("")), F.lit("")).alias("line")).write.text(path)
    return files.read_tbl(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def src_tbl_inferred(spark, d):
    path = scratch(spark)
    c = table(spark, d, "customer")
    c.select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"), F.lit("")).alias("line")).write.text(path)
    return files.infer_tbl(spark, path, ["c_custkey", "c_name", "c_acctbal"])


def src_outfile_load(spark, d):
    path = scratch(spark)
    s = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "x"')).alias("s_name"), F.nullif(F.col("s_nationkey"), F.lit(1)).alias("s_nationkey"))
    files.into_outfile(s, path, fields_terminated=",", enclosed='"', header=True)
    return files.load_data(spark, path, "s_suppkey bigint, s_name string, s_nationkey int", fields_terminated=",", enclosed='"', ignore_lines=1)


def src_parquet_roundtrip(spark, d):
    path = scratch(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"), (F.col("o_orderkey") % 3).alias("part"))
    files.write_parquet(o, path, partition_by=["part"])
    return files.read_parquet(spark, path).select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def src_parquet_pruned(spark, d):
    """One partition of the same; the others' files are not read."""
    path = scratch(spark)
    files.write_parquet(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("part")), path, partition_by=["part"])
    return files.read_parquet(spark, path).where("part = 1").select("o_orderkey")


def src_bucketed(spark, d):
    """Two tables bucketed by their join key, joined without a shuffle, and a range of the key read from one."""
    a, b = f"orders_{uuid.uuid4().hex}", f"lines_{uuid.uuid4().hex}"
    files.write_bucketed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), a, ["o_orderkey"], 8, f"{scratch(spark)}/{a}")
    files.write_bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), b, ["l_orderkey"], 8, f"{scratch(spark)}/{b}")
    o, l = spark.table(a), spark.table(b)
    return o.where("o_orderkey BETWEEN 100 AND 5000").join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy("o_orderpriority").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


def dml_delete_limit(spark, d):
    return dml.delete(_suppliers(spark, d), F.col("s_acctbal") > 0, order=[F.desc("s_acctbal"), F.col("s_suppkey")], limit=5)


def dml_update_repeated(spark, d):
    """One of several equal rows changes, not all of them."""
    twice = _suppliers(spark, d).select("s_nationkey").where("s_nationkey < 5")
    return dml.update(twice, {"s_nationkey": F.lit(99)}, F.col("s_nationkey") == 3, order=[F.col("s_nationkey")], limit=1)


def dml_merge_last(spark, d):
    """Several source rows for a key: the first in a stated order counts."""
    news = _news(spark, d)
    several = news.unionByName(news.withColumn("s_acctbal", F.col("s_acctbal") - 500)).withColumn("n", F.col("s_acctbal"))
    return dml.upsert(_suppliers(spark, d), dml.last_per_key(several, ["s_suppkey"], [F.col("n")]).drop("n"), ["s_suppkey"])


def dml_insert_defaults(spark, d):
    """INSERT ... DEFAULT VALUES, and rows that name some columns only."""
    defaults = {"s_name": F.lit("none"), "s_acctbal": F.lit(0.0)}
    s = dml.insert(_suppliers(spark, d), spark.range(2).select((F.col("id") + 2_000_000).alias("s_suppkey")), defaults)
    return dml.insert(s, spark.range(1).select(), defaults)


def src_row_count(spark, d):
    return spark.createDataFrame([(files.parquet_row_count(spark, f"{d}/lineitem.parquet"),)], "n bigint")


def src_catalog_columns(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return catalog.columns(spark, "nation").select("column_name", "data_type")


def src_view(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")
    return spark.sql("SELECT count(*) AS n, round(max(c_acctbal), 2) AS top FROM rich")


def stream_tumbling(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ev.windowed(e, "ts", "1 day", None, ["event_type"], "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sessions(e, "ts", "30 minutes", ["user_id"]).select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), "user_id", "n")


def stream_run_to_end(spark, d):
    """The same day counts by a stream over files, collected from its micro-batches."""
    src, out, ck = scratch(spark), scratch(spark), scratch(spark)
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    e.repartition(4).write.parquet(src)
    per = ev.windowed(ev.event_stream(spark, src, e.schema, 2), "ts", "1 day", None, ["event_type"], "value", late="40 days")
    ev.run_to_end(per, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}"), ck, mode="complete")
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch", "left_semi").groupBy("event_type").agg(F.sum("n").alias("n"))  # one row


DEFS = {
    "dml_insert": (dml_insert, f"{_T} supplier UNION ALL SELECT s_suppkey + 1000000, s_name, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 1"),
    "dml_upsert": (dml_upsert, f"WITH {_NEWS} {_T} supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM news) UNION ALL {_T} news"),
    "dml_upsert_expression": (dml_upsert_expression, f"WITH {_NEWS} SELECT s.s_suppkey, s.s_name, s.s_nationkey, s.s_acctbal + coalesce(n.s_acctbal, 0) AS s_acctbal FROM supplier s LEFT JOIN news n USING (s_suppkey) UNION ALL {_T} news WHERE s_suppkey > 1000000"),
    "dml_replace": (dml_replace, f"WITH {_NEWS} {_T} supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM news) UNION ALL {_T} news"),
    "dml_insert_ignore": (dml_insert_ignore, f"WITH {_NEWS} {_T} supplier UNION ALL {_T} news WHERE s_suppkey > 1000000"),
    "dml_update": (dml_update, "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "dml_update_limit": (dml_update_limit, "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 ORDER BY s_acctbal, s_suppkey LIMIT 3) THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "dml_update_join": (dml_update_join, f"WITH {_NEWS} SELECT s.s_suppkey, s.s_name, s.s_nationkey, coalesce(n.s_acctbal, s.s_acctbal) AS s_acctbal FROM supplier s LEFT JOIN news n USING (s_suppkey)"),
    "dml_delete": (dml_delete, f"{_T} supplier WHERE s_nationkey >= 10 OR s_nationkey = 3"),
    "dml_delete_using": (dml_delete_using, f"{_T} supplier WHERE s_suppkey % 10 <> 0"),
    "dml_merge": (dml_merge, f"WITH {_NEWS} SELECT s.s_suppkey, s.s_name, s.s_nationkey, CASE WHEN n.s_acctbal > 5000 THEN n.s_acctbal ELSE s.s_acctbal END AS s_acctbal FROM supplier s LEFT JOIN news n USING (s_suppkey) WHERE n.s_acctbal IS NULL OR n.s_acctbal >= 0 UNION ALL {_T} news WHERE s_suppkey > 1000000"),
    "dml_ctas": (dml_ctas, "SELECT s_suppkey, s_acctbal FROM supplier"),
    "dml_constraints": (dml_constraints, """SELECT * FROM (SELECT 'not null o_customer_id' AS "constraint", count(*) AS "rows" FROM oltp_orders WHERE o_customer_id IS NULL UNION ALL SELECT 'unique o_id', CAST(sum(c) AS BIGINT) FROM (SELECT count(*) AS c FROM oltp_orders GROUP BY o_id HAVING count(*) > 1) UNION ALL SELECT 'check total', count(*) FROM oltp_orders WHERE o_total < 0 UNION ALL SELECT 'foreign key o_customer_id', count(*) FROM oltp_orders WHERE o_customer_id IS NOT NULL AND o_customer_id NOT IN (SELECT c_id FROM customers)) q WHERE "rows" > 0"""),
    "sql_udf": (sql_udf, "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'MUCH' END AS band, count(*) AS n FROM customer GROUP BY 1"),
    "sql_udtf": (sql_udtf, "SELECT c_custkey AS custkey, c_acctbal AS balance FROM customer WHERE c_nationkey = 7"),
    "prepared_params": (prepared_params, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000"),
    "sql_script": (sql_script, "SELECT count(*) AS n FROM orders WHERE o_totalprice > 250000"),
    "udaf_pandas": (grouped_pandas_udf, "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY c_nationkey"),
    "src_csv_tbl": (src_csv_tbl, "SELECT n_nationkey, n_name, nullif(n_regionkey, 0) AS n_regionkey FROM nation"),
    "src_tbl_inferred": (src_tbl_inferred, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "src_outfile_load": (src_outfile_load, "SELECT s_suppkey, s_name || ', \"x\"' AS s_name, nullif(s_nationkey, 1) AS s_nationkey FROM supplier"),
    "src_parquet_roundtrip": (src_parquet_roundtrip, "SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM orders"),
    "src_parquet_pruned": (src_parquet_pruned, "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1"),
    "src_bucketed": (src_bucketed, "SELECT o_orderpriority, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey BETWEEN 100 AND 5000 GROUP BY o_orderpriority"),
    "dml_delete_limit": (dml_delete_limit, f"{_T} supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 5)"),
    "dml_update_repeated": (dml_update_repeated, "SELECT CASE WHEN s_nationkey = 3 AND row_number() OVER (PARTITION BY s_nationkey) = 1 THEN 99 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_nationkey < 5"),
    "dml_merge_last": (dml_merge_last, f"WITH {_NEWS}, last AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal - 500 AS s_acctbal FROM news) {_T} supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM news) UNION ALL {_T} last"),
    "dml_insert_defaults": (dml_insert_defaults, f"{_T} supplier UNION ALL SELECT * FROM (VALUES (2000000, 'none', NULL, 0.0), (2000001, 'none', NULL, 0.0), (NULL, 'none', NULL, 0.0)) v"),
    "src_row_count": (src_row_count, "SELECT count(*) AS n FROM lineitem"),
    "src_catalog_columns": (src_catalog_columns, "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) v(column_name, data_type)"),
    "src_view": (src_view, "SELECT count(*) AS n, round(max(c_acctbal), 2) AS top FROM customer WHERE c_acctbal > 9000"),
    "ext_stream_tumbling": (stream_tumbling, "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "ext_stream_sessions": (stream_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k"),
    "ext_stream_run_to_end": (stream_run_to_end, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
}

QUERIES = {k: f for k, (f, _) in DEFS.items()}
ORACLES = {k: s for k, (_, s) in DEFS.items()}
