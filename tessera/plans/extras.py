"""Session, catalog, schema and random features; those without a fixed result have no SQL."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.operators import dml
from tessera.operators import schema as SC
from tessera.operators import vector as V
from tessera.plans.changes import scratch
from tessera.plans.retrieval import _DIST, _VQ
from tessera.session import table
from tessera.sources import catalog, corpus


def compress(s: Column) -> Column:
    """zlib; NULL stays NULL."""

    def run(v):
        return v.map(lambda x: None if x is None else zlib.compress(x.encode()))

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return pandas_udf(run, "binary")(s)


def uncompress(b: Column) -> Column:
    def run(v):
        return v.map(lambda x: None if x is None else zlib.decompress(x).decode())

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return pandas_udf(run, "string")(b)


def fn_compress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", uncompress(compress(F.col("p_name"))).alias("p_name"))


def order_by_rand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey").orderBy(F.rand()).limit(5)


def fn_now(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT current_timestamp() AS now, current_date() AS today, date_format(now(), 'HH:mm:ss') AS clock, rand() AS r, current_user() AS who, current_database() AS db, version() AS v")


def session_variable(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    spark.sql("DECLARE OR REPLACE VARIABLE least INT DEFAULT 3")
    spark.sql("SET VAR least = 45")
    return spark.sql("SELECT count(*) AS n FROM part WHERE p_size > least")


def execute_immediate(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT count(*) AS n FROM part WHERE p_size > ?' USING 45")


def show_tables(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return catalog.tables(spark).where("table_name = 'part'").select("table_name", "table_type")


def explain_plan(spark: SparkSession, d: str) -> DataFrame:
    text = catalog.explain(table(spark, d, "part").where("p_size > 3").groupBy("p_brand").count())
    return spark.createDataFrame([("PushedFilters" in text and "HashAggregate" in text,)], "shown boolean")


def ddl_alter(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    s = SC.add_column(s, "s_note", "string", F.lit("none"))
    s = SC.rename_column(s, "s_name", "name")
    s = SC.modify_column(s, "s_acctbal", "decimal(12,2)")
    return SC.modify_column(SC.drop_column(s, "s_nationkey"), "s_acctbal", "double")


def ddl_truncate(spark: SparkSession, d: str) -> DataFrame:
    return SC.truncate(table(spark, d, "region"))


def dml_returning(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    new = r.select((F.col("r_regionkey") + 100).alias("r_regionkey"), F.lower("r_name").alias("r_name"))
    _, returned = SC.returning(dml.insert(r, new), new, ["r_regionkey", F.upper("r_name").alias("loud")])
    return returned


def sequence_values(spark: SparkSession, d: str) -> DataFrame:
    return SC.number_rows(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", start=1000, step=10)


def generated_column(spark: SparkSession, d: str) -> DataFrame:
    return SC.add_column(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "unit", "double", F.col("l_extendedprice") / F.col("l_quantity")).select("l_orderkey", "l_linenumber", "unit")


def vec_sharded(spark: SparkSession, d: str) -> DataFrame:
    q = [float(x) for x in table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]]
    return V.nearest_sharded(table(spark, d, "embeddings"), q, 10, 8).select("vec_id", F.round("score", 5).alias("score"))


def corpus_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Part names written as small files and taken in again, each file a document with its content hash."""
    path = scratch(spark)
    table(spark, d, "nation").select("n_name").repartition(3).write.text(path)
    return corpus.ingest(spark, path).select(F.length("text").alias("signs"), (F.sha2("text", 256) == F.col("source_hash")).alias("sound"))


DEFS = {
    "fn_compress": (fn_compress, "SELECT p_partkey, p_name FROM part"),
    "order_by_rand": (order_by_rand, None),
    "fn_now": (fn_now, None),
    "session_variable": (session_variable, "SELECT count(*) AS n FROM part WHERE p_size > 45"),
    "execute_immediate": (execute_immediate, "SELECT count(*) AS n FROM part WHERE p_size > 45"),
    "show_tables": (show_tables, "SELECT 'part' AS table_name, 'VIEW' AS table_type"),
    "explain_plan": (explain_plan, "SELECT true AS shown"),
    "ddl_alter": (ddl_alter, "SELECT s_suppkey, s_name AS name, round(s_acctbal, 2) AS s_acctbal, 'none' AS s_note FROM supplier"),
    "ddl_truncate": (ddl_truncate, "SELECT r_regionkey, r_name FROM region WHERE false"),
    "dml_returning": (dml_returning, "SELECT r_regionkey + 100 AS r_regionkey, upper(r_name) AS loud FROM region"),
    "sequence_values": (sequence_values, "SELECT s_suppkey, 1000 + 10 * (row_number() OVER (ORDER BY s_suppkey) - 1) AS nextval FROM supplier"),
    "generated_column": (generated_column, "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem"),
    "vec_sharded": (vec_sharded, f"WITH {_VQ} SELECT vec_id, round(s, 5) AS score FROM (SELECT vec_id, {_DIST['cosine']} AS s FROM embeddings, q) ORDER BY s DESC, vec_id LIMIT 10"),
    "corpus_ingest": (corpus_ingest, None),
}

QUERIES = {k: f for k, (f, _) in DEFS.items()}
ORACLES = {k: s for k, (_, s) in DEFS.items() if s}
