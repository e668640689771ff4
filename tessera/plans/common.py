"""How queries over the driver tables are put together."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.dialect import run as run_sql
from tessera.session import register_tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings products customers oltp_orders order_items key_deletions customer_primary customer_replica nation_primary nation_replica supplier_list metrics".split()

Query = Callable[[SparkSession, str], DataFrame]


def tables_in(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", sql.lower())))
    return [t for t in TABLES if t in words]


def sql_query(sql: str) -> Query:
    """A query from SQL text in the dialect of plans.dialect; only the tables it names are registered."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        register_tables(spark, d, tables_in(sql))
        return run_sql(spark, sql)

    run.__doc__ = sql
    return run
