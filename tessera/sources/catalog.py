"""What is in the session: tables, columns, plans; table functions."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables: table_schema, table_name, table_type."""
    rows = [(t.database or "", t.name, "VIEW" if t.isTemporary else (t.tableType or "")) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def columns(spark: SparkSession, table: str) -> DataFrame:
    """information_schema.columns: column_name, ordinal_position, data_type, is_nullable."""
    rows = [(f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for i, f in enumerate(spark.table(table).schema, 1)]
    return spark.createDataFrame(rows, "column_name string, ordinal_position int, data_type string, is_nullable string")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """EXPLAIN [QUERY PLAN] as text."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain(mode)
    return out.getvalue()


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """From start to stop, both included."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("value"))


def unnest(df: DataFrame, array: str, name: str = "value") -> DataFrame:
    return df.select("*", F.explode(array).alias(name))


def materialize_view(df: DataFrame, name: str) -> None:
    """A materialized view: its rows are stored when it is made."""
    df.write.mode("overwrite").saveAsTable(name)
