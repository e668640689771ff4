"""Schema changes and row numbers as transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def add_column(df: DataFrame, name: str, kind: str, value: Column | None = None) -> DataFrame:
    """ALTER TABLE ADD, with a default or a generated value; NULL without one."""
    if name in df.columns:
        raise ValueError(f"column {name} is there already")
    return df.withColumn(name, (F.lit(None) if value is None else value).cast(kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ValueError(f"cannot rename {old} to {new}")
    return df.withColumnRenamed(old, new)


def modify_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast(kind))


def truncate(df: DataFrame) -> DataFrame:
    """No rows; the schema stays and nothing is read."""
    return df.limit(0)


def returning(state: DataFrame, changed: DataFrame, columns: list) -> tuple[DataFrame, DataFrame]:
    """The new state of a table and the RETURNING rows of the change."""
    return state, changed.select(*columns)


def number_rows(df: DataFrame, order: str, start: int = 1, step: int = 1, name: str = "nextval") -> DataFrame:
    """Values of a sequence in the order of a column, without sorting the table into one task.

    Rows are range-partitioned; partition sizes give each partition its first number, and rows are numbered within it.
    """
    parts = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    local = cut_lineage(parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order))))  # split points are sampled: read once
    sizes = local.groupBy("_p").agg(F.max("_n").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).drop("_size")  # a row per partition
    return local.join(F.broadcast(before), "_p").withColumn(name, (F.lit(start) + F.lit(step) * (F.col("_before") + F.col("_n") - 1)).cast("bigint")).drop("_p", "_n", "_before")
