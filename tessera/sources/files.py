"""Files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def parquet_row_count(spark: SparkSession, path: str) -> int:
    """From the footers only: no column is read."""
    return spark.read.parquet(path).count()


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """With the real types; an empty table is written with its schema."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> None:
    """A table bucketed and sorted by keys: joins and groupings on them need no shuffle. path: where its files lie, else the warehouse."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_tbl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Pipe-separated text; the pipe at the end of a line is tolerated, an empty field is NULL."""
    return spark.read.csv(path, sep="|", schema=schema, nullValue="", emptyValue="", quote="", mode="PERMISSIVE", dateFormat="yyyy-MM-dd")


def infer_tbl(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Like read_tbl with each column an integer if all its fields are, else a double, else text; one pass over the file to tell."""
    raw = read_tbl(spark, path, ", ".join(f"`{n}` string" for n in names))
    tests = [F.bool_and(F.col(n).try_cast(t).isNotNull() | F.col(n).isNull()).alias(f"{n}|{t}") for n in names for t in ("bigint", "double")]
    fits = raw.agg(*tests).first().asDict()
    kind = lambda n: next((t for t in ("bigint", "double") if fits[f"{n}|{t}"] is not False), "string")
    return raw.select(*[F.col(n).cast(kind(n)).alias(n) for n in names])


def load_data(spark: SparkSession, path: str, schema: StructType | str, fields_terminated: str = "\t", enclosed: str = "", escaped: str = "\\", lines_terminated: str = "\n", ignore_lines: int = 0) -> DataFrame:
    r"""LOAD DATA INFILE: delimited text with optional quotes; \N is NULL; ignore_lines is 0 or 1."""
    if ignore_lines not in (0, 1):
        raise ValueError("at most one header line can be passed over")
    return spark.read.csv(path, sep=fields_terminated, schema=schema, quote=enclosed, escape=escaped, lineSep=lines_terminated, header=bool(ignore_lines), nullValue="\\N")


def into_outfile(df: DataFrame, path: str, fields_terminated: str = "\t", enclosed: str = "", lines_terminated: str = "\n", header: bool = False) -> None:
    """SELECT ... INTO OUTFILE, as a folder of files."""
    df.write.mode("overwrite").csv(path, sep=fields_terminated, quote=enclosed or "\u0000", quoteAll=bool(enclosed), lineSep=lines_terminated, header=header, nullValue="\\N")


def bulk_insert(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
