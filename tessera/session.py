"""Session construction, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE, ANSI). Settings of an existing session win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` (a file or a folder of files) under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temp views over the named tables, for SQL text."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only on a single machine (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return os.path.join(tempfile.gettempdir(), name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint df into the shared folder the cluster names in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "tessera-checkpoints"))
    return df.checkpoint()
