"""References to records that do not exist.

Children and parents are put in one long form (parent table, key, tag), grouped by parent table and key, and the
groups that lack a sound parent are kept; the child rows of those keys only are then reported, and counted by period.
The grouping is aggregated before its shuffle, so a key held by a third of all rows costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Children:
    """Rows that refer to others: `refs` maps a key column to the parent table it points at."""

    table: str
    df: DataFrame
    row_id: str
    loaded_at: str
    refs: dict[str, str]


@dataclass(frozen=True)
class Parents:
    table: str
    df: DataFrame
    key: str
    loaded_at: str


def _child_rows(c: Children) -> DataFrame:
    """One row for each non-null reference, from a single scan of the child table."""
    refs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(p).alias("ref_table"), F.col(f"`{f}`").cast("bigint").alias("ref_key")) for f, p in c.refs.items()])
    return (
        c.df.select(F.col(f"`{c.row_id}`").cast("bigint").alias("row_id"), F.col(f"`{c.loaded_at}`").alias("loaded"), F.inline(refs))
        .where(F.col("ref_key").isNotNull())
        .select(F.lit(c.table).alias("table_name"), "field_name", "ref_table", "ref_key", "row_id", "loaded")
    )


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def unsound_keys(children: list[Children], parents: list[Parents], deletions: DataFrame | None = None) -> DataFrame:
    """Keys referred to whose parent is deleted, missing, or loaded after the first child.

    Columns: ref_table, ref_key, is_deleted, has_parent, parent_loaded. deletions has table_name, key_id and
    restored_at; a key counts as deleted if one of its rows has no restored_at.
    """
    none = F.lit(None).cast("timestamp_ntz")
    longs = [_child_rows(c).select("ref_table", "ref_key", F.lit("child").alias("tag"), F.col("loaded").cast("timestamp_ntz").alias("at")) for c in children]
    longs += [p.df.select(F.lit(p.table).alias("ref_table"), F.col(f"`{p.key}`").cast("bigint").alias("ref_key"), F.lit("parent").alias("tag"), F.col(f"`{p.loaded_at}`").cast("timestamp_ntz").alias("at")).where("ref_key IS NOT NULL") for p in parents]
    if deletions is not None:
        longs.append(deletions.where("restored_at IS NULL AND key_id IS NOT NULL").select(F.col("table_name").alias("ref_table"), F.col("key_id").cast("bigint").alias("ref_key"), F.lit("deleted").alias("tag"), none.alias("at")))
    is_ = lambda t: F.col("tag") == t
    keys = _union(longs).groupBy("ref_table", "ref_key").agg(
        F.max(is_("child")).alias("has_child"),
        F.max(is_("parent")).alias("has_parent"),
        F.max(is_("deleted")).alias("is_deleted"),
        F.min(F.when(is_("parent"), F.col("at"))).alias("parent_loaded"),
        F.min(F.when(is_("child"), F.col("at"))).alias("child_loaded"),
    )
    return keys.where("has_child AND (is_deleted OR NOT has_parent OR child_loaded < parent_loaded)").drop("has_child", "child_loaded")


def orphan_references(children: list[Children], parents: list[Parents], deletions: DataFrame | None = None) -> DataFrame:
    """Every child record whose reference is unsound: table_name, field_name, row_id, period_month, reason.

    reason is `deleted`, else `missing`, else `late` (the parent's earliest loading is after the record's). Null keys
    are no references. Repeated rows are one record, loaded at their earliest loading; rows without a row id count as
    one record for each key. A record without a loading time has a null period and is never late. A parent table with
    no rows makes every reference `missing`; an empty child table gives no rows. Other columns are ignored.
    """
    bad = unsound_keys(children, parents, deletions)
    rows = _union([_child_rows(c) for c in children])
    reason = F.when(F.col("is_deleted"), "deleted").when(~F.col("has_parent"), "missing").when(F.col("loaded") < F.col("parent_loaded"), "late")
    # A late record stays late over its repeated rows: the earliest of them is among those kept here.
    hit = rows.join(bad, ["ref_table", "ref_key"]).withColumn("reason", reason).where("reason IS NOT NULL")
    return (
        hit.groupBy("table_name", "field_name", "row_id", "ref_key", "reason")
        .agg(F.min("loaded").alias("loaded"))
        .select("table_name", "field_name", "row_id", F.date_format("loaded", "yyyy-MM").alias("period_month"), "reason")
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field, period and reason."""
    return found.groupBy("table_name", "field_name", "period_month", "reason").agg(F.count(F.lit(1)).alias("orphans"))
