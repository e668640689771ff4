"""Data changes as transformations: each function returns the table's new state.

Keys are compared null-safe only where said; a NULL key never conflicts, as in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = a[keys[0]] == b[keys[0]]
    for k in keys[1:]:
        out = out & (a[k] == b[k])
    return out


def insert(target: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Appends; columns that rows lacks have their default, else NULL. A row without columns is INSERT DEFAULT VALUES."""
    kinds = {f.name: f.dataType for f in target.schema}
    lacking = {c: v.cast(kinds[c]) for c, v in (defaults or {}).items() if c not in rows.columns}
    return target.unionByName(rows.withColumns(lacking) if lacking else rows, allowMissingColumns=True)


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in order (an order that begins with the latest keeps the last); rows with a NULL key all stay."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.where(~known).unionByName(rows.where(known).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))


def replace_into(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows take the place of those with their key; rows must be unique by key (see last_per_key)."""
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows, allowMissingColumns=True)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti").select(*rows.columns), allowMissingColumns=True)


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: Mapping[str, Column] | None = None, update_if: Column | None = None, delete_if: Column | None = None, insert: Mapping[str, Column] | None = None, delete_unmatched_by_source: bool = False) -> DataFrame:
    """MERGE as one full outer join. Expressions name columns as t.x (target) and s.x (source); insert None inserts nothing.

    Matched rows are deleted where delete_if holds, else updated where update_if (or no condition) holds. Source rows
    must be unique by key, or the query fails as it runs (see last_per_key); rows with a NULL key match nothing.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    twice = known & (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)
    source = source.withColumn("_twice", F.when(twice, F.raise_error(F.lit(f"several source rows of a MERGE have the same {', '.join(keys)}"))).otherwise(F.lit(1)))
    source = source.where("_twice = 1").drop("_twice")
    t, s = target.withColumn("_t", F.lit(1)).alias("t"), source.withColumn("_s", F.lit(1)).alias("s")
    cond = F.col(f"t.{keys[0]}") == F.col(f"s.{keys[0]}")
    for k in keys[1:]:
        cond = cond & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    j = t.join(s, cond, "full")
    matched = F.col("_t").isNotNull() & F.col("_s").isNotNull()
    new = F.col("_t").isNull()
    apply = matched & (F.coalesce(update_if, F.lit(False)) if update_if is not None else F.lit(update is not None))
    gone = matched & F.coalesce(delete_if, F.lit(False)) if delete_if is not None else F.lit(False)
    if insert is None:
        gone = gone | new
    if delete_unmatched_by_source:
        gone = gone | F.col("_s").isNull()
    kinds = {f.name: f.dataType for f in target.schema}
    cols = []
    for c in target.columns:
        value = F.col(f"t.{c}")
        if update and c in update:
            value = F.when(apply, update[c]).otherwise(value)
        value = F.when(new, insert[c] if insert and c in insert else F.lit(None)).otherwise(value)
        cols.append(value.cast(kinds[c]).alias(c))
    return j.where(~gone).select(*cols)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: Mapping[str, Column] | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE / ON DUPLICATE KEY UPDATE; s.x is the excluded row. By default all other columns are taken over."""
    update = update or {c: F.col(f"s.{c}") for c in rows.columns if c not in keys}
    return merge(target, rows, keys, update, insert={c: F.col(f"s.{c}") for c in rows.columns})


def _first_rows(df: DataFrame, where: Column, order: list[Column] | None, limit: int) -> DataFrame:
    """df with `_hit`: true for the first `limit` rows, in order, for which the condition holds. Of equal rows as many as needed are hit.

    Only those rows are sorted, by the top-n operator; equal rows of a content are numbered, and that many are hit.
    """
    columns = df.columns
    best = df.where(where).orderBy(*(order or [])).limit(limit).toDF(*[f"_c{i}" for i in range(len(columns))])
    best = best.groupBy(*best.columns).agg(F.count(F.lit(1)).alias("_most"))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_c{i}"))
    out = df.join(F.broadcast(best) if limit <= 10_000 else best, same, "left").select(*columns, "_most")
    some = out.where("_most IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*columns).orderBy("_most")))
    hit = some.select(*columns, (F.col("_n") <= F.col("_most")).alias("_hit"))
    return out.where("_most IS NULL").select(*columns, F.lit(False).alias("_hit")).unionByName(hit)


def update(target: DataFrame, changes: Mapping[str, Column], where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """UPDATE ... SET ... WHERE ... ORDER BY ... LIMIT: all changes see the old row; a limit holds among equal rows too."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    df = target.withColumn("_hit", hit) if limit is None else _first_rows(target, hit, order, limit)
    kinds = {f.name: f.dataType for f in target.schema}
    return df.select(*[(F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).cast(kinds[c]) if c in changes else F.col(c)).alias(c) for c in target.columns])


def update_from(target: DataFrame, source: DataFrame, keys: list[str], changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE t JOIN s; rows without a partner stay."""
    return merge(target, source, keys, changes, update_if=where)


def delete(target: DataFrame, where: Column, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows for which the condition is true go; those for which it is NULL stay. With a limit, only the first in order go."""
    if limit is not None:
        return _first_rows(target, F.coalesce(where, F.lit(False)), order, limit).where("NOT _hit").drop("_hit")
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys).distinct(), keys, "left_anti").select(*target.columns)


def violations(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), checks: Mapping[str, Column] | None = None, foreign: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """constraint and how many rows break it, for each constraint that is broken. A NULL breaks neither UNIQUE, CHECK nor a foreign key."""
    out = []
    for c in not_null:
        out.append(df.where(F.col(c).isNull()).agg(F.lit(f"not null {c}").alias("constraint"), F.count(F.lit(1)).alias("rows")))
    for cols in unique:
        twice = df.dropna(subset=cols).groupBy(*cols).count().where("count > 1")
        out.append(twice.agg(F.lit(f"unique {', '.join(cols)}").alias("constraint"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")))
    for name, c in (checks or {}).items():
        out.append(df.where(~c).agg(F.lit(f"check {name}").alias("constraint"), F.count(F.lit(1)).alias("rows")))
    for c, (parent, key) in (foreign or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(parent.select(F.col(key).alias("_p")).distinct(), F.col(c) == F.col("_p"), "left_anti")
        out.append(lost.agg(F.lit(f"foreign key {c}").alias("constraint"), F.count(F.lit(1)).alias("rows")))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_.where("rows > 0")
