"""Differences between two copies of a table.

Both copies are tagged and range-partitioned by key with shared split points (sampled from their union), sorted within
partitions, and read in one streaming merge that emits keys missing on either side and fields with unlike values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable(df: DataFrame, field: str) -> Column:
    """A field in the form in which it is compared, as a string; equal strings are equal values, null stays null."""
    kind, c = dict(df.dtypes)[field], F.col(f"`{field}`")
    if kind in ("double", "float"):
        cents = F.round(c, 2) + F.lit(0.0)
        return F.when(F.isnan(c), "NaN").otherwise(F.when(cents == 0, "0.0").otherwise(cents.cast("string")))
    return F.rtrim(c) if kind == "string" else c.cast("string")


def _goes_on(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row has the same values in these (null-free) columns as the row before it."""
    out = np.ones(t.num_rows, bool)
    out[:1] = False
    for c in columns:
        x = t[c].combine_chunks()
        out[1:] &= pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return out


def _first_of_each(t: pa.Table) -> pa.Table:
    """The first row of every (key, side) of a sorted table."""
    again = _goes_on(t, ["row_key", "side"])
    return t.take(np.flatnonzero(~again)) if again.any() else t


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops repeated rows within each batch, ahead of the shuffle, so that no key can fill a partition with copies of itself."""
    for b in batches:
        t = pa.Table.from_batches([b])
        if len(t.group_by(["row_key", "side"], use_threads=False).aggregate([])) < len(t):
            t = _first_of_each(t.sort_by([(c, "ascending") for c in t.column_names]))  # nulls last, as in the sort after the shuffle
        yield from t.combine_chunks().to_batches()


def _merge_step(t: pa.Table, fields: list[str]) -> pa.Table:
    """Differences of whole key groups; t is sorted by key, then side.

    Two pointers go down the copies together: in the sorted table the row of the replica with a key comes right after
    that of the primary, and a row with neither such a neighbour is alone.
    """
    t = _first_of_each(t)
    met = np.flatnonzero(_goes_on(t, ["row_key"]))  # the replica's row of each key that both have
    alone = np.ones(t.num_rows, bool)
    alone[met] = alone[met - 1] = False
    primary = t["side"].to_numpy() == 0
    left, right = t.take(met - 1), t.take(met)
    out = [(t["row_key"].filter(pa.array(alone & side)), what) for side, what in ((primary, "missing_in_replica"), (~primary, "missing_in_primary"))]
    for f in fields:
        x, y = left[f], right[f]
        same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
        out.append((left["row_key"].filter(pc.invert(same)), f))
    return pa.concat_tables(pa.table({"row_key": k, "difference": pa.array([what] * len(k), pa.string())}) for k, what in out)


def copy_differences(primary: DataFrame, replica: DataFrame, key: str, fields: list[str], loaded_at: str | None = None) -> DataFrame:
    """row_key and difference of every key in one copy only, and every field that differs.

    difference is `missing_in_primary`, `missing_in_replica` or a field name. Strings are equal if so after dropping
    spaces at the end, floating numbers if equal in cents (NaN equals NaN, -0.0 is 0.0), null equals null only. Rows
    with a null key cannot be matched and are left out. Of repeated rows of a key the earliest by loaded_at counts,
    then the smallest values, nulls last. Columns that are not named in fields are ignored. Two empty copies give no rows; one
    empty copy makes every key of the other missing.
    """
    def side(df: DataFrame, n: int) -> DataFrame:
        at = F.col(f"`{loaded_at}`").cast("timestamp_ntz") if loaded_at else F.lit(None).cast("timestamp_ntz")
        return df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("row_key"), F.lit(n).alias("side"), at.alias("loaded"), *[comparable(df, f).alias(f"f{i}") for i, f in enumerate(fields)])

    names = [f"f{i}" for i in range(len(fields))]
    rows = side(primary, 0).unionByName(side(replica, 1))
    order = ["row_key", "side", *[F.col(c).asc_nulls_last() for c in ("loaded", *names)]]
    ordered = rows.mapInArrow(_shrink, rows.schema).repartitionByRange("row_key").sortWithinPartitions(*order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            last = t["row_key"][-1]
            whole = pc.less(t["row_key"], last)
            done, held = t.filter(whole), _first_of_each(t.filter(pc.invert(whole)))
            if done.num_rows:
                yield from _merge_step(done, names).combine_chunks().to_batches()
        if held is not None:
            yield from _merge_step(held, names).combine_chunks().to_batches()

    label = F.coalesce(*[F.when(F.col("difference") == f"f{i}", f) for i, f in enumerate(fields)], F.col("difference"))
    return ordered.mapInArrow(merge, f"row_key {dict(rows.dtypes)['row_key']}, difference string").select("row_key", label.alias("difference"))
