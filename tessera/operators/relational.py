"""Relational operators that Spark's API lacks or spells differently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.session import cut_lineage

# Joins


def right_semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return right.join(left, on, "left_anti")


def broadcast_if_small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if the optimizer's size estimate is known to be below most_bytes; else df, for a shuffle join."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most_bytes else df


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left for which `left_key NOT IN (right keys)` is true: none if right holds a null, all if right is empty."""
    keys = right.select(F.col(right_key).alias("_k"))
    state = keys.agg(F.count(F.lit(1)).alias("_all"), F.count("_k").alias("_known"))
    candidate = left.crossJoin(F.broadcast(state)).where((F.col("_all") == 0) | ((F.col("_all") == F.col("_known")) & F.col(left_key).isNotNull()))  # one row
    return candidate.join(keys.where("_k IS NOT NULL").distinct(), candidate[left_key] == F.col("_k"), "left_anti").drop("_all", "_known")


def range_join(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of left whose point lies in [start, end] of a row of right, as an equi-join on buckets of the given width.

    Each interval is copied to the buckets it touches, so width should be near the usual length of an interval.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    r = right.where(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    lb = left.withColumn("_bucket", bucket(point))
    cond = (lb["_bucket"] == r["_bucket"]) & (lb[point] >= r[start]) & (lb[point] <= r[end])
    out = lb.join(r, cond, how).drop(lb["_bucket"])
    return out if how in ("left_semi", "left_anti") else out.drop(r["_bucket"])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each row of left with the values of the latest row of right at or before it, as one sorted pass over both (no join)."""
    # left columns travel in a struct, so names may clash
    lefts = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("_r"))
    rights = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = lefts.unionByName(rights).withColumn("_seen", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_l.*", *[F.col(f"_seen.{v}").alias(v) for v in values])


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over `salts` tasks; small is copied once per salt."""
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("salting keeps the rows of the big side: inner, left or left_semi")
    b = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")


# Grouping


def group_concat(x: Column, separator: str = ",", order: Column | None = None, descending: bool = False) -> Column:
    """Texts of a group joined by a separator, nulls left out; null for a group without texts.

    A group's texts have to fit one row; use it for groups of known size.
    """
    if order is None:
        texts = F.sort_array(F.collect_list(x.cast("string")))
    else:
        pairs = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.cast("string").alias("v")))), asc=not descending)
        texts = F.transform(pairs, lambda p: p["v"])
    return F.when(F.size(texts) > 0, F.array_join(texts, separator))


def quantile_disc_floor(x: Column, f: float) -> Column:
    """The value at index floor(f * (n - 1)) of the sorted values."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(F.lit(f) * (F.size(values) - 1)).cast("int"))


def quantile_cont(x: Column, f: float | list[float]) -> Column:
    """Linear interpolation at f * (n - 1); null for no values. A list of fractions gives an array."""
    fs = f if isinstance(f, list) else [f]
    if not all(0 <= v <= 1 for v in fs):
        raise ValueError("a quantile lies between 0 and 1")
    return F.percentile(x, F.array(*map(F.lit, fs)) if isinstance(f, list) else F.lit(f))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    cols = [c for c in df.columns if any(c in s for s in sets)]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(*aggs)


# Windows


def over_groups(agg: Callable[[str], Column], column: str, partition: list[str], order: str, before: int, after: int) -> Callable[[DataFrame, str], DataFrame]:
    """GROUPS BETWEEN before PRECEDING AND after FOLLOWING: a range frame over the dense rank of the order key."""

    def add(df: DataFrame, name: str) -> DataFrame:
        ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
        w = Window.partitionBy(*partition).orderBy("_group").rangeBetween(-before, after)
        return ranked.withColumn(name, agg(column).over(w)).drop("_group")

    return add


def sum_excluding_current(column: str, w: WindowSpec) -> Column:
    """A framed sum with EXCLUDE CURRENT ROW; null if no other row of the frame has a value."""
    others = F.count(column).over(w) - F.when(F.col(column).isNotNull(), 1).otherwise(0)
    return F.when(others > 0, F.sum(column).over(w) - F.coalesce(F.col(column), F.lit(0)))


def top_per_group(df: DataFrame, partition: list[str], order: list[Column], n: int, ties: str = "row_number") -> DataFrame:
    """The first n rows of each group; Spark cuts each input partition to n before the shuffle (WindowGroupLimit)."""
    rank = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[ties]()
    return df.withColumn("_rn", rank.over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


# Sets and recursion


def set_operation(kind: str, a: DataFrame, b: DataFrame, nocase: list[str] | None = None, by_name: bool = False) -> DataFrame:
    """union, union_all, intersect, intersect_all, except or except_all; nocase columns are compared without case and keep a's spelling."""
    if by_name:
        if kind not in ("union", "union_all"):
            raise ValueError("by_name goes with unions")
        u = a.unionByName(b, allowMissingColumns=True)
        return u if kind == "union_all" else u.distinct()
    if not nocase:
        return {"union": lambda: a.union(b).distinct(), "union_all": lambda: a.union(b), "intersect": lambda: a.intersect(b), "intersect_all": lambda: a.intersectAll(b), "except": lambda: a.subtract(b), "except_all": lambda: a.exceptAll(b)}[kind]()
    fold = lambda df: [F.lower(F.col(c)) if c in nocase else F.col(c) for c in df.columns]
    b = b.toDF(*a.columns)
    keys = [f"_k{i}" for i in range(len(a.columns))]
    tag = lambda df, side: df.select("*", *[k.alias(n) for k, n in zip(fold(df), keys)], F.lit(side).alias("_side"))
    both = tag(a, 0).unionByName(tag(b, 1))
    first = F.min(F.struct("_side", *a.columns)).alias("_first")
    g = both.groupBy(*keys).agg(first, F.max(F.col("_side") == 0).alias("_a"), F.max(F.col("_side") == 1).alias("_b"))
    keep = {"union": F.lit(True), "intersect": F.col("_a") & F.col("_b"), "except": F.col("_a") & ~F.col("_b")}[kind]
    return g.where(keep).select(*[F.col(f"_first.{c}").alias(c) for c in a.columns])


def recursive_distinct(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION (distinct): rounds of step on the new rows until none is new.

    Each round is checkpointed into the shared folder, so that the plan does not grow and lost executors cost no rows.
    """
    seen = cut_lineage(anchor.distinct())
    new = seen
    for _ in range(most_rounds):
        new = cut_lineage(step(new).toDF(*anchor.columns).subtract(seen))
        if new.isEmpty():
            return seen
        seen = cut_lineage(seen.union(new))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
