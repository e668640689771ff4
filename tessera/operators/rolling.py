"""Rolling totals over trailing periods.

Orders are first summed into sparse daily totals (aggregated before the shuffle, so an entity with a third of all rows
shrinks to one row a day), calendar rows are then laid between active days, and range frames over integer day numbers
give the trailing sums. Averages divide by the length of the period, not by the number of active days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


MOST = 1e30  # amounts beyond count as this much: sums of a hundred million of them still are exact
CENTS = "decimal(38,0)"


def daily_totals(orders: DataFrame, entity: str, amount: str, at: str, row_id: str) -> DataFrame:
    """entity, day (days since 1970-01-01), cents (decimal): rows alike in row id, entity, time and amount count once.

    Rows without entity, amount or time do not count, nor do NaN and infinite amounts. Amounts are whole cents, each
    rounded half away from zero, and summed exactly; those beyond 1e30 in magnitude count as 1e30.
    """
    x = F.col(f"`{amount}`").cast("double")
    rows = orders.select(F.col(f"`{entity}`").cast("bigint").alias("entity"), F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{at}`").alias("at"), x.alias("amount"))
    rows = rows.where("entity IS NOT NULL AND at IS NOT NULL AND amount IS NOT NULL AND NOT isnan(amount) AND abs(amount) < double('Infinity')")
    once = rows.distinct()
    cents = F.round(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("amount"))) * 100).cast(CENTS)
    return once.groupBy("entity", F.unix_date(F.to_date("at")).alias("day")).agg(F.sum(cents).cast(CENTS).alias("cents"))


def rolling_totals(daily: DataFrame, periods: tuple[int, ...] = (7, 30), every_day: bool = True) -> DataFrame:
    """For each entity and day from its first to its last: cents of the day, total_N (cents) and average_N of each period N.

    With every_day false, only the days on which a total may change come out: those with cents, and those on which such
    a day leaves a period. On the days between, totals are those of the day before, so extremes can be told without them.
    """
    by_day = Window.partitionBy("entity").orderBy("day")
    if every_day:
        until = F.coalesce(F.lead("day").over(by_day) - 1, F.col("day"))
        rows = daily.select("entity", F.col("day").alias("active_day"), "cents", until.alias("until"))
        rows = rows.select("entity", "active_day", "cents", F.explode(F.sequence("active_day", "until")).alias("day"))
        calendar = rows.select("entity", "day", F.when(F.col("day") == F.col("active_day"), F.col("cents")).otherwise(F.lit(0).cast(CENTS)).alias("cents"))
    else:
        last = F.max("day").over(Window.partitionBy("entity"))
        changes = F.explode(F.array(F.lit(0), *map(F.lit, periods))).alias("later")
        rows = daily.select("entity", "day", "cents", last.alias("last")).select("entity", "day", "cents", "last", changes)
        rows = rows.select("entity", (F.col("day") + F.col("later")).alias("day"), F.when(F.col("later") == 0, F.col("cents")).otherwise(F.lit(0).cast(CENTS)).alias("cents"), "last")
        calendar = rows.where("day <= last").groupBy("entity", "day").agg(F.sum("cents").cast(CENTS).alias("cents"))
    totals = {f"total_{n}": F.sum("cents").over(by_day.rangeBetween(-(n - 1), 0)).cast(CENTS) for n in periods}
    out = calendar.select("entity", "day", "cents", *[c.alias(k) for k, c in totals.items()])
    return out.withColumns({f"average_{n}": F.col(f"total_{n}").cast("double") / F.lit(100.0 * n) for n in periods})


def rolling_extremes(rolling: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """entity, period_days, extreme (`high`, `low`) and the earliest day (bigint) with that trailing total, from all days or those of changes."""
    best = []
    for n in periods:
        t = F.col(f"total_{n}")
        best += [F.max(F.struct(t.alias("t"), (-F.col("day")).alias("d"))).alias(f"high_{n}"), F.min(F.struct(t.alias("t"), F.col("day").alias("d"))).alias(f"low_{n}")]
    per = rolling.groupBy("entity").agg(*best)
    cases = [F.struct(F.lit(n).cast("bigint").alias("period_days"), F.lit(e).alias("extreme"), (F.col(f"{e}_{n}.d") * (-1 if e == "high" else 1)).alias("day")) for n in periods for e in ("high", "low")]
    return per.select("entity", F.inline(F.array(*cases)))
