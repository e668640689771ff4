"""The top N items of every group, from sorted runs merged by a loser tree.

Every input partition is sorted by group, descending score and key (Spark's external sort) and becomes a run that keeps
the first N items of each group, so a group of any size costs at most N items per run. Runs are bucketed by group; the
runs of a bucket are merged with a loser tree, and once a group has its N items every run that still stands in it seeks
to its next group. Runs are merged in two passes, FAN_IN at a time in the first, each cut to N items a group again, so
a bucket holds no more than FAN_IN runs, in columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 256
BATCH_ROWS = 10_000


class Run:
    """A sorted run in columns: group number, rank key (smallest first) and item."""

    def __init__(self, group: Sequence[int], low: Sequence[float], item: Sequence[int]):
        self.group, self.low, self.item = np.asarray(group), np.asarray(low), np.asarray(item)
        self.at, self.end = 0, len(self.group)
        self.head = self._read()

    def _read(self) -> tuple | None:
        i = self.at
        return (int(self.group[i]), float(self.low[i]), int(self.item[i])) if i < self.end else None

    def step(self) -> None:
        self.at += 1
        self.head = self._read()

    def seek_after(self, group: int) -> None:
        """On to the first item of a later group."""
        self.at += int(np.searchsorted(self.group[self.at :], group, "right"))
        self.head = self._read()


class LoserTree:
    """Merges sorted runs: the leaf with the least head wins, inner nodes remember who lost there."""

    def __init__(self, runs: list[Run]):
        self.runs, self.k = runs, len(runs)
        winner = [0] * self.k + list(range(self.k))
        self.losers = [0] * self.k
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        self.top = winner[1] if self.k > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.runs[a].head, self.runs[b].head
        return y is None or (x is not None and (x, a) <= (y, b))

    @property
    def head(self) -> tuple | None:
        return self.runs[self.top].head if self.k else None

    def _replay(self) -> None:
        """The path from the leaf that has moved on to the root is played again."""
        leaf = self.top
        node = (leaf + self.k) // 2
        while node >= 1:
            if self._wins(self.losers[node], leaf):
                self.losers[node], leaf = leaf, self.losers[node]
            node //= 2
        self.top = leaf

    def pop(self) -> tuple | None:
        """The least head, whose run moves on."""
        out = self.head
        if out is not None:
            self.runs[self.top].step()
            self._replay()
        return out

    def seek_after(self, group: int) -> None:
        """Moves on every run that stands in a group up to this one; the others' paths are left alone."""
        while (head := self.head) is not None and head[0] <= group:
            self.runs[self.top].seek_after(group)
            self._replay()


def merge_top(runs: list[Run], n: int) -> Iterator[tuple]:
    """The first n different items of each group from sorted runs."""
    tree = LoserTree(runs)
    group, last, got = None, None, 0
    while (item := tree.pop()) is not None:
        if item[0] != group:
            group, last, got = item[0], None, 0
        if item == last:
            continue
        yield item
        last, got = item, got + 1
        if got == n:
            tree.seek_after(group)


def top_n(df: DataFrame, groups: list[str], score: str, key: str, n: int, buckets: int | None = None, digits: int | None = 2, fan_in: int = FAN_IN) -> DataFrame:
    """The n items of highest score of every group, or all if fewer: the group columns, key and rank (1 to n).

    Scores are compared when rounded to `digits` decimal places (None: as they are; -0.0 equals 0.0); of equal scores the
    smaller key goes first, so every run gives the same rows. Rows with a null in a group column or the key, and null or
    NaN scores, are left out; infinite scores count. Repeated rows of a key and score in a group count once; a key with
    several scores is several items. Group columns and key must be integers; other columns are ignored.
    """
    if not groups or n < 1:
        raise ValueError("top_n needs a group column and n of 1 or more")
    g = [f"g{i}" for i in range(len(groups))]
    x = F.col(f"`{score}`").cast("double")
    units = x if digits is None else F.round(x * 10.0**digits)
    rows = df.select(*[F.col(f"`{c}`").cast("bigint").alias(a) for c, a in zip(groups, g)], (-units + F.lit(0.0)).alias("low"), F.col(f"`{key}`").cast("bigint").alias("item"))
    rows = rows.dropna().where("NOT isnan(low)")
    b = buckets or 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        before: list | None = None  # the last row so far, and how many items its group has kept or passed
        passed = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            same = [np.r_[before is not None and before[i] == c[0], c[1:] == c[:-1]] for i, c in enumerate(cols)]
            goes_on = np.logical_and.reduce(same[: len(g)])
            again = np.logical_and.reduce(same)
            seen = np.cumsum(~again)
            start = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(seen))))
            place = seen - np.where(np.cumsum(~goes_on) > 0, seen[start] - 1, -passed)  # 1 for the first item of a group
            keep = np.flatnonzero(~again & (place <= n))
            before, passed = [c[-1] for c in cols], int(place[-1])
            if len(keep):
                t = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array([run] * len(keep), pa.int32())], names=[*g, "low", "item", "run"])

    names = ", ".join(f"{x} bigint" for x in g)
    runs = rows.sortWithinPartitions(*g, "low", "item").mapInArrow(cut, f"{names}, low double, item bigint, run int")
    kinds = f"{names}, low double, item bigint, run int, rank bigint"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *by, low, item, run, lot = [c.to_numpy() for c in pa.Table.from_batches(held).drop(["bucket"]).columns]
            order = np.lexsort(by[::-1])
            starts = np.zeros(len(order), bool)
            for c in by:
                starts[1:] |= c[order][1:] != c[order][:-1]
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(starts)
            example = order[np.r_[True, starts[1:]]]  # a row of each group
            cuts = np.flatnonzero(np.diff(run)) + 1
            out: list[tuple] = []
            group, rank = None, 0
            for got in merge_top([Run(*x) for x in zip(np.split(number, cuts), np.split(low, cuts), np.split(item, cuts))], n):
                group, rank = got[0], rank + 1 if got[0] == group else 1
                out.append((*got, rank))
                if len(out) == BATCH_ROWS:
                    yield rows_of(out, example, by, int(lot[0]))
                    out = []
            if out:
                yield rows_of(out, example, by, int(lot[0]))

        def rows_of(out: list[tuple], example: np.ndarray, by: list[np.ndarray], lot: int) -> pa.RecordBatch:
            group, low, item, rank = zip(*out)
            at = example[np.array(group)]
            return pa.RecordBatch.from_arrays([*[pa.array(c[at], pa.int64()) for c in by], pa.array(low, pa.float64()), pa.array(item, pa.int64()), pa.array([lot] * len(out), pa.int32()), pa.array(rank, pa.int64())], names=[*g, "low", "item", "run", "rank"])

        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            lot, bucket = batch.column(len(g) + 3).to_numpy(), batch.column(len(g) + 4).to_numpy()
            cuts = [0, *(np.flatnonzero((lot[1:] != lot[:-1]) | (bucket[1:] != bucket[:-1])) + 1), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if held and (lot[start], bucket[start]) != now:
                    yield from done(held)
                    held = []
                now = (lot[start], bucket[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from done(held)

    bucket = F.pmod(F.xxhash64(*g), F.lit(b))
    for lot in (F.floor(F.col("run") / F.lit(fan_in)).cast("int"), F.lit(0)):
        stored = runs.select(*g, "low", "item", "run", lot.alias("lot"), bucket.alias("bucket")).repartition("bucket", "lot")
        runs = stored.sortWithinPartitions("bucket", "lot", "run", *g, "low", "item").mapInArrow(merge, kinds)
    return runs.select(*[F.col(a).alias(c) for a, c in zip(g, groups)], F.col("item").alias(key), "rank")
