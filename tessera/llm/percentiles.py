"""Percentiles per group from dyadic Count-sketches.

Values are encoded as integers that keep their order; a sketch holds, for every binary resolution of the codes, counts
of the nodes at that resolution: exactly for the coarse ones, and in one signed Count-sketch each for the fine ones. All
of it is linear in the counts, so sketches merge by addition and a deletion is a count of -1. A rank is inverted by going
down the resolutions. A sketch that has had few updates travels as these updates (codes and their counts, which take
less room than the counters they stand for); it is spread over its counters before any percentile is read, so the answer
is that of the counters whatever form a sketch had on its way.

Bounds. Value: off by at most 2**-14 of itself, from TINY to about 1e46 in magnitude; below TINY it comes out as 0, above
as about 1e46. Rank: `rank_error`, a share of the group's count: three standard deviations of the summed errors of the
resolutions on the way down, from the sketch's own second moments without the two nodes that are told apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22
GAMMA = 1 + 2.0**-14
TINY = 1e-9  # values nearer to zero count as zero
DEPTH, WIDTH, EXACT_BITS = 5, 1024, 14
SKETCHED = BITS - EXACT_BITS
COUNTERS = (1 << EXACT_BITS) + SKETCHED * DEPTH * WIDTH
PENDING_MOST = COUNTERS * 8 // 12  # updates that take as much room as the counters
FAN_IN = 64  # partial sketches of a group merged by one task at a time
AT_ONCE = 32  # sketches spread over their counters at a time
ZERO = 1 << (BITS - 1)
_LN = math.log(GAMMA)
_MOST = ZERO - 2
_SALTS = np.array([[(level * DEPTH + row + 1) * 0xD1B54A32D192ED03 & (2**64 - 1) for row in range(DEPTH)] for level in range(SKETCHED)], np.uint64)
_FIRST = (1 << EXACT_BITS) + WIDTH * np.arange(SKETCHED * DEPTH).reshape(SKETCHED, DEPTH)


def code_of(value: Column) -> Column:
    """The code of a double: ordered as the values; infinite and greater than 1e46 share the codes at the ends."""
    a = F.abs(value)
    steps = F.least(F.floor(F.log(a / F.lit(TINY)) / F.lit(_LN)) + 1, F.lit(_MOST).cast("bigint"))
    return F.when(a < TINY, F.lit(ZERO).cast("bigint")).otherwise(F.lit(ZERO) + F.signum(value).cast("bigint") * F.when(a == float("inf"), F.lit(_MOST + 1).cast("bigint")).otherwise(F.greatest(steps, F.lit(1).cast("bigint"))))


def value_of(code: np.ndarray) -> np.ndarray:
    """The middle of the values with a code."""
    k = np.asarray(code, np.int64) - ZERO
    v = np.sign(k) * TINY * np.exp((np.abs(k) - 0.5) * _LN)
    return np.where(k == 0, 0.0, np.where(np.abs(k) > _MOST, np.where(k > 0, np.inf, -np.inf), v))


def _hashed(nodes: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of nodes under salts, which are broadcast against each other."""
    with np.errstate(over="ignore"):
        x = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salts
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(WIDTH)).astype(np.int64), 1 - 2 * (x >> np.uint64(63)).astype(np.int64)


def _spread(counters: np.ndarray, codes: np.ndarray, counts: np.ndarray, start: np.ndarray | int = 0) -> None:
    """Adds counts of codes to counters (flat), which begin at start for each code."""
    counts = counts.astype(counters.dtype, copy=False)
    np.add.at(counters, start + (codes >> (BITS - EXACT_BITS)), counts)
    for level in range(SKETCHED):
        bucket, sign = _hashed((codes >> (SKETCHED - 1 - level))[None, :], _SALTS[level][:, None])
        np.add.at(counters, (bucket + _FIRST[level][:, None] + start).ravel(), (sign * counts).ravel())


class DyadicSketch:
    def __init__(self) -> None:
        self._updates: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0
        self.counters: np.ndarray | None = None

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts, negative ones for deletions, to codes."""
        if self.counters is not None:
            _spread(self.counters, codes, counts)
            return
        self._updates.append((codes, counts))
        self._waiting += len(codes)
        if self._waiting > PENDING_MOST and len(self.updates()[0]) > PENDING_MOST:
            self.counters = self.spread()
            self._updates = []

    def updates(self) -> tuple[np.ndarray, np.ndarray]:
        """Different codes and their counts, in order, while they have not been spread over the counters."""
        if len(self._updates) != 1:
            codes = np.concatenate([np.empty(0, np.int64), *[c for c, _ in self._updates]])
            c, where = np.unique(codes, return_inverse=True)
            n = np.zeros(len(c), np.int64)
            np.add.at(n, where, np.concatenate([np.empty(0, np.int64), *[k for _, k in self._updates]]))
            self._updates = [(c[n != 0], n[n != 0])]
            self._waiting = len(self._updates[0][0])
        return self._updates[0]

    def spread(self) -> np.ndarray:
        if self.counters is not None:
            return self.counters
        counters = np.zeros(COUNTERS, np.int64)
        _spread(counters, *self.updates())
        return counters

    def merge(self, other: DyadicSketch) -> None:
        if other.counters is None:
            self.add(*other.updates())
        elif self.counters is None:
            mine, self.counters, self._updates = self.updates(), other.counters.copy(), []
            _spread(self.counters, *mine)
        else:
            self.counters = self.counters + other.counters

    @property
    def n(self) -> int:
        return int(self.updates()[1].sum() if self.counters is None else self.counters[: 1 << EXACT_BITS].sum())

    def quantiles(self, q: np.ndarray) -> np.ndarray:
        """Codes of the smallest values whose rank reaches ceil(q * n)."""
        return answers([self], np.asarray(q, float))[1][0]

    def rank_error(self, q: Sequence[float] = (0.5,)) -> float:
        return float(answers([self], np.asarray(q, float))[2][0])

    def dump(self) -> bytes:
        if self.counters is not None:
            return b"d" + self.counters.astype("<i8").tobytes()
        codes, counts = self.updates()
        small = not len(counts) or np.abs(counts).max() < 2**31
        return (b"s" if small else b"l") + codes.astype("<i4").tobytes() + counts.astype("<i4" if small else "<i8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> DyadicSketch:
        s = cls()
        if raw[:1] == b"d":
            s.counters = np.frombuffer(raw, "<i8", offset=1).copy()
        else:
            wide = 4 if raw[:1] == b"s" else 8
            n = (len(raw) - 1) // (4 + wide)
            s._updates = [(np.frombuffer(raw, "<i4", n, 1).astype(np.int64), np.frombuffer(raw, f"<i{wide}", n, 1 + 4 * n).astype(np.int64))]
            s._waiting = n
        return s


def answers(sketches: list[DyadicSketch], q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, codes at the quantiles q, and bound of the rank error of each sketch, all read from the counters (as doubles, exact up to 2**53)."""
    g, k = len(sketches), len(q)
    c = np.zeros((g, COUNTERS))
    few = [(i, *s.updates()) for i, s in enumerate(sketches) if s.counters is None]
    if few:
        start = np.repeat([i * COUNTERS for i, *_ in few], [len(codes) for _, codes, _ in few])
        _spread(c.reshape(-1), np.concatenate([x for _, x, _ in few]), np.concatenate([x for *_, x in few]), start)
    for i, s in enumerate(sketches):
        if s.counters is not None:
            c[i] = s.counters
    top = np.cumsum(c[:, : 1 << EXACT_BITS], axis=1)
    n = top[:, -1].astype(np.int64)
    rank = np.maximum(np.ceil(q[None, :] * n[:, None]), 1)
    node = np.minimum(np.array([np.searchsorted(t, r) for t, r in zip(top, rank)]).reshape(g, k), (1 << EXACT_BITS) - 1)
    row = np.arange(g)[:, None]
    inside = c[row, node]
    rank = rank - (top[row, node] - inside)
    fine = c[:, 1 << EXACT_BITS :].reshape(g, SKETCHED, DEPTH, WIDTH)
    moments = np.median(np.einsum("gldw,gldw->gld", fine, fine), axis=2)
    variance = np.zeros((g, k))
    for level in range(SKETCHED):
        kids = np.stack([node * 2, node * 2 + 1])
        bucket, sign = _hashed(kids[None], _SALTS[level][:, None, None, None])
        left, right = np.clip(np.median(sign * c[row, bucket + _FIRST[level][:, None, None, None]], axis=0), 0, inside)
        variance += np.maximum(moments[:, level][:, None] - left**2 - right**2, 0) / WIDTH
        # The two children hold what their parent holds: the surplus of the estimates is shared between them.
        left = np.clip(left + (inside - left - right) / 2, 0, inside)
        go = rank > left
        node, rank, inside = node * 2 + go, np.where(go, rank - left, rank), np.where(go, inside - left, left)
    return n, node, 3 * np.sqrt(variance.max(axis=1, initial=0.0)) / np.maximum(n, 1)


def _changes(b: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns; the first does."""
    out = np.zeros(b.num_rows, bool)
    out[:1] = True
    for name in names:
        col = b.column(b.schema.get_field_index(name))
        if pa.types.is_string(col.type):
            col = col.dictionary_encode().indices.fill_null(-1)
        x = col.to_numpy(zero_copy_only=False)
        out[1:] |= x[1:] != x[:-1]
    return out


def _by_group(batches: Iterator[pa.RecordBatch], by: Sequence[str], put) -> Iterator[pa.RecordBatch]:
    """One sketch for each run of equal keys, made by put(sketch, batch, start, end) for the part of a run in a batch."""
    now, sketch, keys, blobs, size = None, None, [], [], 0
    names = [*by, "sketch"]
    emit = lambda: pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.string()) for i in range(len(by))], pa.array(blobs, pa.binary())], names=names)
    for b in batches:
        if not b.num_rows:
            continue
        starts = np.flatnonzero(_changes(b, by))
        heads = list(zip(*[b.column(b.schema.get_field_index(c)).take(pa.array(starts)).to_pylist() for c in by]))
        for k, start, end in zip(heads, starts, [*starts[1:], b.num_rows]):
            if sketch is not None and k != now:
                keys.append(now)
                blobs.append(sketch.dump())
                size += len(blobs[-1])
                sketch = None
                if size > 1 << 23:
                    yield emit()
                    keys, blobs, size = [], [], 0
            if sketch is None:
                now, sketch = k, DyadicSketch()
            put(sketch, b, start, end)
    if sketch is not None:
        keys.append(now)
        blobs.append(sketch.dump())
    if keys:
        yield emit()


def _merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds up partial sketches in two steps, so that no task reads more than FAN_IN partitions' sketches of a group at first."""
    kinds = ", ".join(f"{c} string" for c in by) + ", sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(s: DyadicSketch, b: pa.RecordBatch, start: int, end: int) -> None:
            for raw in b.column(b.num_columns - 1).slice(start, end - start):
                s.merge(DyadicSketch.load(raw.as_py()))

        yield from _by_group(batches, by, put)

    lots = parts.select(*by, F.floor(F.spark_partition_id() / F.lit(FAN_IN)).alias("lot"), "sketch").repartition(*by, "lot").sortWithinPartitions(*by)
    return lots.drop("lot").mapInArrow(run, kinds).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, kinds)


def build_sketches(rows: DataFrame, by: Sequence[str] = ("group_key",)) -> DataFrame:
    """The key columns `by` (strings) and sketch, from rows with these, value (double) and optionally weight (-1: a deletion).

    Rows with a null in the first key, null values and NaN are left out; further keys may be null; a group without
    values has no sketch. Every partition builds the sketches of its own rows (sorted by group and code, so one sketch
    at a time is open), and only sketches are shuffled: a group of any size costs at most one sketch per partition.
    """
    weight = F.col("weight").cast("bigint") if "weight" in rows.columns else F.lit(1).cast("bigint")
    codes = rows.where(F.col(by[0]).isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).select(*by, code_of(F.col("value")).alias("code"), weight.alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(b: pa.RecordBatch) -> pa.RecordBatch:
            starts = np.flatnonzero(_changes(b, [*by, "code"]))
            n = np.add.reduceat(b.column(len(by) + 1).to_numpy(), starts) if len(starts) else np.empty(0, np.int64)
            first = b.take(pa.array(starts))
            return pa.RecordBatch.from_arrays([*first.columns[:-1], pa.array(n, pa.int64())], names=first.schema.names)

        put = lambda s, b, i, j: s.add(b.column(len(by)).to_numpy()[i:j], b.column(len(by) + 1).to_numpy()[i:j])
        yield from _by_group(map(counted, batches), by, put)

    partial = codes.sortWithinPartitions(*by, "code").mapInArrow(run, ", ".join(f"{c} string" for c in by) + ", sketch binary")
    return _merged(partial, by)


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("group_key",)) -> DataFrame:
    """Adds up sketches of several files, partitions or days, per key columns `by`."""
    return _merged(sketches.select(*by, "sketch"), by)


def percentiles(sketches: DataFrame, quantiles: list[float]) -> DataFrame:
    """group_key, n, rank_error, and pNN for each quantile. Groups whose counts add up to nothing are left out."""
    names = [f"p{round(q * 100):02d}" for q in quantiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                n, codes, error = answers([DyadicSketch.load(raw.as_py()) for raw in part.column(1)], np.array(quantiles))
                some = np.flatnonzero(n > 0)
                values = value_of(codes[some])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(n[some], pa.int64()), pa.array(error[some]), *[pa.array(v) for v in values.T]], names=["group_key", "n", "rank_error", *names])

    return sketches.select("group_key", "sketch").mapInArrow(run, "group_key string, n bigint, rank_error double, " + ", ".join(f"{n} double" for n in names))
