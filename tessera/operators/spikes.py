"""Implausible readings in measurements, judged per source.

Readings are laid out by source in order of time. Each reading's deviation from the course around it, and its rate of
change, go into log-bucket quantile sketches per source, metric and hour of day; sketches of hours and of partitions are
merged by adding counts, and give the interquartile ranges, i.e. the scatter and the rates that are usual in that source,
and whether the metric rests. Flagged are impossible readings, stuck stretches (no variance in a metric that otherwise
moves) and spikes: outside fences at an expanded interquartile range, of the hour where the hour has enough readings and
of the source elsewhere, and entered or left at an implausible rate of change.

A source that fits one task is sketched and judged there in one pass. A longer one is cut by rank into pieces of
PIECE_ROWS rows, and each also gets the HALO_ROWS possible readings of each metric before and after it, however far
away they lie; its sketches are merged across pieces first, and a second pass judges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

PIECE_ROWS = 4096
HALO_ROWS = 96
BROADCAST_ROWS = 100_000  # long sources are broadcast up to so many, and joined beyond
RANGE_ROWS, MOST_RANGES = 65_536, 2000  # rows of long sources are numbered in ranges of about so many, in at most so many ranges
GAMMA = 1.02  # of the sketch: relative error of a quantile is below 1 %
OFFSET = 6000  # bucket of a deviation of zero
TINY = 1e-9  # deviations below this count as zero
NO_SOURCE = "\x00"  # stands for a null source, so that its rows form one
EQUAL, LONG_EQUAL, READINGS = 100_000, 100_001, 100_002  # counters kept beside the buckets


@dataclass(frozen=True)
class Rules:
    """Fixed values of the problem: length of a stuck stretch and of a spike, and the fence in multiples of the scatter."""

    stuck: int = 10
    spike: int = 4
    fence: float = 6.0
    least: int = 20  # readings from which a source's scatter is well known; with n fewer the fence is wider, by least / n
    hour_least: int = 500  # readings from which an hour of day has a fence of its own
    rate_fence: float = 0.5  # interquartile ranges beyond the quartiles from which a rate of change is implausible
    context: int = 5  # readings on each side that tell the course
    resting: float = 0.4  # share of equal neighbours from which a metric is said to rest


def pieces(df: DataFrame, metrics: list[Metric], piece_rows: int = PIECE_ROWS, halo_rows: int = HALO_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """df (see lay_out) with `piece` and `core`, of sources left whole, and of long ones (None if there are none).

    Long sources are cut by rank; readings near a cut also go to other pieces, with core false.

    Long sources lose their repeated rows. A piece with possible readings of a metric gets the halo_rows ones before
    and after it, and of impossible readings between these the first of each stretch, which ends a stuck stretch. Rows
    are numbered, and possible readings counted, within ranges of rows, to which the counts of earlier ranges are added.
    """
    columns = df.columns
    long = cut_lineage(df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * piece_rows))
    rows, sources = long.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if not sources:
        return df.withColumns({"piece": F.lit(0).cast("bigint"), "core": F.lit(True)}), None
    names = F.broadcast(long.select("source")) if sources <= BROADCAST_ROWS else long.select("source")
    short = df.join(names, "source", "left_anti").withColumns({"piece": F.lit(0).cast("bigint"), "core": F.lit(True)})
    ranged = df.join(names, "source").repartitionByRange(min(MOST_RANGES, rows // RANGE_ROWS + 1), "source", "at", "sample_id")
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))

    within = Window.partitionBy("_range", "source").orderBy("at", "sample_id")
    counts = ["_rank", *[f"_upto_{i}" for i in range(len(metrics))]]
    once = ranged.withColumn("_again", F.coalesce(F.col("sample_id") == F.lag("sample_id").over(within), F.lit(False))).where("NOT _again").drop("_again")
    once = once.withColumns({f"_ok_{i}": F.col(f"`{m.name}_there`") & _possible(m) for i, m in enumerate(metrics)})
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    ok_before = lambda i, m: F.coalesce(F.last(F.when(F.col(f"`{m.name}_there`"), F.col(f"_ok_{i}")), ignorenulls=True).over(before), F.lit(True))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    once = once.withColumns({"_rank": F.count(F.lit(1)).over(upto)} | {f"_upto_{i}": F.sum(F.col(f"_ok_{i}").cast("bigint")).over(upto) for i in range(len(metrics))} | {f"_use_{i}": F.col(f"`{m.name}_there`") & (F.col(f"_ok_{i}") | ok_before(i, m)) for i, m in enumerate(metrics)})
    per_range = once.groupBy("_range", "source").agg(*[F.max(c).alias(c) for c in counts])
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = per_range.select("_range", "source", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_earlier") for c in counts])
    numbered = once.join(per_range, ["_range", "source"]).withColumns({c: F.col(c) + F.col(f"{c}_earlier") for c in counts}).drop(*[f"{c}_earlier" for c in counts])
    numbered = cut_lineage(numbered.withColumn("piece", F.floor((F.col("_rank") - 1) / piece_rows)))

    # What each piece needs: of metric i, rows whose count of possible readings lies from lo to hi.
    ends = numbered.groupBy("source", F.col("piece").alias("to")).agg(*[x for i in range(len(metrics)) for x in (F.min(F.col(f"_upto_{i}") - F.col(f"_ok_{i}").cast("bigint")).alias(f"a_{i}"), F.max(f"_upto_{i}").alias(f"b_{i}"))])
    side = lambda i, lo, hi: F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"), (F.col(f"a_{i}") < F.col(f"b_{i}")).alias("any"))
    sides = [x for i in range(len(metrics)) for a, b in [(F.col(f"a_{i}"), F.col(f"b_{i}"))] for x in (side(i, a - halo_rows + 1, a), side(i, b, b + halo_rows))]
    needs = ends.select("source", "to", F.inline(F.array(*sides))).where("any").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / halo_rows), F.floor(F.col("hi") / halo_rows))))
    uses = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_upto_{i}").alias("upto"), F.col(f"_use_{i}").alias("use")) for i in range(len(metrics))])
    offered = numbered.select(*columns, "_rank", "piece", F.inline(uses)).where("use").withColumn("bucket", F.floor(F.col("upto") / halo_rows))
    halo = offered.join(needs, ["source", "i", "bucket"]).where("upto BETWEEN lo AND hi AND piece <> to").drop("piece").withColumnRenamed("to", "piece").dropDuplicates(["source", "piece", "_rank"])
    cut = numbered.select(*columns, "piece", F.lit(True).alias("core")).unionByName(halo.select(*columns, "piece", F.lit(False).alias("core")))
    return short, cut_lineage(cut)


def _possible(m: Metric) -> Column:
    """Whether a reading that is there is not impossible, as in Laid.readings."""
    x = F.col(f"`{m.name}`")
    return F.coalesce(~F.isnan(x) & (x < float("inf")) & ((x >= 0) if m.zero_ok else (x > 0)) & (x <= F.coalesce(F.col(f"`{m.name}_most`"), F.lit(float("inf")))), F.lit(False))


class Laid:
    """Whole pieces of readings, one after the other, without repeated rows: arrays of equal length."""

    def __init__(self, t: pd.DataFrame):
        seg = (t["source"].ne(t["source"].shift()) | t["piece"].ne(t["piece"].shift())).cumsum()
        again = t["sample_id"].notna() & t["sample_id"].eq(t["sample_id"].shift()) & seg.eq(seg.shift())
        self.t = t = t[~again].reset_index(drop=True)
        self.seg = seg[~again].to_numpy()
        self.core = t["core"].to_numpy(bool)
        self.hour = t["at"].dt.hour.fillna(-1).to_numpy(int)
        self.seconds = np.where(t["at"].isna(), np.nan, t["at"].to_numpy("datetime64[us]").astype(np.int64) / 1e6)

    def readings(self, metric: str, zero_ok: bool) -> tuple[np.ndarray, np.ndarray]:
        """Values as doubles, and which of them are impossible; a null is NaN and not impossible."""
        raw = self.t[metric]
        x = raw.to_numpy(float, na_value=np.nan)
        there = self.t[f"{metric}_there"].to_numpy(bool)
        bad = there & (~np.isfinite(x) | (x < 0) | ((x == 0) & (not zero_ok)))
        with np.errstate(invalid="ignore"):
            bad |= there & (x > self.t[f"{metric}_most"].astype(float).fillna(np.inf).to_numpy())
        return np.where(there & ~bad, x, np.nan), bad


def equal_stretches(x: np.ndarray, seg: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For each reading, how many successive equal readings it is one of; nulls (there False) are passed over."""
    n = np.zeros(len(x), int)
    at = np.flatnonzero(there)
    if len(at):
        v, s = x[at], seg[at]
        start = np.r_[True, (v[1:] != v[:-1]) | (s[1:] != s[:-1])]
        group = np.cumsum(start) - 1
        n[at] = np.bincount(group)[group]
    return n


def _around(x: np.ndarray, seg: np.ndarray, offsets: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """For each of the rows (default: all) the readings at row + offsets of the same piece, NaN beyond its ends."""
    at = np.arange(len(x)) if rows is None else rows
    i = at[:, None] + offsets[None, :]
    j = np.clip(i, 0, max(0, len(x) - 1))
    return np.where((i == j) & (seg[j] == seg[at][:, None]), x[j], np.nan)


def deviations(x: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Each reading less the mean of its two neighbours; NaN at the ends of a piece."""
    a = _around(x, seg, np.array([-1, 1]))
    return x - (a[:, 0] + a[:, 1]) / 2


def rates(x: np.ndarray, seg: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """Change a second from the reading before; NaN at the start of a piece and where no time passed or a time is missing."""
    out = np.full(len(x), np.nan)
    with np.errstate(all="ignore"):
        out[1:] = np.where(seg[1:] == seg[:-1], np.diff(x) / np.where(np.diff(seconds) > 0, np.diff(seconds), np.nan), np.nan)
    return np.where(np.isfinite(out), out, np.nan)


def _middle(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and the upper median of each row without its NaN; they differ where the count is even."""
    s = np.sort(a, axis=1)  # NaN last
    n = np.isfinite(a).sum(axis=1)
    r = np.arange(len(a))
    lo, hi = s[r, np.maximum((n - 1) // 2, 0)], s[r, np.minimum(n // 2, a.shape[1] - 1)]
    return np.where(n > 0, lo, np.nan), np.where(n > 0, hi, np.nan)


def _median(a: np.ndarray) -> np.ndarray:
    lo, hi = _middle(a)
    return (lo + hi) / 2


def _slope(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Median of the slopes over all pairs of readings on one side of the excursion."""
    p = before.shape[1]
    i, j = np.triu_indices(p, 1)
    return np.nan_to_num(_median(np.hstack([(w[:, j] - w[:, i]) / (j - i) for w in (before, after)])))


def _middle_of_two(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The median of the union of two equally long lists that are in ascending order, element by element of their arrays."""
    def smallest(m: int) -> np.ndarray:
        """The m-th smallest: over all ways to take m from the fronts of both, the least of the greater last ones."""
        ways = [b[m - k - 1] if k == 0 else a[k - 1] if k == m else np.maximum(a[k - 1], b[m - k - 1]) for k in range(max(0, m - len(b)), min(len(a), m) + 1)]
        return np.minimum.reduce(ways)

    return (smallest(len(a)) + smallest(len(a) + 1)) / 2


def _middle_of_five(a, b, c, d, e) -> np.ndarray:
    f, g = np.maximum(np.minimum(a, b), np.minimum(c, d)), np.minimum(np.maximum(a, b), np.maximum(c, d))
    return np.maximum(np.minimum(f, g), np.minimum(np.maximum(f, g), e))


def _outside(rest: list[np.ndarray], low: np.ndarray, high: np.ndarray, scatter: np.ndarray, apart: float) -> np.ndarray:
    """By how many scatters all of rest lie above high, or all below low, where these two agree."""
    with np.errstate(all="ignore"):
        size = np.maximum(np.minimum.reduce(rest) - high, low - np.maximum.reduce(rest))
        agree = high - low <= np.maximum(3 * scatter, apart * size)
        return np.where(agree & np.isfinite(size) & (scatter > 0), size / scatter, 0.0)


def excursions(x: np.ndarray, seg: np.ndarray, scatter: np.ndarray, rules: Rules, course: np.ndarray | None = None, apart: float = 0.2) -> np.ndarray:
    """For each reading, by how many scatters it lies outside the course on both sides of a short excursion (0: in none).

    An excursion is 1 to rules.spike successive readings that all lie on one side of the lines carried on from the
    readings before and from those after, where these two lines, level or with the slope around, agree: they are apart
    by no more than three scatters or the share `apart` of the excursion. course is x without readings that do not
    belong to the course.
    """
    course = x if course is None else course
    p, n, best = rules.context, len(x), np.zeros(len(x))
    steps = np.arange(1, p + 1)
    gaps = np.r_[0, np.cumsum(~np.isfinite(course))]
    slopes: list[np.ndarray] = []  # in ascending order, of all pairs in the p readings from each on
    for length in range(rules.spike, 0, -1) if n else ():
        z, some = np.zeros(n), np.ones(n, bool)
        m = n - length - 2 * p + 1  # starts with all readings around them, from p on
        if p == 5 and m > 0:
            if not slopes:
                windows = np.stack([course[k : n - p + 1 + k] for k in range(p)])
                slopes = list(np.ascontiguousarray(np.sort(np.stack([(windows[j] - windows[i]) / (j - i) for i, j in zip(*np.triu_indices(p, 1))], axis=1), axis=1).T))
            whole = (seg[:m] == seg[2 * p + length - 1 :]) & (gaps[p : p + m] == gaps[:m]) & (gaps[2 * p + length :] == gaps[p + length : p + length + m])
            sc, rest = scatter[p : p + m], [x[p + k : p + k + m] for k in range(length)]
            before, after = [course[k : k + m] for k in range(p)], [course[p + length + k : p + length + k + m] for k in range(p)]
            slope = _middle_of_two([v[:m] for v in slopes], [v[p + length : p + length + m] for v in slopes])
            b, a = _middle_of_five(*before), _middle_of_five(*after)
            got = _outside(rest, np.minimum(a, b), np.maximum(a, b), sc, apart)
            b, a = _middle_of_five(*[v + slope * (p - k) for k, v in enumerate(before)]), _middle_of_five(*[v - slope * (length + k) for k, v in enumerate(after)])
            got = np.maximum(got, _outside([v - slope * k for k, v in enumerate(rest)], np.minimum(a, b), np.maximum(a, b), sc, apart))
            z[p : p + m] = np.where(whole, got, 0.0)
            some[p : p + m] = ~whole
        at = np.flatnonzero(some)  # where readings around are missing: the same from those that are there
        before, after, inside = _around(course, seg, -steps[::-1], at), _around(course, seg, length - 1 + steps, at), _around(x, seg, np.arange(length), at)
        enough = (np.isfinite(before).sum(axis=1) >= 2) & (np.isfinite(after).sum(axis=1) >= 2)
        at, before, after, inside = at[enough], before[enough], after[enough], inside[enough]
        for slope in (np.zeros(len(at)), _slope(before, after)):
            b = _middle(before - slope[:, None] * -steps[::-1])
            a = _middle(after - slope[:, None] * (length - 1 + steps))
            z[at] = np.maximum(z[at], _outside(list((inside - slope[:, None] * np.arange(length)).T), np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), scatter[at], apart))
        for k in range(min(length, n)):
            best[k:] = np.maximum(best[k:], z[: n - k])
    return best


@dataclass(frozen=True)
class Metric:
    """A measured column; readings above the SQL expression `most` are impossible, and zeros unless zero_ok."""

    name: str
    most: str | None = None
    zero_ok: bool = True


def lay_out(df: DataFrame, source: str, at: str, sample_id: str, metrics: list[Metric], piece_rows: int = PIECE_ROWS, halo_rows: int = HALO_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The columns of df that the passes need, of sources left whole and of pieces (see pieces), as source, piece, core, at, sample_id and for each metric its value, whether it is there, and its limit."""
    per = [c for m in metrics for c in (F.col(f"`{m.name}`").cast("double").alias(m.name), F.col(f"`{m.name}`").isNotNull().alias(f"{m.name}_there"), (F.expr(m.most) if m.most else F.lit(None)).cast("double").alias(f"{m.name}_most"))]
    slim = df.select(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NO_SOURCE)).alias("source"), F.col(f"`{at}`").cast("timestamp_ntz").alias("at"), F.col(f"`{sample_id}`").cast("bigint").alias("sample_id"), *per)
    return pieces(slim, metrics, piece_rows, halo_rows)


def _whole_groups(batches: Iterator[pa.RecordBatch], at_least: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames of whole pieces from batches sorted by source and piece."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) < at_least:
            continue
        t = pa.Table.from_batches(held).to_pandas()
        last = t["source"].eq(t["source"].iloc[-1])
        end = int((~(last & t["piece"].eq(t["piece"].iloc[-1]))).sum())
        if end:
            yield t.iloc[:end].reset_index(drop=True)
            held = pa.Table.from_pandas(t.iloc[end:], schema=b.schema, preserve_index=False).to_batches()
    if held:
        yield pa.Table.from_batches(held).to_pandas()


def bucket_of(d: np.ndarray) -> np.ndarray:
    """Buckets that order numbers on a signed log scale."""
    return (OFFSET + np.sign(d) * np.ceil(np.log(np.maximum(np.abs(d), TINY) / TINY) / np.log(GAMMA))).astype(int)


class Course:
    """The possible readings of a metric, one after the other: their place in the table, deviation, rate of change, and whether they equal the one before."""

    def __init__(self, laid: Laid, m: Metric, rules: Rules):
        self.x, self.bad = laid.readings(m.name, m.zero_ok)
        self.at = np.flatnonzero(np.isfinite(self.x))
        self.y, self.seg, self.core = self.x[self.at], laid.seg[self.at], laid.core[self.at]
        self.hour = laid.hour[self.at]
        self.deviation, self.rate = deviations(self.y, self.seg), rates(self.y, self.seg, laid.seconds[self.at])
        self.pair = np.r_[False, self.seg[1:] == self.seg[:-1]][: len(self.at)]
        self.same = self.pair & np.r_[False, self.y[1:] == self.y[:-1]][: len(self.at)]
        self.long = self.same & (equal_stretches(self.y, self.seg, np.ones(len(self.at), bool)) >= rules.stuck)


def rate_of(metric: str) -> str:
    """The name under which sketches keep the rates of change of a metric."""
    return f"{metric} per second"


def sketches(laid: DataFrame, metrics: list[Metric], rules: Rules) -> DataFrame:
    """Partial quantile sketches: source, metric, hour, bucket, n. Adding n over hours, pieces and inputs merges them.

    bucket orders the deviations of readings from their neighbours' mean, on a signed log scale; three further
    buckets count pairs of equal neighbours, those of stuck length, and all pairs. Rates of change have rows of their
    own (see rate_of).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _whole_groups(batches):
            laid_ = Laid(frame)
            source = laid_.t["source"].to_numpy(object)
            for m in metrics:
                c = Course(laid_, m, rules)
                ok, told = c.core & np.isfinite(c.deviation), c.core & np.isfinite(c.rate)
                rows = [(c.at[ok], bucket_of(c.deviation[ok]))] + [(c.at[c.core & k], np.full(int((c.core & k).sum()), b)) for k, b in ((c.same, EQUAL), (c.long, LONG_EQUAL), (c.pair, READINGS))]
                for name, i, b in ((m.name, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])), (rate_of(m.name), c.at[told], bucket_of(c.rate[told]))):
                    n = pd.DataFrame({"source": source[i], "hour": laid_.hour[i], "bucket": b}).groupby(["source", "hour", "bucket"]).size().reset_index(name="n")
                    if len(n):
                        yield pa.RecordBatch.from_arrays([pa.array(n["source"].tolist(), pa.string()), pa.array([name] * len(n), pa.string()), pa.array(n["hour"], pa.int32()), pa.array(n["bucket"], pa.int32()), pa.array(n["n"], pa.int64())], names=["source", "metric", "hour", "bucket", "n"])

    ordered = laid.repartition("source", "piece").sortWithinPartitions("source", "piece", "at", "sample_id")
    return ordered.mapInArrow(run, "source string, metric string, hour int, bucket int, n bigint")


def profiles(sketch: DataFrame, by: tuple[str, ...] = ("source", "metric")) -> DataFrame:
    """What is usual: quartiles of the deviation, scatter (its interquartile range as a standard deviation of the reading) and shares of equal neighbours."""
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*by)
    upto = F.sum(F.when(F.col("bucket") < EQUAL, F.col("n")).otherwise(0)).over(of.orderBy("bucket"))
    ranked = merged.withColumns({"upto": upto, "all": F.sum(F.when(F.col("bucket") < EQUAL, F.col("n")).otherwise(0)).over(of)})
    power = F.abs(F.col("bucket") - OFFSET)
    value = F.when(power == 0, 0.0).otherwise(F.signum(F.col("bucket") - OFFSET) * TINY * F.pow(F.lit(GAMMA), power - 0.5))
    at = lambda q: F.min(F.when((F.col("bucket") < EQUAL) & (F.col("upto") >= F.ceil(F.col("all") * q)), F.struct(F.col("bucket"), value.alias("v"))))["v"]
    count = lambda c: F.coalesce(F.sum(F.when(F.col("bucket") == c, F.col("n"))), F.lit(0))
    out = ranked.groupBy(*by).agg(F.coalesce(F.max("all"), F.lit(0)).alias("readings"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"), count(EQUAL).alias("equal"), count(LONG_EQUAL).alias("stuck_equal"), count(READINGS).alias("pairs"))
    return out.withColumn("scatter", F.coalesce((F.col("q3") - F.col("q1")) / F.lit(DEVIATION_IQR), F.lit(0.0)))


@dataclass
class Usual:
    """What is usual for a metric, in arrays by source: scatter, counts of pairs, the quartiles of the rate of change, and the scatter of each hour of day (NaN where it has too few readings; the last of 25 is of unknown hours)."""

    scatter: np.ndarray
    equal: np.ndarray
    stuck_equal: np.ndarray
    pairs: np.ndarray
    rate_q1: np.ndarray
    rate_q3: np.ndarray
    hours: np.ndarray

    @classmethod
    def of(cls, c: Course, sources: int, rules: Rules) -> Usual:
        """From whole sources, numbered by c.seg: the same sketches as in sketches() and profiles(), merged on the spot."""
        count = lambda k: np.bincount(c.seg[k], minlength=sources).astype(float)
        ok, told = np.isfinite(c.deviation), np.isfinite(c.rate)
        q1, q3, _ = _quartiles(c.seg[ok], bucket_of(c.deviation[ok]), sources)
        by_hour = _quartiles(c.seg[ok] * 25 + c.hour[ok] % 25, bucket_of(c.deviation[ok]), 25 * sources)
        hours = np.where(by_hour[2] >= rules.hour_least, (by_hour[1] - by_hour[0]) / DEVIATION_IQR, np.nan).reshape(sources, 25)
        rate_q1, rate_q3, _ = _quartiles(c.seg[told], bucket_of(c.rate[told]), sources)
        return cls(np.nan_to_num((q3 - q1) / DEVIATION_IQR), count(c.same), count(c.long), count(c.pair), rate_q1, rate_q3, hours)


DEVIATION_IQR = 1.349 * 1.5**0.5  # interquartile range of the deviation in scatters (standard deviations) of the reading


def _quartiles(key: np.ndarray, bucket: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the buckets at a quarter and three quarters of each key's readings (NaN if none), and how many it has."""
    b = bucket[np.lexsort((bucket, key))]
    n = np.bincount(key, minlength=keys)
    start = np.cumsum(n) - n
    out = []
    for q in (0.25, 0.75):
        at = b[np.minimum(start + np.maximum(np.ceil(n * q).astype(int), 1) - 1, len(b) - 1)] if len(b) else np.zeros(keys, int)
        power = np.abs(at - OFFSET)
        out.append(np.where(n == 0, np.nan, np.where(power == 0, 0.0, np.sign(at - OFFSET) * TINY * GAMMA ** (power - 0.5))))
    return out[0], out[1], n


def _judged(laid: Laid, m: Metric, c: Course, u: Usual, which: np.ndarray, rules: Rules) -> Iterator[tuple[str, np.ndarray]]:
    """Each reason and for which rows of laid it holds; which: the number of each row's source in u."""
    moving = (u.equal < rules.resting * u.pairs) | (u.pairs == 0)
    moving &= (u.equal - u.stuck_equal) < rules.resting * np.maximum(u.pairs - u.stuck_equal, 1)
    there = laid.t[f"{m.name}_there"].to_numpy(bool)
    moves = moving[which]
    stuck = ~c.bad & moves & (equal_stretches(c.x, laid.seg, there) >= rules.stuck)
    v, y, seg, of = c.at, c.y, c.seg, which[c.at]
    own = u.hours[of, c.hour % 25]
    scatter = np.where(np.isfinite(own), own, u.scatter[of]) * np.maximum(1.0, rules.least / (u.pairs[of] + 1))
    course = np.where(stuck[v], np.nan, y)
    first = excursions(course, seg, scatter, rules)
    z = excursions(y, seg, scatter, rules, np.where(first > rules.fence, np.nan, course), apart=0.5)
    high = z > rules.fence
    wide = rules.rate_fence * (u.rate_q3 - u.rate_q1)[of]
    with np.errstate(invalid="ignore"):
        sudden = ~((c.rate >= u.rate_q1[of] - wide) & (c.rate <= u.rate_q3[of] + wide))  # also where the rate is not known
    # The rate into the first reading of an excursion and out of its last one, that is, into the one after it.
    new = high & ~np.r_[False, (high[:-1] & (seg[1:] == seg[:-1]))][: len(high)]
    run = np.cumsum(new)
    into = np.bincount(run[high], weights=sudden[high], minlength=len(high) + 1) > 0
    last = np.flatnonzero(high & ~np.r_[high[1:] & (seg[1:] == seg[:-1]), False][: len(high)])
    after = np.minimum(last + 1, len(high) - 1)
    into[run[last]] |= sudden[after] & (seg[after] == seg[last])
    spike = np.zeros(len(c.x), bool)
    spike[v] = high & into[run] & moves[v]
    for what, hit in (("impossible", c.bad), ("stuck", stuck), ("spike", spike & ~stuck)):
        yield what, hit & laid.core


def _reported(laid: Laid, m: Metric, judged: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for what, hit in judged:
        if hit.any():
            ids = laid.t.loc[hit, "sample_id"]
            yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(ids, type=pa.int64()), pa.array([m.name] * len(ids), pa.string()), pa.array([what] * len(ids), pa.string())], names=["sample_id", "metric", "reason"])


CASES = "sample_id bigint, metric string, reason string"


def implausible_readings(df: DataFrame, source: str, at: str, sample_id: str, metrics: list[Metric], rules: Rules = Rules(), piece_rows: int = PIECE_ROWS, halo_rows: int = HALO_ROWS) -> DataFrame:
    """sample_id, metric and reason (`impossible`, `stuck` or `spike`) of every implausible reading.

    Impossible: NaN, infinite, below zero, zero where the metric allows none, above its limit. Stuck: one of
    rules.stuck or more successive equal readings, unless the metric rests (a share rules.resting or more of its pairs
    of neighbours, or of those outside stuck stretches, are equal). Spike: see excursions(), beyond rules.fence
    scatters of the source, or of its hour of day if that has rules.hour_least readings, and entered or left at a rate of
    change beyond rules.rate_fence. In a source of n readings, fewer than rules.least, the fence is wider by least / n.
    A null is never a case and is passed over; repeated rows of a sample id (same source and time) count once; rows of a
    null source form one source; rows without a time come first in theirs. Extra columns are ignored.
    """
    halo_rows = max(halo_rows, 2 * (rules.spike + rules.context) + rules.stuck)  # readings that a verdict depends on
    short, cut = lay_out(df, source, at, sample_id, metrics, piece_rows, halo_rows)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _whole_groups(batches):
            laid = Laid(frame)
            laid.seg = laid.seg - laid.seg.min(initial=1)
            sources = int(laid.seg.max(initial=-1)) + 1
            for m in metrics:
                c = Course(laid, m, rules)
                yield from _reported(laid, m, _judged(laid, m, c, Usual.of(c, sources, rules), laid.seg, rules))

    found = short.repartition("source").sortWithinPartitions("source", "at", "sample_id").mapInArrow(whole, CASES)
    return found if cut is None else found.unionByName(_judged_pieces(cut, metrics, rules))


def _judged_pieces(cut: DataFrame, metrics: list[Metric], rules: Rules) -> DataFrame:
    """The implausible readings of sources cut into pieces."""
    sketch = cut_lineage(sketches(cut, metrics, rules).groupBy("source", "metric", "hour", "bucket").agg(F.sum("n").alias("n")))
    profile = profiles(sketch)
    hourly = profiles(sketch, ("source", "metric", "hour")).where(F.col("readings") >= rules.hour_least)
    fields = ("scatter", "equal", "stuck_equal", "pairs")
    of = lambda name, c: F.max(F.when(F.col("metric") == name, F.col(c).cast("double")))
    per = [of(m.name, c).alias(f"{c}_{i}") for i, m in enumerate(metrics) for c in fields] + [of(rate_of(m.name), c).alias(f"rate_{c}_{i}") for i, m in enumerate(metrics) for c in ("q1", "q3")]
    wide = profile.groupBy("source").agg(*per)
    at_hour = lambda m, h: F.max(F.when((F.col("metric") == m.name) & (F.pmod("hour", F.lit(25)) == h), F.col("scatter")))
    wide = wide.join(hourly.groupBy("source").agg(*[F.array(*[at_hour(m, h) for h in range(25)]).alias(f"hours_{i}") for i, m in enumerate(metrics)]), "source", "left")
    # What is usual in a source travels to each of its pieces in the same shuffle as the readings, as a row ahead of them.
    of_piece = cut.select("source", "piece").distinct().join(wide, "source", "left")
    both = cut.withColumn("first", F.lit(1)).unionByName(of_piece.withColumn("first", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition("source", "piece").sortWithinPartitions("source", "piece", "first", "at", "sample_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _whole_groups(batches):
            head = frame["first"].eq(0)
            heads = frame[head]
            data = frame[~head].reset_index(drop=True)
            data["which"] = (np.cumsum(head.to_numpy()) - 1)[~head.to_numpy()]
            laid = Laid(data)
            for i, m in enumerate(metrics):
                hours = np.array([np.full(25, np.nan) if h is None else np.array(h, float) for h in heads[f"hours_{i}"]]).reshape(-1, 25)
                known = [np.nan_to_num(heads[f"{c}_{i}"].to_numpy(float)) for c in fields]
                usual = Usual(*known, *[heads[f"rate_{c}_{i}"].to_numpy(float) for c in ("q1", "q3")], hours)
                yield from _reported(laid, m, _judged(laid, m, Course(laid, m, rules), usual, laid.t["which"].to_numpy(int), rules))

    return ordered.mapInArrow(run, CASES)
