"""Small cases and brute force for orphans, copies, rolling totals and implausible readings."""

import random
from datetime import datetime, timedelta
from decimal import Decimal
from statistics import median, median_high, median_low

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.copydiff import copy_differences
from tessera.operators.orphans import Children, Parents, orphan_counts, orphan_references
from tessera.operators.rolling import daily_totals, rolling_extremes, rolling_totals
from tessera.operators.spikes import Metric, Rules, excursions, implausible_readings

T0 = datetime(2025, 1, 1)


def at(days):
    return T0 + timedelta(days=days)


def orphans(spark, children, parents, deletions):
    c = spark.createDataFrame(children, "id long, k long, loaded timestamp_ntz, tag string, ref_key string")
    p = spark.createDataFrame(parents, "k long, loaded timestamp_ntz, tag string")
    d = spark.createDataFrame(deletions, "table_name string, key_id long, deleted_at timestamp_ntz, restored_at timestamp_ntz")
    return orphan_references([Children("c", c, "id", "loaded", {"k": "p"})], [Parents("p", p, "k", "loaded")], d)


def test_orphans(spark):
    children = [
        (1, 10, at(5), "", ""), (2, 11, at(5), "", ""), (2, 11, at(40), "", ""),  # sound; missing, delivered twice
        (3, 12, at(5), "", ""), (4, 13, at(5), "", ""), (5, None, at(5), "", ""),  # deleted; late; null key
        (6, 13, at(50), "", ""), (7, 14, at(5), "", ""), (8, 15, None, "", ""), (4, 13, at(60), "", ""),
    ]
    parents = [(10, at(1), ""), (12, at(1), ""), (13, at(20), ""), (13, at(30), ""), (14, at(1), ""), (None, at(1), "")]
    deletions = [("p", 12, at(2), None), ("p", 14, at(2), at(3)), ("other", 10, at(2), None), ("p", 12, at(2), None)]
    found = orphans(spark, children, parents, deletions)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("c", "k", 2, "2025-01", "missing"), ("c", "k", 3, "2025-01", "deleted"), ("c", "k", 4, "2025-01", "late"), ("c", "k", 8, None, "missing")], key=str)
    assert sorted(r["orphans"] for r in orphan_counts(found).collect()) == [1, 1, 1, 1]


def test_orphans_empty(spark):
    assert orphans(spark, [], [(1, at(0), "")], []).count() == 0
    assert [r["reason"] for r in orphans(spark, [(1, 1, at(0), "", "")], [], []).collect()] == ["missing"]


COPY = "k long, name string, cents double, n int, row_key string, at timestamp_ntz"


def differ(spark, a, b):
    d = copy_differences(spark.createDataFrame(a, COPY), spark.createDataFrame(b, COPY), "k", ["name", "cents", "n"], "at")
    return sorted(map(tuple, d.collect()))


def test_copies(spark):
    nan = float("nan")
    a = [(1, "x  ", 1.004, 1, "", at(0)), (2, "", nan, None, "", at(0)), (3, None, -0.0, 3, "", at(0)), (4, "d", 1.0, 4, "", at(0)), (4, "d", 1.0, 4, "", at(9)), (None, "z", 0.0, 0, "", at(0)), (6, "a b", 2.0, 1, "", at(0))]
    b = [(1, "x", 1.0, 1, "", at(3)), (2, None, nan, None, "", at(0)), (3, None, 0.0, 4, "", at(0)), (5, "e", 1.0, 5, "", at(0)), (5, "e", 1.0, 5, "", at(2)), (6, "a  b", None, 1, "", at(0))]
    assert differ(spark, a, b) == [(2, "name"), (3, "n"), (4, "missing_in_replica"), (5, "missing_in_primary"), (6, "cents"), (6, "name")]
    assert differ(spark, a, a) == [] and differ(spark, [], []) == []
    assert differ(spark, [(1, "x", 1.0, 1, "", None)], []) == [(1, "missing_in_replica")]


def test_copies_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(1)
        a = [(k, f"n{k % 5}", float(k), k % 3, "", at(0)) for k in range(300) for _ in range(1 + (k % 4))]
        b = [(k, f"n{k % 5}" if k % 11 else "other", float(k), k % 3, "", at(0)) for k in range(0, 330) if k % 13]
        r.shuffle(a)
        r.shuffle(b)
        want = [(k, "missing_in_replica") for k in range(300) if k % 13 == 0] + [(k, "missing_in_primary") for k in range(300, 330) if k % 13] + [(k, "name") for k in range(300) if k % 13 and k % 11 == 0]
        assert differ(spark, a, b) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


ORDERS = "id long, c long, total double, at timestamp_ntz, entity string, day string"


def test_rolling_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 2, 3]), round(r.uniform(-50, 90), 2), T0 + timedelta(days=r.randrange(90), hours=r.randrange(24)), "", "") for i in range(60)]
    dirt = [rows[0], (100, None, 5.0, at(1), "", ""), (101, 1, None, at(1), "", ""), (102, 1, 5.0, None, "", ""), (103, 1, float("nan"), at(1), "", "")]
    daily = daily_totals(spark.createDataFrame(rows + dirt, ORDERS), "c", "total", "at", "id")
    got = {(x["entity"], x["day"]): (x["total_7"], x["total_30"], x["average_7"]) for x in rolling_totals(daily).collect()}
    want, best = {}, {}
    epoch = datetime(1970, 1, 1)
    for c in (1, 2, 3):
        per = {}
        for i, k, v, t, *_ in rows:
            if k == c:
                per[(t - epoch).days] = per.get((t - epoch).days, 0) + round(v * 100)
        for d in range(min(per), max(per) + 1):
            s = [sum(per.get(d - j, 0) for j in range(n)) for n in (7, 30)]
            want[c, d] = (s[0], s[1], s[0] / 700)
            for n, x in ((7, s[0]), (30, s[1])):
                best.setdefault((c, n, "high"), []).append((-x, d))
                best.setdefault((c, n, "low"), []).append((x, d))
    assert {k: (a, b, round(f, 9)) for k, (a, b, f) in got.items()} == {k: (a, b, round(f, 9)) for k, (a, b, f) in want.items()}
    ext = {(x["entity"], x["period_days"], x["extreme"]): x["day"] for x in rolling_extremes(rolling_totals(daily)).collect()}
    assert ext == {k: min(v)[1] for k, v in best.items()}


def test_rolling_on_days_of_change_and_of_huge_amounts(spark):
    """Extremes from the days of change are those from all days; amounts beyond 1e16 count to the cent, negative ones too."""
    r = random.Random(12)
    rows = [(i, r.choice([1, 2, 3]), r.choice([2e16, -2e16, 0.01, -0.01, 5.0, 1e300, -1e300, float("inf")]), T0 + timedelta(days=r.choice([0, 1, 6, 7, 29, 30, 31, 60, 200]))) for i in range(60)]
    daily = daily_totals(spark.createDataFrame([(i, c, x, t) for i, c, x, t in rows], "id long, c long, total double, at timestamp_ntz"), "c", "total", "at", "id")
    cents = lambda x: int(Decimal(repr(max(-1e30, min(1e30, x)) * 100))) if abs(x) > 1 else round(x * 100)
    want = {}
    for _, c, x, t in rows:
        if x < float("inf"):
            want[c, (t - datetime(1970, 1, 1)).days] = want.get((c, (t - datetime(1970, 1, 1)).days), 0) + cents(x)
    assert {(x["entity"], x["day"]): int(x["cents"]) for x in daily.collect()} == want
    both = [sorted(map(tuple, rolling_extremes(rolling_totals(daily, every_day=e)).collect())) for e in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 12
    few = rolling_totals(daily, every_day=False)
    assert few.count() == few.select("entity", "day").distinct().count() < rolling_totals(daily).count()


def test_rolling_empty(spark):
    daily = daily_totals(spark.createDataFrame([], ORDERS), "c", "total", "at", "id")
    assert rolling_extremes(rolling_totals(daily)).count() == 0


@pytest.mark.parametrize("batch", ["10000", "1"])
def test_copies_repeated_at_the_same_time(spark, batch):
    """Which of two rows of equal key and time counts does not depend on the batch they come in: the smaller values, nulls last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    kinds = "k long, v string, w int, at timestamp_ntz"
    p = spark.createDataFrame([(1, "a", None, T0), (2, "z", 5, T0)], kinds)
    r = spark.createDataFrame([(1, None, None, T0), (1, "a", None, T0), (2, "z", None, T0), (2, "z", 5, T0), (2, "b", 1, None)], kinds).coalesce(1)
    assert copy_differences(p, r, "k", ["v", "w"], "at").count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def readings(spark, runs, **kw):
    """runs: lists of values; each becomes a source with a reading a minute."""
    rows = [(1000 * r + i, f"run{r}", T0 + timedelta(minutes=i), v, 1000.0, "clash", 1) for r, vs in enumerate(runs) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "sample_id long, run string, ts timestamp_ntz, x double, cap double, source string, piece int")
    out = implausible_readings(df.unionAll(df.limit(5)), "run", "ts", "sample_id", [Metric("x", "cap", zero_ok=False)], **kw)
    return {(r["sample_id"], r["reason"]) for r in out.collect()}


def noise(n, seed, level=100.0, scatter=2.0, slope=0.0):
    r = random.Random(seed)
    return [level + slope * i + r.gauss(0, scatter) for i in range(n)]


def test_spikes(spark):
    spiky = noise(200, 1)
    for i in (50, 51, 120):
        spiky[i] += 60
    step = [v + (40 if i > 100 else 0) for i, v in enumerate(noise(200, 2))]
    saw = [5.0 * (i % 25) + v for i, v in enumerate(noise(200, 3, 10.0, 0.5))]
    stuck = noise(200, 4)
    stuck[80:92] = [stuck[80]] * 12
    rest = [50.0 if i % 40 else 51.0 for i in range(200)]
    odd = noise(100, 5)
    odd[3], odd[10], odd[20], odd[30], odd[40] = float("nan"), float("inf"), -1.0, 0.0, 2000.0
    gaps = [None if i % 17 == 0 else v for i, v in enumerate(noise(100, 6))]
    want = {(50, "spike"), (51, "spike"), (120, "spike")} | {(3000 + i, "stuck") for i in range(80, 92)} | {(5000 + i, "impossible") for i in (3, 10, 20, 30, 40)}
    runs = [spiky, step, saw, stuck, rest, odd, gaps]
    assert readings(spark, runs) == want
    assert readings(spark, runs, piece_rows=32, halo_rows=40) == want  # sources cut into pieces give the same


def test_spikes_of_a_long_source_do_not_depend_on_its_pieces(spark, monkeypatch):
    r = random.Random(11)
    rows, t = [], T0
    for i in range(2400):  # a reading each second, then one each two minutes; y is there in one of nine
        t += timedelta(seconds=1 if i < 2000 else 120)
        rows.append([i, "long", t, r.gauss(100, 2), r.gauss(50, 1) if i % 9 == 0 else None, r.gauss(20, 1) if i < 300 or i > 2300 else None])
    for i in range(2005, 2390, 17):
        for j in range(10):
            rows[i + j][3] = rows[i][3]
    for i in range(20, 2400, 31):
        rows[i][3] = -1.0 if i % 2 else 160.0
    for i in range(9 * 30, 9 * 40):
        rows[i][4] = -1.0 if i % 9 == 0 else None
    for i in range(9 * 8, 2400, 9 * 14):
        rows[i][4] = 90.0
    for i in range(9 * 100, 9 * 110, 9):
        rows[i][4] = 50.0
    rows[280][5], rows[297][5], rows[2303][5] = 90.0, 60.0, 70.0
    rows += [x for x in rows[1500:1520] for _ in range(70)] + [[5000 + i, "other", T0 + timedelta(minutes=i), 5.0 + i % 3, None, None] for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id long, run string, ts timestamp_ntz, x double, y double, z double").repartition(5)
    found = lambda **kw: sorted(map(tuple, implausible_readings(df, "run", "ts", "sample_id", [Metric("x"), Metric("y"), Metric("z")], **kw).collect()))
    want = found(piece_rows=10**6)
    monkeypatch.setattr("tessera.operators.spikes.RANGE_ROWS", 500, raising=False)
    assert len({(m, w) for _, m, w in want}) >= 6 and found(piece_rows=64, halo_rows=28) == want


@pytest.mark.parametrize("runs", [[], [[1.0]], [[None, None]], [[5.0, 5.0]]])
def test_spikes_small(spark, runs):
    assert readings(spark, runs) == set()


def test_spike_sources_and_times_may_be_null(spark):
    rows = [(i, None, None if i % 2 else T0 + timedelta(minutes=i), -1.0 if i == 4 else 5.0 + i, 1000.0) for i in range(8)]
    df = spark.createDataFrame(rows, "sample_id long, run string, ts timestamp_ntz, x double, cap double")
    out = implausible_readings(df, "run", "ts", "sample_id", [Metric("x", "cap")])
    assert [(r["sample_id"], r["reason"]) for r in out.collect()] == [(4, "impossible")]
    assert out.where(F.col("metric") != "x").count() == 0


def test_null_times_in_a_long_source(spark):
    rows = [(i, "long", None if i in (7, 500) else T0 + timedelta(minutes=i), -1.0 if i in (7, 900) else 5.0 + i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "sample_id long, run string, ts timestamp_ntz, x double")
    for piece_rows in (64, 10**6):
        found = implausible_readings(df, "run", "ts", "sample_id", [Metric("x")], piece_rows=piece_rows, halo_rows=28)
        assert sorted(r["sample_id"] for r in found.where("reason = 'impossible'").collect()) == [7, 900]


def test_spikes_by_hour_and_in_short_sources(spark):
    """The same jump stands out in a quiet hour and not in a noisy one; a short source needs a wider jump."""
    r = random.Random(21)
    noisy = [r.gauss(100, 12 if i // 60 % 24 == 3 else 1) for i in range(60 * 24 * 2)]
    for at in (60 * 3 + 30, 60 * 12 + 30):
        noisy[at] = 100.0 + 18.0
    by_hour, by_source = (readings(spark, [noisy], rules=Rules(hour_least=least)) for least in (100, 10**9))
    assert (60 * 12 + 30, "spike") in by_hour and (60 * 12 + 30, "spike") in by_source
    assert len({i for i, _ in by_hour if i // 60 % 24 == 3}) < len({i for i, _ in by_source if i // 60 % 24 == 3})
    assert readings(spark, [noisy], rules=Rules(hour_least=100), piece_rows=256, halo_rows=40) == by_hour
    short = [100.0, 101.0, 99.5, 100.5, 300.0, 100.0, 101.0, 99.0, 100.5, 100.0, 99.5, 101.0, 100.0, 100.5, 99.0, 100.0]
    assert readings(spark, [short, [v if v < 200 else 108.0 for v in short]]) == {(4, "spike")}


def excursions_by_hand(x, seg, scatter, rules, course, apart):
    n, p, best = len(x), rules.context, [0.0] * len(x)
    ok = lambda i, s: 0 <= i < n and seg[i] == s and course[i] == course[i]
    for i in range(n):
        for length in range(1, rules.spike + 1):
            inside = list(range(i, i + length))
            if inside[-1] >= n or any(seg[j] != seg[i] or x[j] != x[j] for j in inside):
                continue
            before = [(j - i, course[j]) for j in range(i - p, i) if ok(j, seg[i])]
            after = [(j - i, course[j]) for j in range(i + length, i + length + p) if ok(j, seg[i])]
            if len(before) < 2 or len(after) < 2:
                continue
            slopes = [(b[1] - a[1]) / (b[0] - a[0]) for w in (before, after) for k, a in enumerate(w) for b in w[k + 1 :]]
            for slope in (0.0, median(slopes)):
                b, a = [v - slope * t for t, v in before], [v - slope * t for t, v in after]
                high, low = max(median_high(a), median_high(b)), min(median_low(a), median_low(b))
                rest = [x[j] - slope * (j - i) for j in inside]
                size = max(min(rest) - high, low - max(rest))
                if scatter[i] > 0 and high - low <= max(3 * scatter[i], apart * size):
                    for j in inside:
                        best[j] = max(best[j], size / scatter[i])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_excursions_equal_those_by_hand(seed):
    r = np.random.default_rng(seed)
    n = 120
    x = np.round(r.normal(0, 1, n).cumsum() * (seed % 2) + r.normal(0, 1, n), 2)
    x[r.integers(0, n, 6)] += 20
    seg = np.repeat([1, 2, 3, 4], [3, 60, 17, 40])
    course = x.copy()
    course[r.integers(0, n, 10 * (seed % 3))] = np.nan
    got = excursions(x, seg, np.full(n, 1.3), Rules(), course, 0.2)
    assert np.allclose(got, excursions_by_hand(x.tolist(), seg, [1.3] * n, Rules(), course.tolist(), 0.2))
    assert (got > 6).any()


def test_slow_bumps_are_no_spikes(spark):
    """Up and down again within four readings, but at the rates that this source always has: a triangle wave with one odd tooth."""
    wave = [float(abs(i % 8 - 4)) * 10 + v for i, v in enumerate(noise(400, 31, 0.0, 0.05))]
    assert readings(spark, [[100 + v for v in wave]]) == set()
