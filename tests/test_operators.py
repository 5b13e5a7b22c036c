import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sensorlake.operators import clock, outliers, reports, segments, series, unwrap

M = 2**32


def frame(spark, values, **more):
    rows = [(1, 0, "IMU", i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "file_id long, segment int, kind string, offset long, value long")


@pytest.mark.parametrize(
    "values, size, threshold, want, wraps, jumps",
    [
        ([1000, 2000, 3000, 4000], M, 0.1 * M, [1000, 2000, 3000, 4000], [], []),
        ([M - 1000, M - 500, 100, 500], M, 0.1 * M, [M - 1000, M - 500, M + 100, M + 500], [2], []),
        ([1000, 2000, 3000, 2500, 4000], M, 0.1 * M, [1000, 2000, 3000, 2500, 4000], [], [3]),
        ([1000, 2000, 3000, 3000 + M // 10 + 1000], M, 0.1 * M, [1000, 2000, 3000, 3000 + M // 10 + 1000], [], [3]),
        ([65534, 65535, 0, 1, 3, 4], 2**16, 1, [65534, 65535, 65536, 65537, 65539, 65540], [2], [4]),
        ([], M, 1, [], [], []),
    ],
)
def test_unwrap(spark, values, size, threshold, want, wraps, jumps):
    x = unwrap.unwrap_counter(frame(spark, values), "value", size)
    assert [r.value_unwrapped for r in x.orderBy("offset").collect()] == want
    assert [r["index"] for r in unwrap.wrap_events(x, "value").collect()] == wraps
    assert [r["index"] for r in unwrap.jump_events(x, "value", threshold).collect()] == jumps


def carry_model(files, turn, least, deviation):
    """Segment after segment, as one would by hand."""
    out = {}
    for f, segs in files.items():
        off, prev = dict.fromkeys("PGI", 0), dict.fromkeys("PGI")
        for s, kinds in enumerate(segs):
            if not any(kinds.values()):
                continue
            start, un = {}, {}
            for k, v in kinds.items():
                o, p, u = off[k], prev[k], []
                if v and p is not None and p - v[0] > 0.25 * turn:
                    o += turn
                start[k] = o
                for a in v:
                    if u and p - a > 0.25 * turn:
                        o += turn
                    u.append(a + o)
                    p = a
                off[k], prev[k], un[k] = o, p, u
            known = [u for u in un.values() if u]
            ok = len(known) < 2 or max(max(map(min, known)) - min(map(min, known)), max(map(max, known)) - min(map(max, known))) <= deviation
            for k, v in kinds.items():
                if len(v) < least or not ok:
                    off[k], prev[k] = 0, None
            out[f, s] = (start["P"], start["G"], start["I"], ok)
    return out


def test_carry_against_a_sequential_model(spark):
    rng = random.Random(11)
    files = {f: [{k: [rng.randrange(1000) for _ in range(rng.choice([0, 1, 2, 3, 5]))] for k in "PGI"} for _ in range(rng.randint(1, 7))] for f in range(120)}
    rows, n = [], 0
    for f, segs in files.items():
        for s, kinds in enumerate(segs):
            for k, v in kinds.items():
                for a in v:
                    n += 1
                    rows.append((f, s, {"P": "PPS", "G": "GNSS", "I": "IMU"}[k], n, a, 0))
    log = spark.createDataFrame(rows, "file_id long, segment int, kind string, offset long, micros_reading long, counter int")
    got = unwrap.carry_unwrap_state(unwrap.carry_summary(log, 1000, 256), 1000, 256, 2, 900).collect()
    assert {(r.file_id, r.segment): (r.pps_start, r.gnss_start, r.imu_start, r.consistency_ok) for r in got} == carry_model(files, 1000, 2, 900)


def test_counter_over_segments(spark):
    rows = [(1, s, "IMU", 10 * s + i, v, v) for s, seg in enumerate([[700, 800, 900], [10, 100, 200], [250, 300, 350]]) for i, v in enumerate(seg)]
    log = spark.createDataFrame(rows, "file_id long, segment int, kind string, offset long, micros_reading long, counter int")
    state = unwrap.carry_unwrap_state(unwrap.carry_summary(log, 1000, 1000), 1000, 1000, 3)
    x = unwrap.apply_carry(log, state, 1000, 1000)
    assert [r.micros_reading_unwrapped for r in x.orderBy("offset").collect()] == [700, 800, 900, 1010, 1100, 1200, 1250, 1300, 1350]
    assert [(r.segment, r["index"]) for r in unwrap.wrap_events(x, "micros_reading").collect()] == [(1, 0)]


def segment_model(kinds, micros, per, limit):
    out, seg, n, prev = [], 0, 0, None
    for k, m in zip(kinds, micros):
        if n >= per:
            seg, n, prev = seg + 1, 0, None
        if k == "IMU":
            if prev is not None and (m - prev < 0 or m - prev > limit):
                seg, n = seg + 1, 0
            n, prev = n + 1, m
        out.append(seg)
    return out


def test_segments_against_a_sequential_model(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for f in range(150):
        n = rng.randint(1, 40)
        kinds = [rng.choice(["IMU", "IMU", "IMU", "PPS", "GNSS"]) for _ in range(n)]
        micros = np.cumsum([rng.choice([1, 1, 1, 1, 50, -5]) for _ in range(n)]).tolist()
        rows += [(f, k, i, m) for i, (k, m) in enumerate(zip(kinds, micros))]
        want[f] = segment_model(kinds, micros, 4, 20)
    log = spark.createDataFrame(rows, "file_id long, kind string, offset long, micros_reading long")
    got = {}
    for r in segments.assign_segments(log, 4, 20).orderBy("file_id", "offset").collect():
        got.setdefault(r.file_id, []).append(r.segment)
    assert got == want


def outlier_model(values, n, sigma):
    out = []
    for i, x in enumerate(values):
        if not np.isfinite(x):
            out.append(True)
            continue
        if len(values) < n + 1:
            out.append(False)
            continue
        a = 0 if i < n // 2 else len(values) - n - 1 if i >= len(values) - n // 2 else i - n // 2
        near = [values[j] for j in range(a, a + n + 1) if j != i and np.isfinite(values[j])]
        sd = np.std(near, ddof=1) if len(near) > 1 else 0
        out.append(len(near) > 1 and bool(abs(x - np.mean(near)) > sigma * sd if sd > 0 else abs(x - np.mean(near)) > 0))
    return out


def test_integer_outliers(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for f in range(60):
        v = (rng.normal(0, 3, rng.integers(1, 40)) + (rng.random() < 0.5) * 2**31 - (rng.random() < 0.3) * 2**30).astype(int)
        v[rng.random(len(v)) < 0.1] += rng.integers(-500, 500)
        rows += [(f, 0, i, int(x)) for i, x in enumerate(v)]
        want[f] = outlier_model(v - v.min(), 6, 5) if len(v) > 4 else [False] * len(v)
    got = {}
    for r in outliers.flag_outliers(spark.createDataFrame(rows, "file_id long, segment int, offset long, v long"), ["v"]).orderBy("file_id", "offset").collect():
        got.setdefault(r.file_id, []).append(r.v_stdchecked)
    assert got == want


def test_outliers_of_narrow_and_wide_series_with_nulls(spark):
    """In 64 bits and in decimals; two columns share one sort."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for f, top in enumerate([1, 7, 3000, 65_535, 2**31, 2**32] * 3):
        n = int(rng.integers(7, 30))
        v = [int(x) for x in rng.integers(0, 4, n)]
        v[int(rng.integers(0, n))] = top
        v[int(rng.integers(0, n))] = 0
        missing = rng.random(n) < 0.15
        rows += [(f, 0, i, None if missing[i] else x - 2**31) for i, x in enumerate(v)]
        want[f] = outlier_model([np.nan if missing[i] else float(x) for i, x in enumerate(v)], 6, 5)
    x = spark.createDataFrame(rows, "file_id long, segment int, offset long, v long")
    out = outliers.flag_outliers(x.selectExpr("*", "v as w"), ["v", "w"])
    got, small = {}, {}
    narrow = x.where("file_id % 6 < 4").selectExpr("file_id", "segment", "offset", "cast(v + 2147483648 - 32768 as short) as v")
    for r in outliers.flag_outliers(narrow, ["v"]).orderBy("file_id", "offset").collect():
        small.setdefault(r.file_id, []).append(r.v_stdchecked)
    assert small == {f: w for f, w in want.items() if f % 6 < 4}
    for r in out.orderBy("file_id", "offset").collect():
        assert r.v_stdchecked == r.w_stdchecked
        got.setdefault(r.file_id, []).append(r.v_stdchecked)
    assert got == want and out.columns == ["file_id", "segment", "offset", "v", "w", "v_stdchecked", "w_stdchecked"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def series_of(name):
    rng = np.random.default_rng(42)
    x = {"sine": np.sin(np.arange(100) / 10), "spikes": np.ones(100), "ends": np.ones(50), "nan": np.ones(50), "normal": rng.normal(1000, 10, 5000), "short": np.arange(5.0), "linear": np.arange(40.0)}[name]
    for at, v in {"spikes": {25: 100, 75: -100}, "ends": {0: 50, 49: 50}, "nan": {10: np.nan, 25: np.inf, 30: 7}, "normal": {1000: 5000, 2500: -4000, 4000: 9000}}.get(name, {}).items():
        x[at] = v
    return x


@pytest.mark.parametrize("name, must", [("sine", set()), ("spikes", {25, 75}), ("ends", {0, 49}), ("nan", {10, 25, 30}), ("normal", {1000, 2500, 4000}), ("short", set()), ("linear", set())])
def test_float_outliers(spark, name, must):
    x = series_of(name)
    got = outliers.float_outliers(x, 6, 5.0)
    assert got.tolist() == outlier_model(x, 6, 5.0)
    found = set(np.flatnonzero(got).tolist())
    assert must <= found and len(found) < 50
    if name in ("sine", "spikes"):
        assert found == must
    if name == "spikes":
        rows = spark.createDataFrame([(1, 0, i, float(v)) for i, v in enumerate(x)], "file_id long, segment int, offset long, v double")
        out = outliers.flag_float_outliers(rows, ["v"]).where("v_stdchecked").select("offset").collect()
        assert {r.offset for r in out} == must


def test_clock_fit(spark):
    rows = [(1, 0, k, i, 1_000_000 * (i + 1), 1_000_000 * (i + 1), i + 1, 0) for i in range(3) for k in ("PPS", "GNSS")]
    log = spark.createDataFrame(rows, "file_id long, segment int, kind string, offset long, micros_reading long, micros_reading_unwrapped long, posix_timestamp int, microseconds long")
    fixes = log.where("kind = 'GNSS'").withColumn("gnss_utc", F.col("posix_timestamp") + F.col("microseconds") / 1e6)
    pairs = clock.filter_pairs(clock.pulse_utc_second(clock.match_nearest(log.where("kind = 'PPS'"), fixes)))
    r = clock.fit_clock(pairs).first()
    assert abs(r.slope - 1e-6) < 1e-12 and abs(r.intercept) < 1e-6 and r.r_squared > 0.999
    one = clock.fit_clock(pairs.limit(1)).first()
    assert one.slope is None and one.n_pairs == 1


def test_pair_filter_drops_the_ends_of_clean_pulses(spark):
    rows = [(1, 0, i, 1_000_000 * i, 1_700_000_000 + i) for i in range(10)]
    pairs = clock.filter_pairs(spark.createDataFrame(rows, "file_id long, segment int, offset long, micros long, utc_second long"))
    assert [r.used for r in pairs.orderBy("offset").collect()] == [False, *[True] * 8, False]


B, S = 10**9, 10**6


@pytest.mark.parametrize(
    "p, g, i, ok",
    [
        ([B, B + S], [B + S // 10], [B + S // 20, B + S // 2], True),
        ([B], [B + 15 * S], [B + 14_500_000], False),
        ([B, B + 20 * S], [B + 5 * S], [B + 4 * S], False),
        ([], [], [B], True),
        ([B], [B + 10 * S], [B + 5 * S], True),
        ([B], [B + 10_001_000], [B + 5 * S], False),
        ([B, None], [B + S // 2], [], True),
    ],
)
def test_consistency(spark, p, g, i, ok):
    rows = [(1, 0, k, v) for k, vs in (("PPS", p), ("GNSS", g), ("IMU", i)) for v in vs]
    x = spark.createDataFrame(rows, "file_id long, segment int, kind string, micros_reading_unwrapped long")
    assert clock.check_clock_consistency(x).first().consistency_ok is ok


def test_means_limits_and_pulses(spark):
    rows = [(1, v) for v in (10, 11, 12, 11, 10, 500)] + [(2, 7), (2, 7)] + [(3, v) for v in (-5, -6, -6, -5, -5, -6, -5, -90)]
    x = spark.createDataFrame(rows, "k long, v long")
    assert {r.k: r.mean for r in outliers.sigma_filtered_mean(x, ["k"], "v").collect()} == {1: 10, 2: 7, 3: -5}
    lim = reports.value_limits(spark.createDataFrame([(1, 0.0, False), (1, 10.0, False), (1, 99.0, True), (2, 5.0, True), (3, 0.0, False), (4, None, False)], "k long, v double, f boolean"), ["k"], "v", "f")
    assert {r.k: (round(r.lower, 6), round(r.upper, 6)) for r in lim.collect()} == {1: (-1.0, 11.0), 2: (4.5, 5.5), 3: (-1.0, 1.0), 4: (0.0, 1.0)}
    p = spark.createDataFrame([(1, i, m) for i, m in enumerate([600_000, 700_000, 1_300_000, 100])], "file_id long, offset long, micros_reading long")
    assert [r.kept for r in series.debounce_pulses(p).orderBy("offset").collect()] == [True, False, True, True]
