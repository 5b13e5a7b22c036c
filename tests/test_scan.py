"""Files of any length: blocks of offsets give what one pass over each file gives."""

import random

import pytest
from pyspark.sql import functions as F
from sensorlake.operators import segments, series, unwrap

SCHEMA = "file_id long, offset long, kind string, micros_reading long, utc double, file_rows long"


def log(seed, files=4, n=120):
    rng = random.Random(seed)
    rows = []
    for f in [*range(files), None]:
        clock, at = 0, 0
        for _ in range(rng.randrange(0, n)):
            at += rng.choice([1, 2, 40, 500])
            clock = rng.randrange(3000) if rng.random() < 0.06 else clock + rng.choice([1, 5, 90, 150])
            kind = rng.choice(["IMU", "IMU", "IMU", "PPS", "GNSS"])
            rows.append((f, at, kind, None if rng.random() < 0.02 and kind != "IMU" else clock, rng.random(), 2 + (f or 0)))
    return rows


def plain_segments(rows, limit, of_file):
    """One record after the other."""
    out = {}
    for f in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == f) if f is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        prev, segment, n = None, 0, 0
        for _, at, kind, clock, _, size in own:
            size = size if of_file else 3
            jump = kind == "IMU" and prev is not None and (clock < prev or clock - prev > limit)
            if kind == "IMU":
                if jump or n == size:
                    segment, n = segment + 1, 0
                n, prev = n + 1, clock
            out[f, at] = (segment + (kind != "IMU" and n == size), jump, n > 0 and n == size)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("span", [1, 7, 300, 4000, None])
def test_segments_over_blocks(spark, seed, span):
    rows = log(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for of_file in (True, False):
        size = F.col("file_rows") if of_file else 3
        got = {(r.file_id, r.offset): (r.segment, r.imu_jump, r.imu_filled) for r in segments.assign_segments(table, size, 100, span).collect()}
        want = plain_segments(rows, 100, of_file)
        assert got == want
    assert {(r.file_id, r.offset): r.imu_jump for r in segments.flag_imu_jumps(table, 100, span or 10**9).collect()} == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("span", [1, 60, 10**9])
def test_series_over_blocks(spark, span):
    rows = [(r[0], r[1], r[2], r[3] or 0, *r[4:]) for r in log(5)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault((r[0], r[2]), []).append(r)
    at = lambda df, c: {(r.file_id, r.offset): r[c] for r in df.collect()}
    want = {(r[0], r[1]): (k / len(own), r[4] - own[0][4], None if k == 0 else (r[3] - own[k - 1][3]) * 1000 / 1e6) for own in groups.values() for k, r in enumerate(own)}
    assert at(series.normalized_index(table, span), "normalized_index") == {k: v[0] for k, v in want.items()}
    assert at(series.relative_time(table, "utc", span), "relative_time") == {k: v[1] for k, v in want.items()}
    assert at(series.consecutive_dt(table, "utc", span=span), "dt_raw_ms") == {k: v[2] for k, v in want.items()}
    pulses = table.where("kind = 'PPS'")
    kept = {(r[0], r[1]): (r[3] - (own[k - 1][3] if k else 0)) % 2**32 >= 20 for (_, kind), own in groups.items() if kind == "PPS" for k, r in enumerate(own)}
    assert at(series.debounce_pulses(pulses, 20, span=span), "kept") == kept
    gaps = {(r[0], r[1]): r[3] - own[k - 1][3] for (_, kind), own in groups.items() if kind == "PPS" for k, r in enumerate(own) if k and r[3] - own[k - 1][3] != 1}
    assert at(series.counter_gaps(pulses, "micros_reading", span=span), "step") == gaps


@pytest.mark.parametrize("span", [1, 60, 500, 10**9])
def test_unwrapping_over_blocks(spark, span):
    rows = [(r[0], r[1], r[2], (r[3] or 0) % 1000, *r[4:]) for r in log(6)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("segment", F.lit(0))
    columns = ["file_id", "offset", "micros_reading_unwrapped", "micros_reading_wrap"]
    whole = unwrap.unwrap_counter(table, "micros_reading", 1000).select(*columns).collect()
    assert any(r.micros_reading_wrap for r in whole)
    assert sorted(map(str, unwrap.unwrap_counter(table, "micros_reading", 1000, span=span).select(*columns).collect())) == sorted(map(str, whole))


def test_a_file_of_half_of_all_rows_is_spread(spark):
    hot = spark.range(40_000).selectExpr("7L as file_id", "id * 24 as offset", "'IMU' as kind", "id as micros_reading", "cast(id as double) as utc", "100L as file_rows")
    cold = spark.range(40_000).selectExpr("id % 800 + 100 as file_id", "id div 800 * 24 as offset", "'IMU' as kind", "id as micros_reading", "cast(id as double) as utc", "100L as file_rows")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        cut, steps = segments.assign_segments(hot.union(cold), F.col("file_rows"), 10**6, 24 * 500), series.consecutive_dt(hot.union(cold), "utc", span=24 * 500)
        for out, made in ((cut, "segment"), (steps, "dt_raw_ms")):
            sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(made)).collect()]
            assert sum(sizes) == 80_000 and max(sizes) < 80_000 / 8
        assert segments.assign_segments(hot, F.col("file_rows"), 10**6, 24 * 500).agg(F.max("segment")).first()[0] == 399
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_records_are_shuffled_and_sorted_once(spark):
    table = spark.createDataFrame(log(1), SCHEMA)
    plan = segments.assign_segments(table, 3, span=500)._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("== Initial Plan ==")[-1]
    full = [line for line in tree.splitlines() if "Exchange" in line and "utc" in line]
    assert tree.count("Sort [file_id") <= 4 and "BroadcastNestedLoopJoin" not in tree and not full


def test_head_and_tail_without_gathering_files(spark):
    rows = [(f, k, "IMU", k, 0.0, 0) for f, n in enumerate([0, 1, 3, 5, 6, 9, 50]) for k in range(n)] + [(9, 1, "PPS", 1, 0.0, 0)] * 2
    table = spark.createDataFrame(rows, SCHEMA)
    out = series.head_tail_sample(table, 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    got = sorted((r.file_id, r.kind, r.offset, r.place) for r in out.collect())
    want = []
    for key in sorted({(r[0], r[2]) for r in rows}):
        own = sorted(r[1] for r in rows if (r[0], r[2]) == key)
        for k, at in enumerate(own):
            head, tail = k < 3, len(own) - k <= 3
            if head or tail:
                want.append((*key, at, "both" if head and tail else "head" if head else "tail"))
    assert got == sorted(want)
