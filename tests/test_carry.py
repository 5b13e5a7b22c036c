"""The carry from segment to segment in chunks against one pass in order."""

import json
import random

import pytest
from pyspark.sql import functions as F
from sensorlake.operators import carry, unwrap


def sensor(rng, n, size, low):
    if not n:
        return {"n": 0, "first": None, "last": None, "wraps": 0, "low": None, "high": None}
    return {"n": n, "first": rng.randrange(size), "last": rng.randrange(size), "wraps": rng.randrange(2), "low": low, "high": low + rng.randrange(60)}


def some_segments(rng, n, apart, gaps):
    rows = []
    for k in range(n):
        low = rng.randrange(300)
        row = {s: sensor(rng, 0 if rng.random() < gaps else rng.randrange(1, 9), 1000, low + rng.randrange(-apart, apart + 1)) for s in carry.SENSORS}
        counter = sensor(rng, row["imu"]["n"], 50, 0)
        rows.append(row | {"counter": {c: counter[c] for c in ("first", "last", "wraps")}, "segment": k})
    return rows


def in_order(rows, share, size, counter, least, deviation):
    """The rules as they are stated, one segment after the other."""
    before, out = {}, []
    for row in rows:
        start, turned = {}, {}
        for s in carry.NAMES:
            ended, last = before.get(s, (0, None))
            first = row[s]["first"]
            turned[s] = last is not None and first is not None and last - first > share * (counter if s == "counter" else size)
            start[s] = ended + turned[s] * (counter if s == "counter" else size)
        ok = all(max(v) - min(v) <= deviation for v in ([row[s][end] + start[s] for s in carry.SENSORS if row[s]["n"]] for end in ("low", "high")) if v)
        out.append((row["segment"], *start.values(), *turned.values(), ok))
        before = {}
        if ok:
            for s in carry.NAMES:
                if row["imu" if s == "counter" else s]["n"] >= least:
                    before[s] = (start[s] + row[s]["wraps"] * (counter if s == "counter" else size), row[s]["last"])
    return out


@pytest.mark.parametrize("deviation", [0, 300, 1000, 2500, 10**9])
@pytest.mark.parametrize("least", [1, 3, 6])
def test_functions_of_chunks_equal_the_walk(deviation, least):
    rng = random.Random(deviation + least)
    rules = carry.Rules(0.25, 1000, 50, least, deviation)
    refused = 0
    for _ in range(150):
        rows = some_segments(rng, rng.randrange(2, 40), rng.choice([0, 50, 400]), rng.choice([0, 0.1, 0.5]))
        at = rng.randrange(len(rows))
        prior, own = (rows[at - 1] if at else None), rows[at:]
        told = carry.Chunk(rules, prior, own).told()
        refused += len(json.loads(told)[1])
        for _ in range(12):
            base = rng.randrange(-3, 4) * 1000
            state = {s: base + 1000 * rng.choice([0, 0, 0, 1, -1, 5]) for s in rules.hands_on(prior)} if prior and rng.random() < 0.9 else {}
            assert carry.applied(told, state) == rules.walked(state, prior, own)
    assert refused or deviation in (10**9,) or least == 6


SUMMARY = "n long, first long, last long, wraps long, low long, high long"
SCHEMA = "file_id string, segment int, " + ", ".join(f"{s} struct<{', '.join(': '.join(x.split()) for x in SUMMARY.split(', '))}>" for s in carry.SENSORS) + ", counter struct<first: long, last: long, wraps: long>"


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_carry_in_chunks_equals_one_pass(spark, chunk):
    rng = random.Random(chunk)
    files = {f: some_segments(rng, rng.choice([1, 2, 30, 90]), apart, 0.1) for f, apart in zip(["a", "b", "c", None, "e"], [0, 50, 400, 50, 200])}
    rows = [(f, r["segment"], *[r[s] for s in carry.NAMES]) for f, own in files.items() for r in own]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in unwrap.carry_unwrap_state(table, 1000, 50, 3, 1200, chunk).collect():
        got.setdefault(r.file_id, []).append(tuple(r)[1:])
    assert {f: sorted(v) for f, v in got.items()} == {f: in_order(own, 0.25, 1000, 50, 3, 1200) for f, own in files.items()}
    assert unwrap.carry_unwrap_state(table.limit(0), 1000, 50, 3, 1200, chunk).count() == 0


def test_no_task_walks_a_whole_file(spark):
    n = 30_000
    x = spark.range(n).selectExpr("1L as file_id", "cast(id as int) as segment", "'IMU' as kind", "id as offset", "(id * 300) % 1000 as micros_reading", "cast(id % 7 as int) as counter")
    summary = unwrap.carry_summary(x, 1000, 7).cache()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        state = unwrap.carry_unwrap_state(summary, 1000, 7, 1, chunk=500)
        tasks = state.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == n and max(r["count"] for r in tasks) <= n / 3
        last = state.where(F.col("segment") == n - 1).first()
        assert (last.imu_start, last.counter_start) == ((n - 1) * 300 // 1000 * 1000, (n - 1) // 7 * 7)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        summary.unpersist()
