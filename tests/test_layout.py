"""Stored records in buckets of their segments, nearest fixes by blocks of the clock, float outliers in the JVM, gates
counted in the write."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from sensorlake.eventlog import SETTINGS, sensor_log
from sensorlake.operators import clock, outliers, reports, unwrap
from sensorlake.plans import segmented, synchronise, with_steps
from sensorlake.shared import store_by

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log(spark):
    return sensor_log(spark.read.parquet(f"{SF}/events.parquet"))


@pytest.fixture(scope="module")
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_in_buckets_are_not_exchanged_again(spark, log, no_broadcast):
    cut = store_by(segmented(log, SETTINGS), "cut", ["file_id", "segment"], "offset")
    assert cut.count() == log.count() and sorted(cut.columns) == sorted(segmented(log, SETTINGS).columns)
    assert "Exchange" not in plan_of(unwrap.carry_summary(cut, 2**32, 256))
    assert "Exchange" not in plan_of(outliers.flag_outliers(cut, ["acc_x"]))
    state = spark.createDataFrame([], "file_id long, segment int, consistency_ok boolean, " + ", ".join(f"{s}_start bigint, {s}_turned boolean" for s in ("pps", "gnss", "imu", "counter")))
    joined = plan_of(unwrap.apply_carry(cut, state, 2**32, 256))
    assert joined.count("Exchange hashpartitioning") == 1 and "Broadcast" not in joined  # that of the state


def test_whole_run_reads_its_imu_records_without_an_exchange(spark, log, no_broadcast):
    headers = log.select("file_id").distinct().withColumn("acc_sensitivity", F.lit(0.061))
    out = synchronise(log, SETTINGS, headers=headers)
    assert all(out[k].where("acc_sensitivity IS NULL").count() == 0 for k in ("imu", "gnss", "pps"))
    # a small table of the run may be exchanged; the records are read from buckets, those of one kind from its folder
    records = [p for p in plan_of(out["imu"]).split("FileScan parquet")[1:] if "acc_x" in p.split("\n")[0]]
    assert records and all("Bucketed: true" in p.split("\n")[0] and "kind" in p.split("PartitionFilters")[1].split("\n")[0] for p in records)
    assert plan_of(out["imu"].drop("acc_sensitivity")).count("acc_x") > 0
    exchanged = [line for line in plan_of(out["imu"]).split("\n") if "Exchange hashpartitioning(file_id" in line]
    assert len(exchanged) <= 2  # of the kept segments, and of the headers that they are joined with


def test_empty_records(spark, log):
    out = synchronise(log.limit(0), SETTINGS)
    assert all(x.count() == 0 for x in out.values())


def nearest(pulses, fixes):
    out = []
    for f, s, o, m in pulses:
        own = [(abs(g - m), g > m, g, at, u) for (ff, ss, at, g, u) in fixes if (ff, ss) == (f, s) and g is not None] if m is not None else []
        best = min(own, default=None)
        out.append((f, s, o, m, best and best[2], best and best[4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [None, 7, 40, 100_000])
def test_nearest_fixes_against_all_pairs(spark, span):
    rng = np.random.default_rng(11)
    pulses = [(1, 0, k, int(m)) for k, m in enumerate(rng.integers(-500, 500, 150))] + [(2, 0, 5, 10), (3, 1, 9, 8), (3, 1, 10, None)]
    fixes = [(1, 0, 1000 + k, int(m), float(k)) for k, m in enumerate(rng.integers(-400, 300, 60))]
    fixes += [(1, 0, 2000 + k, 250, 0.5 + k) for k in range(5)] + [(3, 1, 1, 900, 7.0), (3, 1, 2, None, 1.0), (4, 0, 1, 3, 1.0)]
    p = spark.createDataFrame(pulses, "file_id long, segment int, offset long, micros_reading_unwrapped long")
    g = spark.createDataFrame(fixes, "file_id long, segment int, offset long, micros_reading_unwrapped long, gnss_utc double")
    got = clock.match_nearest(p, g, span=span)
    assert sorted((tuple(r) for r in got.collect()), key=str) == nearest(pulses, fixes)
    assert clock.match_nearest(p.limit(0), g, span=span).count() == 0
    assert clock.match_nearest(p, g.limit(0), span=span).where("gnss_micros IS NULL").count() == len(pulses)


def test_a_hot_segment_is_split_and_sorted_once(spark):
    rows = spark.range(40_000).selectExpr("1L as file_id", "0 as segment", "id as offset", "id * 1000 as micros_reading_unwrapped", "id / 1000 as gnss_utc")
    got = clock.match_nearest(rows.where("offset % 3 = 0"), rows.where("offset % 3 = 1"), span=1_000_000)
    assert got.where("gnss_micros = micros + 1000").count() == got.count() - 1 == 13_333  # after the last pulse there is no fix
    big = [line for line in plan_of(got).split("\n") if "Sort [" in line and "micros" in line and "offset" in line]
    assert len(big) == 1, big
    # no block sees more than its own rows and two fixes
    both = got.withColumn("b", F.floor(F.col("micros") / 1_000_000)).groupBy("b").count()
    assert both.agg(F.max("count")).first()[0] <= 334


def test_float_outliers_stay_in_the_jvm(spark):
    rng = np.random.default_rng(5)
    series = {f: rng.normal(size=n).round(3) for f, n in enumerate([1, 6, 7, 30, 150])}
    series[3][[0, 4, 29]], series[4][[7, 70]] = (40.0, np.inf, -40.0), (np.nan, 90.0)
    series[5], series[6] = np.full(12, 2.5), np.append(np.full(11, 2.5), 2.6)
    series[7] = np.full(9, 1e308)
    rows = spark.createDataFrame([(f, i, float(v), 1) for f, x in series.items() for i, v in enumerate(x)], "file_id long, offset long, v double, segment int")
    for neighbours in (2, 6, 9):
        got = outliers.flag_float_outliers(rows, ["v"], neighbours, 3.0, block=16)
        assert "Python" not in plan_of(got) and got.columns == [*rows.columns, "v_stdchecked"]
        flagged = {(r.file_id, r.offset) for r in got.where("v_stdchecked").collect()}
        assert flagged == {(f, i) for f, x in series.items() for i in np.flatnonzero(outliers.float_outliers(x, neighbours, 3.0)).tolist()}
    nulls = spark.createDataFrame([(1, 0, k, None if k == 3 else 1.0) for k in range(9)], "file_id long, segment int, offset long, v float")
    assert [r.offset for r in outliers.flag_float_outliers(nulls, ["v"]).where("v_stdchecked").collect()] == [3]
    assert outliers.flag_float_outliers(nulls.limit(0), ["v"]).count() == 0


def test_gates_come_with_the_write(spark, log, tmp_path):
    late = with_steps(unwrap.unwrap_counter(segmented(log, SETTINGS), "micros_reading", 2**32)).withColumn("utc", F.when(F.col("counter") % 50 > 0, F.col("offset") / 1e6))
    rule = F.col("acc_x") % 20 == 0
    watched, seen = reports.observe_gates(late, "utc", rule, 256, 1.7045e9)
    watched.write.parquet(str(tmp_path / "t"))
    names = ["n", "null_utc", "old_utc", "counter_breaks", "backward_steps", "outlier_rows"]
    per_file = reports.quality_gates(late, "utc", rule, 256, 1.7045e9)
    assert [seen.get[c] for c in names] == list(per_file.agg(*[F.sum(c) for c in names]).first())
    assert seen.get["imu_rows"] == log.where("kind = 'IMU'").count() and not reports.gates_passed(seen.get)
    fine = dict.fromkeys(("null_utc", "old_utc", "counter_breaks", "backward_steps"), 0) | {"imu_rows": 100}
    assert [reports.gates_passed(fine | {"outlier_rows": k}) for k in (0, 1, 9, 10)] == [False, True, True, False]


def test_windows_over_segments_need_no_more_keys(spark, log):
    cut = store_by(segmented(log, SETTINGS), "cut", ["file_id", "segment"], "offset", ("kind",), 3)
    again = store_by(cut, "again", ["file_id", "segment"], "offset", buckets=3, laid_out=True)
    w = Window.partitionBy("file_id", "segment", "kind").orderBy("offset")
    assert "Exchange" not in plan_of(again.withColumn("k", F.row_number().over(w)))
    count = lambda x: sorted(map(tuple, x.groupBy("kind").count().collect()))
    assert count(again) == count(cut) == count(log)
