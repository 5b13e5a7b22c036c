"""Whole runs: raw files to tables, streams, and the queries against their SQL."""

import os

import duckdb
import pytest
from frames_model import FOOTER, HEADER, gnss, imu, pps
from pyspark.sql import functions as F
from sensorlake import queries as own
from sensorlake.plans import Settings, decode_and_synchronise
from sensorlake.sources import read_log_files, read_tables, write_tables
from sensorlake.streaming import ingest_stream, live_rates, streamed_alarm

UTC = 1_770_559_200


def recording(seconds=60, start=2**32 - 20_000_000):
    """Pulses each second, fixes at 10 Hz, IMU at 20 Hz; the clock turns after 20 seconds. One spike."""
    frames = []
    for t in range(seconds):
        m = (start + 1_000_000 * t) % 2**32
        frames.append(pps(m))
        for k in range(20):
            u = (m + 50_000 * k + 5_000) % 2**32
            n = 20 * t + k
            frames.append(imu(u, n % 65536, (4000 if n == 500 else n % 3, n % 4, 16000 + n % 2), (n % 2, n % 3, n % 5)))
            if k % 2 == 0:
                frames.append(gnss((m + 50_000 * k + 20_000) % 2**32, posix=UTC + t, us=50_000 * k + 20_000))
    return HEADER.replace(b"417.00", b"20.00") + b"".join(frames) + FOOTER


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lake")
    (folder / "DATA_BOOT_000007_TIME_20260208T140000.dat").write_bytes(recording())
    (folder / "DATA_BOOT_000008_TIME_20260208T141500.dat").write_bytes(recording(30, 5_000_000) + b"x" * 100)
    return f"file://{folder}"


def test_raw_files_to_tables(spark, lake, tmp_path):
    tables = decode_and_synchronise(read_log_files(spark, lake), Settings(rows_per_segment=400))
    write_tables({k: tables[k] for k in ("pps", "gnss", "imu", "segments")}, str(tmp_path / "out"))
    back = read_tables(spark, str(tmp_path / "out"), ["pps", "imu", "segments"])
    imu_rows = back["imu"]
    assert imu_rows.groupBy("boot_id").count().orderBy("boot_id").collect() == [(7, 1200), (8, 600)]
    assert imu_rows.where("utc_timestamp_from_pps_regression is null").count() == 0
    first = imu_rows.where("boot_id = 7").orderBy("offset").first()
    assert abs(first.utc_timestamp_from_pps_regression - (UTC + 0.005)) < 1e-3 and abs(first.acc_z_mg - 16000 * 0.061) < 1e-6
    assert [(r.boot_id, r.offset > 0) for r in imu_rows.where("acc_x_stdchecked").collect()] == [(7, True), (8, True)]
    graded = {(r.segment, r.n_imu): r for r in tables["segments"].collect()}
    assert all(r.keep and r.r_squared > 0.999999 and r.max_mismatch < 0.005 for r in graded.values())
    steps = imu_rows.selectExpr("boot_id", "micros_reading_unwrapped - lag(micros_reading_unwrapped) over (partition by boot_id order by offset) as d")
    assert steps.where("d <= 0").count() == 0
    files = tables["files"].orderBy("boot_id").collect()
    assert [(f.boot_id, f.imu_odr, f.status) for f in files] == [(7, 20.0, "complete"), (8, 20.0, "complete")]


def test_one_shuffle_for_segmentation(spark):
    log = spark.createDataFrame([(1, "IMU", 0, 5)], "file_id long, kind string, offset long, micros_reading long")
    from sensorlake.operators import segments

    plan = segments.assign_segments(log, 4, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_ingest_stream(spark, lake, tmp_path):
    seen = []
    q = ingest_stream(spark, lake, lambda df, i: seen.extend(df.groupBy("kind").count().collect()), str(tmp_path / "cp"), files_per_trigger=1)
    q.awaitTermination()
    n = {}
    for kind, count in seen:
        n[kind] = n.get(kind, 0) + count
    assert n == {"IMU": 1800, "GNSS": 900, "PPS": 90, "FILE": 2}


def test_live_rates_and_alarm(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", "PPS", f"2026-02-08 14:00:{s:02d}") for s in range(0, 60, 4)] + [("a", "PPS", "2026-02-08 14:10:00")]
    spark.createDataFrame(rows, "device string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("device string, kind string, ts timestamp").parquet(str(src))
    rates = live_rates(stream).writeStream.format("parquet").option("path", str(tmp_path / "rates")).option("checkpointLocation", str(tmp_path / "cp0")).trigger(availableNow=True).start()
    rates.awaitTermination()
    finished = spark.readStream.schema("device string, kind string, window_start timestamp, n long, rate_hz double").parquet(str(tmp_path / "rates"))
    alarms = streamed_alarm(finished, expected={"PPS": (1.0, 0.5, 3)})
    q = alarms.writeStream.format("memory").queryName("alarms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("alarms").orderBy("window_start").collect()
    assert [r.in_a_row for r in got] == [1, 2, 3, 4, 5, 6] and [r.alarm for r in got] == [False, False, True, True, True, True]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, other: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    from sensorlake.shared import shared_dir

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query_against_its_sql(spark, name):
    got = own.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    sql = own.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    found = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in sorted(got.columns))} FROM ({sql})").fetchall()
    text = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(text, r)) for r in rows) == sorted(tuple(map(text, r)) for r in found)
