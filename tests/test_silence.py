"""Sensors that fall silent."""

from pyspark.sql import functions as F
from sensorlake.streaming import frequency_alarm, live_rates, rows_too_late, saturation_alarm, streamed_alarm, streamed_saturation, with_silence

SCHEMA = "device string, kind string, window_start timestamp, n long, rate_hz double"
BASE = 177_055_920
EXPECTED = {"PPS": (1.0, 0.5, 3), "IMU": (1.0, 0.5, 3)}


def windows(spark, *rows):
    made = [(d, k, 10 * (BASE + w), n, n / 10) for d, k, w, n in rows]
    return spark.createDataFrame(made, "device string, kind string, w long, n long, rate_hz double").select("device", "kind", F.timestamp_seconds("w").alias("window_start"), "n", "rate_hz")


def judged(rows):
    return {(r.device, r.kind, int(r.window_start.timestamp()) // 10 - BASE): (r.n, r.in_a_row, r.alarm) for r in rows}


#: PPS pauses in windows 2 to 5 and dies after 6, while IMU goes on to 9.
PAUSED = [("a", "PPS", w, 10) for w in (0, 1, 6)] + [("a", "IMU", w, 10) for w in range(10)]
WANT_PPS = [(10, 0, False), (10, 0, False), (0, 1, False), (0, 2, False), (0, 3, True), (0, 4, True), (10, 0, False), (0, 1, False), (0, 2, False), (0, 3, True)]


def test_silent_windows_in_batch(spark):
    x = with_silence(windows(spark, *PAUSED, ("b", "IMU", 3, 10), (None, "PPS", 2, 10)), kinds=["PPS", "IMU"])
    got = judged(frequency_alarm(x, ["device", "kind"], F.lit(1.0), F.lit(0.5), F.lit(3)).collect())
    assert [got["a", "PPS", w] for w in range(10)] == WANT_PPS
    assert [got["a", "IMU", w] for w in range(10)] == [(10, 0, False)] * 10
    assert {k: v for k, v in got.items() if k[0] != "a"} == {("b", "IMU", 3): (10, 0, False), ("b", "PPS", 3): (0, 1, False), (None, "PPS", 2): (10, 0, False), (None, "IMU", 2): (0, 1, False)}
    assert with_silence(windows(spark, ("b", "IMU", 3, 10), ("b", "IMU", 5, 10))).count() == 3


def test_silent_windows_in_the_stream(spark, tmp_path):
    source = tmp_path / "rates"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = {}
    # a dies after window 9; b is heard at 13, 17 and never sends IMU
    # a kind that isn't expected
    for rows in (PAUSED[:9], PAUSED[9:] + [("a", "TEMP", 4, 1)], [("b", "PPS", 13, 10)], [("b", "PPS", 17, 10)]):
        windows(spark, *rows).coalesce(1).write.mode("append").parquet(str(source))
        q = streamed_alarm(stream, expected=EXPECTED).writeStream.foreachBatch(lambda df, i: got.update(judged(df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [got["a", "PPS", w] for w in range(10)] == WANT_PPS
    # the watermark came to window 14
    assert [got["a", "PPS", w] for w in range(10, 15)] == [(0, w - 6, True) for w in range(10, 15)]
    assert [got["a", "IMU", w] for w in range(10, 15)] == [(0, w - 9, w >= 12) for w in range(10, 15)]
    assert got["b", "PPS", 13] == (10, 0, False) and got["b", "IMU", 14] == (0, 2, False)
    assert max(w for _, _, w in got) == 14 and len(got) == 2 * 15 + 2 * 2


def test_saturation_in_the_stream(spark, tmp_path):
    source = tmp_path / "writes"
    source.mkdir()
    schema = "device string, window_start timestamp, write_ms double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    busy = {w: 9000.0 if w in (1, 2, 3, 6, 7, 8, 9) else None if w == 4 else 100.0 for w in range(20)}
    got = {}
    # windows come out of order within what the watermark allows
    for order in ([0, 2, 1], [4, 3, 5], [7, 6, 9, 8], [12, 15], [19]):
        rows = spark.createDataFrame([("a", 10 * (BASE + w), busy[w]) for w in order], "device string, w long, write_ms double")
        rows.select("device", F.timestamp_seconds("w").alias("window_start"), "write_ms").coalesce(1).write.mode("append").parquet(str(source))
        q = streamed_saturation(stream, rows=3).writeStream.foreachBatch(lambda df, i: got.update({int(r.window_start.timestamp()) // 10 - BASE: (r.in_a_row, r.alarm) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    batch = spark.createDataFrame([("a", w, busy[w] or -1.0) for w in (*range(10), 12, 15)], "device string, window_start long, write_ms double")
    want = {r.window_start: (r.in_a_row, r.alarm) for r in saturation_alarm(batch, ["device"], rows=3).collect()}
    assert got == want and got[3] == (3, True) and got[5] == (0, False)


def test_late_records_are_dropped_and_counted(spark, tmp_path):
    source = tmp_path / "records"
    source.mkdir()
    stream = spark.readStream.schema("device string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    counts, late = {}, 0
    # 40 seconds in order, one record 20 seconds late, one 5 minutes late, and what moves the watermark on
    for seconds in ([0, 5, 12, 40], [20], [400], [100], [800]):
        rows = spark.createDataFrame([("a", "PPS", 10 * BASE + s) for s in seconds], "device string, kind string, s long")
        rows.select("device", "kind", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(source))
        q = live_rates(stream).writeStream.foreachBatch(lambda df, i: counts.update({int(r.window_start.timestamp()) - 10 * BASE: r.n for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        late += rows_too_late(q)
    assert counts == {0: 2, 10: 1, 20: 1, 40: 1, 400: 1} and late == 1
