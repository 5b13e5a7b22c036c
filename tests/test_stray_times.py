"""Times that can't be: they must neither open a silence of years nor raise alarms."""

import time

from pyspark.sql import functions as F
from sensorlake.streaming import frequency_alarm, streamed_alarm, with_silence
from sensorlake.streaming.live import plausible, stray_rows
from test_silence import EXPECTED, PAUSED, SCHEMA, WANT_PPS, judged, windows

YEARS = 50 * 365 * 8640


def test_two_rows_fifty_years_apart(spark):
    begun = time.time()
    x = with_silence(windows(spark, ("a", "PPS", 0, 10), ("a", "PPS", -YEARS, 10)), kinds=["PPS", "IMU"], most=100)
    rows = frequency_alarm(x, ["device", "kind"], F.lit(1.0), F.lit(0.5), F.lit(3)).orderBy("kind", "window_start").collect()
    assert time.time() - begun < 20 and len(rows) == 2 + 101 + 101
    pps = [r for r in rows if r.kind == "PPS"]
    assert [r.windows for r in pps] == [1] * 101 + [YEARS - 1 - 100] + [1]
    assert [r.in_a_row for r in pps[-3:]] == [100, YEARS - 1, 0] and [r.alarm for r in pps[:4]] == [False, False, False, True]
    imu = [r for r in rows if r.kind == "IMU"]
    assert sum(r.windows for r in imu) == YEARS + 1 and imu[-1].in_a_row == YEARS + 1


def test_silences_up_to_the_limit_have_a_row_each(spark):
    rows = windows(spark, *PAUSED)
    for most in (4, 5, 100):
        x = with_silence(rows, kinds=["PPS", "IMU"], most=most)
        assert x.count() == 20 and x.where("windows <> 1").count() == 0
    assert with_silence(rows, kinds=["PPS", "IMU"], most=3).where("kind = 'PPS'").orderBy("window_start").select("windows").collect()[5][0] == 1
    assert with_silence(rows.limit(0), kinds=["PPS"]).count() == 0


def test_a_stamp_of_the_future_raises_nothing_in_the_stream(spark, tmp_path):
    source = tmp_path / "rates"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    got, stray = {}, 0
    for rows in (PAUSED, [("b", "PPS", 75 * YEARS // 50, 10)], [("b", "PPS", 14, 10)]):
        windows(spark, *rows).coalesce(1).write.mode("append").parquet(str(source))
        q = streamed_alarm(stream, expected=EXPECTED).writeStream.foreachBatch(lambda df, i: got.update(judged(df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        stray += stray_rows(q)
    assert stray == 1 and [got["a", "PPS", w] for w in range(10)] == WANT_PPS
    assert {k[2] for k in got if k[0] == "b"} <= {14} and max(w for _, _, w in got) <= 14


def test_a_long_silence_in_the_stream_is_passed_over(spark, tmp_path):
    source = tmp_path / "rates"
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = {}
    begun = time.time()
    for rows in ([("a", "PPS", -YEARS, 10)], [("a", "PPS", 0, 10), ("a", "IMU", 0, 10)], [("b", "PPS", 9, 10)]):
        windows(spark, *rows).coalesce(1).write.mode("append").parquet(str(source))
        q = streamed_alarm(stream, expected=EXPECTED, most=20).writeStream.foreachBatch(lambda df, i: got.update(judged(df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert time.time() - begun < 60 and len(got) < 100
    assert got["a", "PPS", -YEARS] == (10, 0, False) and got["a", "PPS", -1] == (0, YEARS - 1, True) and got["a", "PPS", 0] == (10, 0, False)


def test_plausible_keeps_nulls_and_old_times(spark):
    x = spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS ts UNION ALL SELECT TIMESTAMP '1970-01-01' UNION ALL SELECT current_timestamp() UNION ALL SELECT TIMESTAMP '2100-01-01'")
    assert plausible(x).count() == 3
    assert plausible(x, behind="1 day").count() == 2
