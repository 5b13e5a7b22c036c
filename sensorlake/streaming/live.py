"""Ingest of files as they appear; rates per window; alarms after several bad windows in a row.

Every job also takes a batch, so that a day can be judged again. Frames come in the order in which they were written,
up to 20 seconds late, so windows wait 30 seconds by default.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import decode_frames

#: Fixed values of the device: expected Hz, tolerance, and bad windows in a row that raise an alarm.
EXPECTED = {"IMU": (417.0, 0.30, 5), "GNSS": (10.0, 0.50, 45), "PPS": (1.0, 0.50, 45)}
SATURATION_MS, SATURATION_ROWS = 8000, 6
WINDOW, LATE = "10 seconds", "30 seconds"
#: How far a record's time may lie after its arrival, and windows of a silence that have a row each (a day of 10 seconds).
AHEAD, SILENT = "1 hour", 8640
RAW = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_trigger: int = 64, glob: str = "DATA_*.dat"):
    """A started query that decodes new raw files below ``path``, a bounded number at a time, and hands the frames of
    each batch to ``sink``. All state of the later stages is within a file, so a batch is complete in itself."""
    raw = spark.readStream.format("binaryFile").schema(RAW).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    frames = decode_frames(raw.withColumn("file_id", F.xxhash64("path")))
    return frames.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_time(records: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Records with a watermark, so that windows end; later ones are dropped and counted by the query's progress as
    numRowsDroppedByWatermark. On a batch nothing is late."""
    return records.withWatermark(ts, late)


def windowed_rates(records: DataFrame, keys: list[str], ts: str = "ts", window: str = WINDOW, seconds: float = 10.0) -> DataFrame:
    """n and rate_hz of each key in tumbling windows that hold any record."""
    x = records.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return x.select(*keys, F.col("w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("rate_hz"))


def live_rates(records: DataFrame, device: str = "device", ts: str = "ts", late: str = LATE) -> DataFrame:
    """Rates per device and kind, every 10 seconds."""
    return windowed_rates(on_time(records, ts, late), [device, "kind"], ts)


def plausible(records: DataFrame, ts: str = "ts", ahead: str = AHEAD, behind: str | None = None, name: str = "stray_times") -> DataFrame:
    """``records`` without those whose time lies more than ``ahead`` after the time at which they are read, or more than
    ``behind`` before it, if that is given. A stray stamp would move the watermark of all devices, or open a silence of years.
    They are counted under ``name`` in the query's observed metrics; null times stay."""
    stray = F.col(ts) > F.current_timestamp() + F.expr(f"interval {ahead}")
    if behind is not None:
        stray = stray | (F.col(ts) < F.current_timestamp() - F.expr(f"interval {behind}"))
    stray = F.coalesce(stray, F.lit(False))
    return records.observe(name, F.count_if(stray).alias("rows")).where(~stray)


def with_silence(rates: DataFrame, device: str = "device", kinds: list[str] | None = None, seconds: float = 10.0, most: int = SILENT) -> DataFrame:
    """Rates (device, kind, window_start, n, rate_hz, windows) with a row of n = 0 for each window between the device's first
    and last one, of any kind, in which a kind is silent. ``kinds``: those that every device has; by default each device's
    own, and then a kind that never came isn't known.

    Silences are found from one window to the next. Of a silence of more than ``most`` windows the first ``most`` have a row
    each, and what is left has one row, whose ``windows`` tells how many it stands for; elsewhere that is 1. So a stray time
    costs ``most`` rows a kind, not the windows of all the time between."""
    step = int(seconds * 1e6)
    at = F.unix_micros("window_start")
    span = rates.groupBy(device).agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.collect_set("kind").alias("own"))
    known = F.col("own") if kinds is None else F.array(*map(F.lit, kinds))
    # each kind begins a window before the device does, with what isn't a window
    begins = span.select(device, F.explode(known).alias("kind"), (F.col("__first") - step).alias("at"), (F.col("__last") + step).alias("__end"))
    own = rates.select(device, "kind", at.alias("at"), "n")
    w = Window.partitionBy(device, "kind").orderBy("at")
    x = own.unionByName(begins, allowMissingColumns=True).withColumn("__end", F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("missing", ((F.coalesce(F.lead("at").over(w), "__end") - F.col("at")) / step).cast("long") - 1)
    one = F.lit(1).cast("long")
    row = lambda at, n, windows: F.struct(at.alias("at"), n.cast("long").alias("n"), windows.alias("windows"))
    silent = F.transform(F.sequence(one, F.least(F.col("missing"), F.lit(most))), lambda k: row(F.col("at") + k * step, F.lit(0), one))
    rest = F.array(row(F.col("at") + (most + 1) * step, F.lit(0), F.col("missing") - most))
    nothing = F.filter(rest, lambda r: F.lit(False))
    rows = F.concat(F.when(F.col("n").isNotNull(), F.array(row(F.col("at"), F.col("n"), one))).otherwise(nothing), F.when(F.col("missing") > 0, silent).otherwise(nothing), F.when(F.col("missing") > most, rest).otherwise(nothing))
    x = x.select(device, "kind", F.explode(rows).alias("r"))
    return x.select(device, "kind", F.timestamp_micros("r.at").alias("window_start"), "r.n", (F.col("r.n") / seconds).alias("rate_hz"), "r.windows")


def bad_in_a_row(rows: DataFrame, bad: Column, keys: list[str], order: str) -> DataFrame:
    """``in_a_row``: bad rows up to this one since the last good one. A row with a column ``windows`` counts as so many."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = rows.withColumn("__bad", bad).withColumn("__good", F.sum((~F.col("__bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = Window.partitionBy(*keys, "__good").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = F.col("__bad").cast("int") * F.col("windows") if "windows" in rows.columns else F.col("__bad").cast("int")
    return x.withColumn("in_a_row", F.sum(counted).over(streak)).drop("__bad", "__good")


def frequency_alarm(rates: DataFrame, keys: list[str], expected: Column, tolerance: Column, rows: Column, order: str = "window_start") -> DataFrame:
    """``alarm`` when the rate has been outside expected ± tolerance for ``rows`` windows in a row; a good one resets."""
    bad = (F.col("rate_hz") < expected * (1 - tolerance)) | (F.col("rate_hz") > expected * (1 + tolerance))
    x = bad_in_a_row(rates, bad, keys, order)
    return x.withColumn("alarm", F.col("in_a_row") >= rows)


def saturation_alarm(windows: DataFrame, keys: list[str], busy: str = "write_ms", limit: float = SATURATION_MS, rows: int = SATURATION_ROWS, order: str = "window_start") -> DataFrame:
    """``alarm`` when writing has taken ``limit`` or more of the window ``rows`` times in a row."""
    x = bad_in_a_row(windows, F.col(busy) >= limit, keys, order)
    return x.withColumn("alarm", F.col("in_a_row") >= rows)


def streamed_alarm(rates: DataFrame, device: str = "device", expected: dict[str, tuple[float, float, int]] | None = None, seconds: float = 10.0, late: str = LATE, ahead: str = AHEAD, most: int = SILENT) -> DataFrame:
    """The frequency alarm over a stream of finished windows, as read from the table that ``live_rates`` appends to (one
    query can't keep state after an aggregation).

    From a device's first window on, each kind of ``expected`` is judged in every window, in order. A window that isn't
    there when the stream's watermark has passed it gets a row with n = 0, be the kind or the whole device silent; what
    lies beyond it waits till then. Of a silence of more than ``most`` windows the first ``most`` and the last one have rows, and
    the streak counts all. Windows more than ``ahead`` after their arrival are set aside (see ``plausible``). As long as any device is heard, the watermark moves on. The state is, per device, a
    place and a streak for each kind and the windows that wait. Windows of kinds that ``expected`` doesn't name are not
    judged and give no rows; a window that comes when its place has been judged is judged by itself."""
    known = expected or EXPECTED
    step, chunk = int(seconds * 1e6), 10_000
    names = ["kind", "at", "n", "rate_hz", "in_a_row", "alarm"]

    def judge(key: tuple, windows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # kind -> [the next window, bad ones in a row, windows that wait]
        places = json.loads(state.get[0]) if state.exists else {}
        came = [] if state.hasTimedOut else sorted(row for w in windows for row in zip(w["at"].tolist(), w["kind"], w["n"].tolist(), w["rate_hz"].tolist()))
        passed = state.getCurrentWatermarkMs() * 1000
        if not places:
            places = {kind: [came[0][0], 0, {}] for kind in known}
        out = []

        def judged(kind: str, at: int, n: int, rate: float, streak: int) -> int:
            hz, tolerance, rows = known[kind]
            streak = 0 if hz * (1 - tolerance) <= rate <= hz * (1 + tolerance) else streak + 1
            out.append((kind, at, n, rate, streak, streak >= rows))
            return streak

        def table() -> pd.DataFrame:
            x = pd.DataFrame(out, columns=names)
            x.insert(0, device, key[0])
            out.clear()
            return x

        for at, kind, n, rate in came:
            if at < places[kind][0]:  # from before the first window that was heard of the device: by itself
                judged(kind, at, n, rate, 0)
            else:
                places[kind][2][str(at)] = (n, rate)
        for kind, place in places.items():
            silent = 0
            while (found := place[2].pop(str(place[0]), None)) or place[0] <= passed:
                n, rate = found or (0, 0.0)
                silent = 0 if found else silent + 1
                if silent > most:  # on to the last silent window, which stands for those that are passed over
                    skipped = (min([passed + 1, *map(int, place[2])]) - place[0] - 1) // step
                    place[0], place[1], silent = place[0] + skipped * step, place[1] + skipped, 0
                place[1] = judged(kind, place[0], n, rate, place[1])
                place[0] += step
                if len(out) >= chunk:
                    yield table()
        state.update((json.dumps(places),))
        state.setTimeoutTimestamp(max(passed // 1000 + 1, min(p[0] for p in places.values()) // 1000))
        if out:
            yield table()

    kind = rates.schema[device].dataType.simpleString()
    schema = f"`{device}` {kind}, kind string, at long, n long, rate_hz double, in_a_row int, alarm boolean"
    rates = plausible(rates, "window_start", ahead) if rates.isStreaming else rates
    known_late = on_time(rates.where(F.col("kind").isin(*known)), "window_start", late).withColumn("at", F.unix_micros("window_start"))
    out = known_late.groupBy(device).applyInPandasWithState(judge, schema, "places string", "append", "EventTimeTimeout")
    return out.select(device, "kind", F.timestamp_micros("at").alias("window_start"), "n", "rate_hz", "in_a_row", "alarm")


def streamed_saturation(windows: DataFrame, device: str = "device", busy: str = "write_ms", limit: float = SATURATION_MS, rows: int = SATURATION_ROWS, late: str = LATE) -> DataFrame:
    """The saturation alarm over a stream of windows (device, window_start, ``busy``): device, window_start, busy,
    in_a_row, alarm.

    A window waits until the watermark has passed it, so that windows are judged in order; one that comes later still is
    dropped, and counted by ``rows_too_late``. Windows in which nothing was written have no row and end no streak; a null
    ``busy`` counts as not busy. The state is, per device, a streak and the windows that wait."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, waiting = json.loads(state.get[0]) if state.exists else (0, [])
        came = [] if state.hasTimedOut else [row for f in frames for row in zip(f["at"].tolist(), f["busy"].fillna(-1).tolist())]
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = sorted([*map(tuple, waiting), *came])
        out = []
        while waiting and waiting[0][0] <= passed:
            at, ms = waiting.pop(0)
            streak = streak + 1 if ms >= limit else 0
            out.append((key[0], at, ms, streak, streak >= rows))
        state.update((json.dumps([streak, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(passed // 1000 + 1, waiting[0][0] // 1000))
        if out:
            yield pd.DataFrame(out, columns=[device, "at", "busy", "in_a_row", "alarm"])

    kind = windows.schema[device].dataType.simpleString()
    x = on_time(windows, "window_start", late).select(device, "window_start", F.unix_micros("window_start").alias("at"), F.col(busy).cast("double").alias("busy"))
    out = x.groupBy(device).applyInPandasWithState(judge, f"`{device}` {kind}, at long, busy double, in_a_row int, alarm boolean", "streak string", "append", "EventTimeTimeout")
    return out.select(device, F.timestamp_micros("at").alias("window_start"), F.col("busy").alias(busy), "in_a_row", "alarm")


def stray_rows(query, name: str = "stray_times") -> int:
    """Rows that ``plausible`` has set aside in a streaming query, as far as its progress goes back."""
    found = (progress["observedMetrics"].get(name) for progress in query.recentProgress)
    return sum(row["rows"] if isinstance(row, dict) else row.rows for row in found if row is not None)


def rows_too_late(query) -> int:
    """Rows that a streaming query has dropped because they came after the watermark, as far as its progress goes back."""
    return sum(int(operator["numRowsDroppedByWatermark"]) for progress in query.recentProgress for operator in progress["stateOperators"])
