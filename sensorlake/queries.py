"""Driver queries: each operator over the whole ``events`` table, seen as a sensor log. Their SQL is in oracles.py."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .eventlog import SETTINGS as S
from .eventlog import file_heads, raw_files, sensor_log
from .operators import clock, outliers, reports, segments, series, unwrap
from .oracles import oracle_sql
from .plans import clock_fits, segmented, synchronise, with_steps
from .shared import shared_dir, store
from .sources import audit, combine_segments, cut_ranges, decode_frames, decode_ranges, of_kind, parse_file_name, parse_header, read_tables, write_tables
from .streaming import frequency_alarm, saturation_alarm, windowed_rates, with_silence

__all__ = ["entry", "oracle_sql", "queries"]
FOUND: dict = {}
DEVIATION = int(S.deviation_seconds * S.ticks)
#: Ticks of two days, for segments of any length.
CLOCK_BLOCK = 2 * 86_400 * S.ticks


def on_log(f):
    """Register a query of the sensor log."""

    @wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(sensor_log(spark.read.parquet(f"{sf_dir}/events.parquet")))

    FOUND[f.__name__] = query
    return f  # other queries build on it


def r6(c, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def known(c, name: str | None = None, other: int = -1):
    """Integers with a number in place of null, as results are compared by value."""
    return F.coalesce(F.col(c).cast("long") if isinstance(c, str) else c, F.lit(other)).alias(name or c)


def utc_of(log: DataFrame) -> DataFrame:
    """Each record with its true time in seconds, as what the clock regression would give."""
    return log.withColumn("utc", F.col("offset") / 1e6)


def carried(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    cut = segmented(log, S)
    summary = unwrap.carry_summary(cut, S.turn, S.counter_turn)
    return cut, summary, unwrap.carry_unwrap_state(summary, S.turn, S.counter_turn, S.carry_from, DEVIATION)


def unwrapped(log: DataFrame) -> DataFrame:
    """Segmented and unwrapped records. The segmented rows are written once, as the carry and the rows both need them."""
    cut = store(segmented(log, S), "segmented")
    summary = unwrap.carry_summary(cut, S.turn, S.counter_turn)
    state = unwrap.carry_unwrap_state(summary, S.turn, S.counter_turn, S.carry_from, DEVIATION)
    return unwrap.apply_carry(cut, state, S.turn, S.counter_turn)


# sources and sinks


@on_log
def file_names(log):
    return parse_file_name(file_heads(log)).select("file_id", "path", F.col("boot_id").cast("long").alias("boot_id"), F.date_format("file_start", "yyyy-MM-dd HH:mm:ss").alias("file_start"))


@on_log
def file_headers(log):
    x = parse_header(file_heads(log))
    return x.select("file_id", "acc_sensitivity", "gyr_sensitivity", "imu_odr", "gnss_rate", "firmware_commit", F.length("header_text").cast("long").alias("header_chars"))


@on_log
def decoded_frames(log):
    """Round trip: the log is written as raw files, in parts, and decoded again."""
    frames = decode_frames(raw_files(log), base="base").where("kind <> 'FILE'")
    return frames.select("file_id", "kind", "offset", "micros_reading", *[known(c) for c in ("counter", "acc_x", "acc_y", "gyr_z", "latitude", "longitude", "posix_timestamp", "microseconds", "ned_vel_east", "fix_type")])


@on_log
def range_decoded_frames(log):
    """The same, but each part is cut into ranges of 600 bytes, wherever that is, which are decoded apart and stitched."""
    junk, reach = 64, 256
    parts = raw_files(log).select(F.concat_ws(":", F.coalesce(F.col("file_id").cast("string"), F.lit("")), "base").alias("file_id"), "content")
    frames = decode_ranges(cut_ranges(parts, 600, junk, reach), junk, reach).where("kind <> 'FILE'").withColumn("of", F.split("file_id", ":"))
    frames = frames.withColumns({"file_id": F.nullif(F.col("of")[0], F.lit("")).cast("long"), "offset": F.col("offset") + F.col("of")[1].cast("long")})
    return frames.select("file_id", "kind", "offset", "micros_reading", *[known(c) for c in ("counter", "acc_x", "acc_y", "gyr_z", "latitude", "longitude", "posix_timestamp", "microseconds", "ned_vel_east", "fix_type")])


@on_log
def file_audit(log):
    return audit(decode_frames(raw_files(log), base="base")).select("file_id", "file_bytes", "parsed_bytes", "footer_found", "status", "n_pps", "n_gnss", "n_imu", r6("share_parsed"), r6("bytes_per_frame"))


@on_log
def combined_segments(log):
    """Written as tables, read back, and put together again with the header's values."""
    spark = log.sparkSession
    out = store(segmented(log, S).withColumn("segment_out", F.col("segment")), "to-write")
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    files = parse_header(file_heads(log)).drop("content")
    write_tables({"imu": out.where("kind = 'IMU'"), "files": files}, path)
    tables = read_tables(spark, path, ["imu", "files"])
    return combine_segments(tables["imu"], tables["files"]).select("file_id", "segment_out", "offset", "acc_x", "acc_sensitivity", "imu_odr")


# projections and scalar functions


@on_log
def scaled_imu(log):
    imu = of_kind(log, "IMU").withColumns({"acc_sensitivity": F.lit(None).cast("double"), "gyr_sensitivity": F.lit(8.75)})
    return fn.scale_imu(imu).select("file_id", "offset", *[r6(c) for c in ("acc_x_mg", "acc_y_mg", "acc_z_mg", "gyr_x_mdps", "gyr_y_mdps", "gyr_z_mdps")])


@on_log
def scaled_gnss(log):
    x = fn.scale_gnss(log.where("kind = 'GNSS'"))
    return x.select("file_id", "offset", r6("latitude_dd"), r6("longitude_dd"), "ned_vel_north_mmps", F.unix_micros("datetime_utc").alias("datetime_utc_micros"))


@on_log
def gnss_posix_seconds(log):
    return log.where("kind = 'GNSS'").select("file_id", "offset", r6(fn.gnss_posix_seconds(F.col("posix_timestamp"), F.col("microseconds")), "posix_seconds"))


@on_log
def calendar(log):
    t = F.col("posix_timestamp")
    x = log.select("file_id", "offset", "posix_timestamp", "counter", fn.posix_parts(t).alias("p"), fn.iso_text(t).alias("iso"))
    back = fn.posix_seconds(*[F.col(f"p.{c}") for c in ("year", "month", "day", "hour", "minute", "second")])
    odd = fn.valid_calendar(F.col("p.year"), F.col("p.month"), F.col("counter") % 35, F.col("p.hour"), F.col("p.minute"), F.col("p.second"))
    return x.select("file_id", "offset", F.col("p.year").cast("long").alias("year"), F.col("p.month").cast("long").alias("month"), F.col("p.day").cast("long").alias("day"), F.col("p.second").cast("long").alias("second"), "iso", back.alias("back"), odd.alias("valid_day"), fn.is_leap_year(1900 + F.col("counter")).alias("leap"))


@on_log
def next_file_boundary(log):
    return log.groupBy("file_id", fn.next_file_boundary(F.col("posix_timestamp")).alias("boundary")).agg(F.count(F.lit(1)).alias("n"))


@on_log
def normalized_index(log):
    return series.normalized_index(log, S.block).select("file_id", "kind", "offset", r6("normalized_index"))


@on_log
def utc_micros(log):
    late = utc_of(log).withColumn("utc", F.when(F.col("counter") % 5 > 0, F.col("utc")))
    return late.withColumn("u", fn.utc_micros(F.col("utc"))).select("file_id", "offset", known(F.round("u.micros", 0).cast("long"), "utc_micros"), F.col("u.valid").alias("utc_valid"))


@on_log
def relative_time(log):
    return series.relative_time(utc_of(log), "utc", S.block).select("file_id", "kind", "offset", r6("relative_time"))


@on_log
def outlier_masks(log):
    flagged = outliers.flag_outliers(of_kind(log, "IMU"), ["acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z"], keys=("file_id",), sigma=3)
    groups = {f"{g}_outlier": [f"{g}_{a}_stdchecked" for a in "xyz"] for g in ("acc", "gyr")}
    return fn.outlier_masks(flagged, groups).select("file_id", "offset", "acc_outlier", "gyr_outlier")


# windows


@on_log
def imu_jumps(log):
    return segments.flag_imu_jumps(log, S.jump, S.block).where("kind = 'IMU'").select("file_id", "offset", "imu_jump")


@on_log
def assigned_segments(log):
    return segmented(log, S).select("file_id", "offset", "kind", "segment")


@on_log
def unwrapped_counter(log):
    x = unwrap.unwrap_counter(segmented(log, S), "micros_reading", S.turn)
    return x.select("file_id", "segment", "kind", "offset", "micros_reading_unwrapped", F.col("micros_reading_wrap").alias("wrap"))


@on_log
def carried_state(log):
    return carried(log)[2]


@on_log
def carried_unwrap(log):
    return unwrapped(log).select("file_id", "segment", "kind", "offset", "micros_reading_unwrapped", known("counter_unwrapped"), "micros_reading_wrap", "counter_wrap")


@on_log
def wrap_positions(log):
    return unwrap.wrap_events(unwrapped(log), "micros_reading").select("file_id", "segment", "kind", F.col("index").cast("long").alias("index"))


@on_log
def jump_positions(log):
    imu = unwrapped(log).where("kind = 'IMU'")
    a = unwrap.jump_events(imu, "counter", 1).withColumn("field", F.lit("counter"))
    b = unwrap.jump_events(imu, "micros_reading", 0.1 * S.turn).withColumn("field", F.lit("micros_reading"))
    return a.unionByName(b).select("file_id", "segment", "field", F.col("index").cast("long").alias("index"), "step")


@on_log
def consecutive_dt(log):
    return series.consecutive_dt(utc_of(log), "utc", S.ticks, S.block).select("file_id", "kind", "offset", r6("dt_raw_ms"), F.round("dt_utc_ms", 2).alias("dt_utc_ms"))


@on_log
def counter_gaps(log):
    imu = log.where("kind = 'IMU'").withColumn("segment", F.lit(0))
    x = unwrap.unwrap_counter(imu, "counter", S.counter_turn, span=S.block)
    return series.counter_gaps(x, wrap=200, span=S.block).withColumn("missed", known("missed", other=0))


@on_log
def flagged_outliers(log):
    """With the columns whose values are sure to fit in 16 bits as narrow as decoded ones are, the rest wide."""
    narrow = segmented(log, S).where("kind = 'IMU'").withColumns({c: F.col(c).cast("smallint") for c in ("acc_y", "acc_z", "gyr_y", "gyr_z")})
    x = outliers.flag_outliers(narrow, ["acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z"])
    return x.select("file_id", "segment", "offset", *[c for c in x.columns if c.endswith("_stdchecked")])


@on_log
def flagged_outliers_wide(log):
    """Full-range integers, over whole files."""
    x = outliers.flag_outliers(log.where("kind = 'GNSS'"), ["latitude", "longitude", "micros_reading"], sigma=3, keys=("file_id",))
    return x.select("file_id", "offset", *[c for c in x.columns if c.endswith("_stdchecked")])


@on_log
def flagged_float_outliers(log):
    odd = F.when(F.col("counter") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    x = log.where("kind = 'IMU'").select("file_id", "offset", odd.alias("reading"))
    return outliers.flag_float_outliers(x, ["reading"], sigma=3.0, keys=("file_id",)).select("file_id", "offset", "reading_stdchecked")


@on_log
def debounced_pulses(log):
    return series.debounce_pulses(log.where("kind = 'PPS'"), 500_000 * S.ticks, S.turn, S.block).select("file_id", "offset", "kept")


# clock


@on_log
def clock_consistency(log):
    x = unwrap.unwrap_counter(segmented(log, S), "micros_reading", S.turn)
    return clock.check_clock_consistency(x, seconds=S.deviation_seconds, ticks=S.ticks)


def matched(log: DataFrame) -> DataFrame:
    x = store(unwrapped(log).where("kind IN ('PPS', 'GNSS')"), "pulses-and-fixes")
    fixes = x.where("kind = 'GNSS'").withColumn("gnss_utc", fn.gnss_posix_seconds(F.col("posix_timestamp"), F.col("microseconds")))
    return clock.match_nearest(x.where("kind = 'PPS'"), fixes, span=CLOCK_BLOCK)


@on_log
def nearest_fixes(log):
    return matched(log).select("file_id", "segment", "offset", "micros", known("gnss_micros"), r6("gnss_utc"))


@on_log
def pulse_seconds(log):
    return clock.pulse_utc_second(matched(log), S.ticks).select("file_id", "segment", "offset", known("utc_second"))


@on_log
def filtered_pairs(log):
    whole = log.withColumn("segment", F.lit(0))
    x = store(unwrap.unwrap_counter(whole, "micros_reading", S.turn, span=S.block).where("kind IN ('PPS', 'GNSS')"), "pulses-and-fixes")
    fixes = x.where("kind = 'GNSS'").withColumn("gnss_utc", fn.gnss_posix_seconds(F.col("posix_timestamp"), F.col("microseconds")))
    pairs = clock.pulse_utc_second(clock.match_nearest(x.where("kind = 'PPS'"), fixes, span=CLOCK_BLOCK), S.ticks)
    return clock.filter_pairs(pairs).select("file_id", "offset", "utc_second", "used")


def whole_file_fits(log: DataFrame):
    """Clock fits over whole files, which have enough pulses for them."""
    x = store(unwrap.unwrap_counter(log.withColumn("segment", F.lit(0)), "micros_reading", S.turn, span=S.block), "unwrapped")
    return x, clock_fits(x, replace(S, clock_block=CLOCK_BLOCK))[1]


@on_log
def fitted_clock(log):
    fits = whole_file_fits(log)[1]
    return fits.select("file_id", "n_pairs", "n_pairs_used", F.round(F.col("slope") * 1e6, 4).alias("slope_us"), F.round("intercept", 3).alias("intercept"), r6("r_squared"))


@on_log
def applied_clock(log):
    x, fits = whole_file_fits(log)
    y = clock.apply_clock(x, fits)
    return y.select("file_id", "kind", "offset", F.round("utc_timestamp_from_pps_regression", 2).alias("utc"), F.col("datetime_timestamp_from_pps_regression").isNotNull().alias("has_time"))


@on_log
def pulse_mismatch(log):
    """Mismatch of clocks that are read a third of a second late at worst."""
    late = log.where("kind = 'PPS'").withColumn("segment", F.lit(0)).withColumn("utc", F.col("posix_timestamp") + (F.col("counter") - 128) / 400)
    return clock.pulse_mismatch(late, "utc").select("file_id", "segment", r6("max_mismatch"), r6("mean_mismatch"), r6("rms_mismatch"))


def graded(log: DataFrame) -> DataFrame:
    """Segments with made-up fits that depend on the data, so that every verdict occurs."""
    x = segmented(log, S)
    n = [F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("PPS", "GNSS", "IMU")]
    y = x.groupBy("file_id", "segment").agg(*n, F.sum("acc_x").alias("a"), F.sum("counter").alias("c"))
    y = y.withColumns({"slope": F.when((F.col("n_pps") >= 1) & (F.col("n_gnss") >= 1), 1.0), "r_squared": 1 - (F.col("a") % 40) / 1000, "max_mismatch": (F.col("c") % 30) / 100, "consistency_ok": F.col("c") % 7 > 0})
    return segments.filter_segments(segments.grade_segments(y))


@on_log
def graded_segments(log):
    return graded(log).select("file_id", "segment", "n_pps", "n_gnss", "n_imu", "regression_valid")


@on_log
def filtered_segments(log):
    return graded(log).select("file_id", "segment", "keep", "skip_reason", known("segment_out"))


@on_log
def kept_rows(log):
    return segments.kept_rows(segmented(log, S), graded(log)).groupBy("file_id", "segment").agg(F.count(F.lit(1)).alias("n"))


# summaries


@on_log
def unwrap_stats(log):
    x = unwrap.unwrap_stats(unwrapped(log), "micros_reading", 0.1 * S.turn)
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return x.select("file_id", "segment", "kind", "wraps", "jumps", text("wrap_indices"), text("jump_indices"))


@on_log
def segment_counts(log):
    return segments.segment_counts(segmented(log, S)).withColumn("segment", F.coalesce("segment", F.lit(-1)))


@on_log
def recording_summary(log):
    x = unwrap.unwrap_counter(segments.flag_imu_jumps(log, S.jump, S.block).withColumn("segment", F.lit(0)), "micros_reading", S.turn, span=S.block)
    y = reports.recording_summary(x.withColumnRenamed("imu_jump", "micros_jump"), ticks=S.ticks, turn=S.turn)
    return y.select("file_id", "n_pps", "n_gnss", "n_imu", "first_micros", "last_micros", r6("duration_s"), *[F.round(F.col(f"rate_{k}") * 1e6, 4).alias(f"rate_{k}_uhz") for k in ("pps", "gnss", "imu")])


@on_log
def utc_duration(log):
    late = utc_of(log).withColumn("utc", F.when(F.col("counter") % 5 > 0, F.col("utc")))
    return reports.utc_duration(late, "utc").select("file_id", r6("duration_s"))


@on_log
def outlier_counts(log):
    flags = [f"{g}_{a}_stdchecked" for g in ("acc", "gyr") for a in "xyz"]
    x = outliers.flag_outliers(segmented(log, S).where("kind = 'IMU'"), [f[:-11] for f in flags])
    return outliers.outlier_counts(x, flags, {"acc": flags[:3], "gyr": flags[3:]}).withColumn("segment", F.coalesce("segment", F.lit(-1)))


@on_log
def dt_stats(log):
    x = series.dt_stats(series.consecutive_dt(utc_of(log), "utc", S.ticks, S.block))
    return x.select("file_id", "kind", *[F.round(c, 3).alias(c) for c in x.columns[2:]])


@on_log
def raw_vs_clean_range(log):
    late = utc_of(log).withColumn("utc", F.when(F.col("counter") % 5 > 0, F.col("utc")))
    x = reports.raw_vs_clean_range(late, "utc")
    return x.select("file_id", "kind", "n", "min_micros", "max_micros", "n_valid", F.round("min_utc_micros", 0).alias("min_utc_micros"), F.round("max_utc_micros", 0).alias("max_utc_micros"))


@on_log
def flat_export(log):
    late = utc_of(log).where("kind = 'IMU'").withColumn("utc", F.when(F.col("counter") % 5 > 0, F.col("utc")))
    x = reports.export_flat(late, {"imu_timestamp": "utc", "imu_acc_x": "acc_x"}, {"file_id": "file_id", "imu_micros": "micros_reading"})
    return x.select("file_id", "imu_micros", r6(F.nanvl("imu_timestamp", F.lit(-1.0)), "imu_timestamp"), "imu_acc_x")


@on_log
def value_limits(log):
    x = log.withColumn("flagged", (F.col("counter") % 3 > 0) | (F.col("file_id") % 10 == 0))
    return reports.value_limits(x, ["file_id", "kind"], "acc_x", "flagged").select("file_id", "kind", r6("lower"), r6("upper"))


@on_log
def head_tail_sample(log):
    return series.head_tail_sample(log, 3).select("file_id", "kind", "offset", "place")


@on_log
def track_endpoints(log):
    x = fn.scale_gnss(log.where("kind = 'GNSS'"))
    y = reports.track_endpoints(x, F.col("counter") % 10 == 0)
    return y.select("file_id", "n_points", "n_outliers", *[r6(c) for c in y.columns[3:]])


@on_log
def quality_gates(log):
    late = utc_of(with_steps(unwrapped(log))).withColumn("utc", F.when(F.col("counter") % 50 > 0, F.col("utc")))
    return reports.quality_gates(late, "utc", F.col("acc_x") % 20 == 0, S.counter_turn, 1.7045e9)


@on_log
def sigma_filtered_mean(log):
    return outliers.sigma_filtered_mean(log, ["file_id", "kind"], "acc_x", 1.6)


@on_log
def sigma_filtered_mean_float(log):
    x = outliers.sigma_filtered_mean(log, ["file_id", "kind"], "value", 1.5, whole=False)
    return x.select("file_id", "kind", r6("mean"))


@on_log
def plain_mean(log):
    return outliers.plain_mean(log, ["file_id", "kind"], "value").select("file_id", "kind", r6("mean"))


# rates and alarms, over the finished table


def rates(log: DataFrame) -> DataFrame:
    """Every window of a device's time and every kind of sensor; a silent sensor's rate is 0."""
    x = log.withColumn("ts", F.timestamp_micros("offset")).withColumnRenamed("file_id", "device")
    heard = windowed_rates(x, ["device", "kind"], window="1 day", seconds=86_400.0)
    return with_silence(heard, kinds=["IMU", "GNSS", "PPS"], seconds=86_400.0)


@on_log
def live_rates(log):
    return rates(log).select("device", "kind", F.unix_micros("window_start").alias("window_start"), "n", r6("rate_hz"))


@on_log
def rate_alarm(log):
    x = rates(log).withColumn("rate_hz", F.col("n").cast("double"))
    y = frequency_alarm(x, ["device", "kind"], F.lit(2.0), F.lit(0.4), F.lit(3))
    return y.select("device", "kind", F.unix_micros("window_start").alias("window_start"), "n", F.col("in_a_row").cast("long").alias("in_a_row"), "alarm")


@on_log
def silence_alarm(log):
    """The rate alarm, compared with SQL that fills the silent windows by itself."""
    x = rates(log).withColumn("rate_hz", F.col("n").cast("double"))
    y = frequency_alarm(x, ["device", "kind"], F.lit(2.0), F.lit(0.4), F.lit(3))
    return y.select("device", "kind", F.unix_micros("window_start").alias("window_start"), "n", F.col("in_a_row").cast("long").alias("in_a_row"), "alarm")


@on_log
def busy_alarm(log):
    x = log.select("file_id", "offset", F.col("acc_x").alias("write_ms"))
    y = saturation_alarm(x, ["file_id"], limit=4000, rows=3, order="offset")
    return y.select("file_id", "offset", F.col("in_a_row").cast("long").alias("in_a_row"), "alarm")


# whole runs


def report(log: DataFrame) -> DataFrame:
    """The quality report: one row per file."""
    steps = series.dt_stats(series.consecutive_dt(utc_of(log), "utc", S.ticks, S.block)).where("kind = 'IMU'").select("file_id", F.round("mean_dt_raw_ms", 3).alias("mean_dt_raw_ms"))
    summary = recording_summary(log).select("file_id", "n_pps", "n_gnss", "n_imu", "duration_s", "rate_imu_uhz")
    gaps = counter_gaps(log).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("missed").alias("missed"))
    return summary.join(steps, "file_id", "left").join(gaps, "file_id", "left")


@on_log
def quality_report(log):
    return report(log)


@on_log
def fleet_report(log):
    """The reports of all files with their audit, mismatch and clean records, rolled up by the day of their start."""
    starts = log.groupBy("file_id").agg(F.min("offset").alias("start"))
    day = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.expr("start div 1000000").cast("decimal(18,6)")), "yyyy-MM-dd")
    clean = raw_vs_clean_range(log).groupBy("file_id").agg(F.sum("n_valid").alias("n_valid"))
    files = report(log).join(starts.select("file_id", day.alias("day")), "file_id").join(file_audit(log).select("file_id", "status"), "file_id")
    files = files.join(pulse_mismatch(log).select("file_id", "max_mismatch"), "file_id", "left").join(clean, "file_id", "left")
    x = reports.fleet_rollup(files, ["day"], ["n_pps", "n_gnss", "n_imu", "duration_s", "n_gaps", "missed", "n_valid"], ["max_mismatch"])
    return x.select(F.coalesce("day", F.lit("all")).alias("day"), "n_files", "n_pps", "n_gnss", "n_imu", "n_complete", F.round("duration_s", 3).alias("duration_s"), F.round(F.col("rate_imu") * 1e6, 3).alias("rate_imu_uhz"), "n_gaps", "missed", "max_mismatch", "n_valid")


@on_log
def synchronised(log):
    """The whole run: how many records of each kind every kept segment has, and its place."""
    out = synchronise(log, S)
    own = [out[k].select("file_id", "segment", "segment_out", "kind") for k in ("pps", "gnss", "imu")]
    return own[0].union(own[1]).union(own[2]).groupBy("file_id", "segment", "segment_out").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("PPS", "GNSS", "IMU")])


def queries() -> dict:
    def bound(f):
        return lambda spark, sf_dir: f(spark, sf_dir)

    return {name: bound(f) for name, f in FOUND.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FOUND["quality_report"](spark, sf_dir)
