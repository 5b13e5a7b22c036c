"""Summaries per file: durations, rates, ranges, tracks, limits and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

KINDS = ("PPS", "GNSS", "IMU")


def recording_summary(records: DataFrame, value: str = "micros_reading_unwrapped", jump: str = "micros_jump", ticks: int = 1_000_000, turn: int = 2**32) -> DataFrame:
    """Per file the records of each kind, the duration from the first to the last IMU record that isn't a jump, and the
    kinds' rates over it. The duration needs two such records; a negative one is taken as one turn of the clock. Rates
    need a positive duration."""
    steady = (F.col("kind") == "IMU") & ~F.coalesce(F.col(jump), F.lit(False))
    own = lambda f: f(F.when(steady, F.col(value)), F.when(steady, F.col("offset")))
    x = records.groupBy("file_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS], F.count_if(steady).alias("n_steady"), own(F.min_by).alias("first_micros"), own(F.max_by).alias("last_micros"))
    lasted = F.col("last_micros") - F.col("first_micros")
    seconds = F.when(F.col("n_steady") > 1, F.when(lasted < 0, lasted + turn).otherwise(lasted) / ticks)
    x = x.withColumn("duration_s", seconds)
    return x.withColumns({f"rate_{k.lower()}": F.when(F.col("duration_s") > 0, F.col(f"n_{k.lower()}") / F.col("duration_s")) for k in KINDS}).drop("n_steady")


def utc_duration(records: DataFrame, utc: str) -> DataFrame:
    """Seconds from the first to the last IMU record with a UTC time, in file order."""
    own = (F.col("kind") == "IMU") & F.col(utc).isNotNull()
    at = lambda f: f(F.when(own, F.col(utc)), F.when(own, F.col("offset")))
    return records.groupBy("file_id").agg((at(F.max_by) - at(F.min_by)).alias("duration_s"))


def raw_vs_clean_range(records: DataFrame, utc: str) -> DataFrame:
    """Per file and kind: records and range of the raw clock; records with UTC and their range in microseconds."""
    micros = F.col(utc) * 1e6
    return records.groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("micros_reading").alias("min_micros"), F.max("micros_reading").alias("max_micros"), F.count(utc).alias("n_valid"), F.min(micros).alias("min_utc_micros"), F.max(micros).alias("max_utc_micros"))


def value_limits(rows: DataFrame, keys: list[str], value: str, flag: str, margin: float = 0.1) -> DataFrame:
    """Lower and upper limit for drawing: the range of the values that aren't flagged (of all, if all are), widened by
    ``margin``; a single value is widened by a tenth of itself, or by 1 around 0; a group without values gets 0 to 1."""
    clean = F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(value))
    x = rows.groupBy(*keys).agg(F.coalesce(F.min(clean), F.min(value)).alias("low"), F.coalesce(F.max(clean), F.max(value)).alias("high"))
    span = F.col("high") - F.col("low")
    single = F.when(F.col("low") != 0, F.abs(F.col("low")) * margin).otherwise(1.0)
    pad = F.when(span == 0, single).otherwise(span * margin)
    return x.select(*keys, F.coalesce(F.col("low") - pad, F.lit(0.0)).cast("double").alias("lower"), F.coalesce(F.col("high") + pad, F.lit(1.0)).cast("double").alias("upper"))


def track_endpoints(fixes: DataFrame, flag: Column | None = None) -> DataFrame:
    """Start and end of each file's track, its points and how many of them are flagged."""
    place = F.struct("latitude_dd", "longitude_dd")
    x = fixes.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.lit(False) if flag is None else flag).alias("n_outliers"), F.min_by(place, "offset").alias("a"), F.max_by(place, "offset").alias("b"))
    return x.select("file_id", "n_points", "n_outliers", F.col("a.latitude_dd").alias("start_latitude"), F.col("a.longitude_dd").alias("start_longitude"), F.col("b.latitude_dd").alias("end_latitude"), F.col("b.longitude_dd").alias("end_longitude"))


def _broken_rules(utc: str, outlier: Column, counter_turn: int, utc_after: float) -> dict[str, Column]:
    """Aggregates: how many records there are, how many break each rule, and IMU records."""
    imu = F.col("kind") == "IMU"
    return {
        "n": F.count(F.lit(1)),
        "null_utc": F.count_if(F.col(utc).isNull()),
        "old_utc": F.count_if(F.col(utc) <= utc_after),
        "counter_breaks": F.count_if(imu & ~F.pmod("counter_step", F.lit(counter_turn)).isin(0, 1)),
        "backward_steps": F.count_if(F.col("micros_step") < 0),
        "outlier_rows": F.count_if(imu & outlier),
        "imu_rows": F.count_if(imu),
    }


def observe_gates(records: DataFrame, utc: str, outlier: Column, counter_turn: int = 2**16, utc_after: float = 1.7e9) -> tuple[DataFrame, Observation]:
    """``records`` (with counter_step and micros_step) as they are, and what the rules of ``quality_gates`` find in all of
    them, counted while whatever follows, such as a write of the table, reads them: no second scan. ``gates_passed`` judges
    the figures. They stand once the first job over the returned records has ended."""
    seen = Observation()
    rules = _broken_rules(utc, outlier, counter_turn, utc_after)
    return records.observe(seen, *[c.cast("long").alias(name) for name, c in rules.items()]), seen


def gates_passed(figures: dict[str, int]) -> bool:
    """Whether figures of ``observe_gates`` pass: no record breaks a rule, and of the IMU records some are outliers, but
    under a tenth."""
    broken = sum(figures[c] for c in ("null_utc", "old_utc", "counter_breaks", "backward_steps"))
    return broken == 0 and 0 < figures["outlier_rows"] < 0.1 * figures["imu_rows"]


def quality_gates(records: DataFrame, utc: str, outlier: Column, counter_turn: int = 2**16, utc_after: float = 1.7e9) -> DataFrame:
    """Per file how many records break each rule, and whether all hold: UTC is known, and recent; IMU counters step by
    1 (or 0) modulo their range; the unwrapped clock doesn't go back within a segment; some records are outliers but
    under a tenth. ``records`` carries counter_step and micros_step as ``steps`` makes them."""
    x = records.groupBy("file_id").agg(*[c.alias(name) for name, c in _broken_rules(utc, outlier, counter_turn, utc_after).items()])
    share = F.col("outlier_rows") / F.nullif(F.col("imu_rows"), F.lit(0))
    fine = (F.col("null_utc") + F.col("old_utc") + F.col("counter_breaks") + F.col("backward_steps") == 0) & (F.col("outlier_rows") > 0) & (share < 0.1)
    return x.withColumn("passed", F.coalesce(fine, F.lit(False))).drop("imu_rows")


def export_flat(records: DataFrame, doubles: dict[str, str], others: dict[str, str]) -> DataFrame:
    """The flat columns that users read: ``doubles`` (new name: column) have NaN for null, ``others`` are renamed."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(n) for n, c in doubles.items()]
    return records.select(*[F.col(c).alias(n) for n, c in others.items()], *numbers)


def fleet_rollup(files: DataFrame, keys: list[str], sums: list[str], greatest: list[str]) -> DataFrame:
    """Reports of files rolled up by ``keys``, such as boot and day, with totals where later keys are null: n_files,
    n_complete (by status), rate_imu over the files with a duration, sums and greatest values. A file is one row, so
    partial sums leave few rows to shuffle."""
    timed = F.col("duration_s") > 0
    rate = F.sum(F.when(timed, F.col("n_imu"))) / F.sum(F.when(timed, F.col("duration_s")))
    more = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in greatest]
    return files.rollup(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == "complete").alias("n_complete"), rate.alias("rate_imu"), *more)
