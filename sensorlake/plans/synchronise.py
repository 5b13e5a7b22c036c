"""From raw files to records with UTC times, flags and graded segments.

The records are exchanged twice: by blocks of a file for segmentation, and by segment when segmented records are
written to the shared folder in buckets of their segments. Carry, unwrapping, counts, joins with the segments and outliers
read these buckets without an exchange, and unwrapped records lie in folders by kind. What is known per segment or
file comes to the records by one join with the table of kept segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gnss_posix_seconds, scale_gnss, scale_imu
from ..operators import clock, outliers, scan, segments, unwrap
from ..shared import store, store_by
from ..sources import audit, decode_frames, decode_ranges, parse_file_name, parse_header, register
from ..sources.frames import JUNK
from ..sources.ranges import REACH


@dataclass(frozen=True)
class Settings:
    """What differs between devices."""

    turn: int = unwrap.MICROS
    counter_turn: int = unwrap.COUNTER
    ticks: int = clock.TICKS
    jump: int = 1_000_000
    rows_per_segment: int | None = None  # a minute of the IMU rate in each file's header
    default_rows: int = 400_020  # where the header has none
    carry_from: int = unwrap.CARRY_FROM
    deviation_seconds: float = 10.0
    r2: float = 0.99
    mismatch: float = 0.2
    block: int = scan.BLOCK  # offsets of a file that one task reads
    clock_block: int | None = None  # ticks of a segment within which pulses meet fixes at once; None: the whole segment
    buckets: int | None = None  # of the stored records; None: as many as shuffle partitions


def decode(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, frames) of raw files with path and content; file_id is a hash of the path."""
    named = parse_file_name(raw.withColumn("file_id", F.xxhash64("path")))
    frames = store(decode_frames(named), "frames")
    headers = parse_header(named).drop("content")
    files = headers.join(audit(frames), "file_id")
    return store(files, "files"), frames


def decode_log_files(spark: SparkSession, where: Column | None = None, **options: str) -> tuple[DataFrame, DataFrame]:
    """(files, frames) as ``decode`` gives them, read by the source ``sensor_log_files`` (``options``: path, or paths as
    JSON): files of any length in ranges that are decoded apart, and headers from the files' first 64 KiB. ``where``, over
    boot_id and file_start, chooses files by their names."""
    register(spark)
    source = lambda what: spark.read.format("sensor_log_files").options(what=what, **options).load().where(F.lit(True) if where is None else where)
    ranges = source("ranges").withColumn("file_id", F.xxhash64("path"))
    junk, reach = int(options.get("junk", JUNK)), int(options.get("reach", REACH))
    frames = store(decode_ranges(ranges, junk, reach), "frames")
    headers = parse_header(source("heads").withColumn("file_id", F.xxhash64("path"))).drop("content", "length")
    return store(headers.join(audit(frames), "file_id"), "files"), frames


def segmented(records: DataFrame, settings: Settings) -> DataFrame:
    """Records with segments of ``settings.rows_per_segment`` IMU records; without it, of as many as the file's own
    ``file_rows`` says, a column of the records if they have it."""
    if settings.rows_per_segment is None and "file_rows" in records.columns:
        rows = F.coalesce(F.col("file_rows"), F.lit(settings.default_rows))
        return segments.assign_segments(records, rows, settings.jump, settings.block).drop("file_rows")
    return segments.assign_segments(records, settings.rows_per_segment or settings.default_rows, settings.jump, settings.block)


def clock_fits(unwrapped: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(pairs, fits) of unwrapped records with segments."""
    fixes = unwrapped.where("kind = 'GNSS'").withColumn("gnss_utc", gnss_posix_seconds(F.col("posix_timestamp"), F.col("microseconds")))
    pairs = clock.match_nearest(unwrapped.where("kind = 'PPS'"), fixes, span=settings.clock_block)
    pairs = clock.filter_pairs(clock.pulse_utc_second(pairs, settings.ticks))
    return pairs, clock.fit_clock(pairs)


FLAGGED = {"IMU": ["acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z"], "GNSS": ["latitude", "longitude", "ned_vel_north", "ned_vel_east", "ned_vel_down"]}


SEGMENT = ["file_id", "segment"]


def synchronise(records: DataFrame, settings: Settings, trailing: DataFrame | None = None, headers: DataFrame | None = None) -> dict[str, DataFrame]:
    """pps, gnss, imu (kept records with UTC, flags and segment_out) and segments (all, graded). ``headers``, if given, has
    a row per file_id whose other columns every record of the file gets.

    ``trailing``, if given, has file_id and ``more``: whether bytes follow the file's last frame; then a last IMU record
    that fills its segment opens an empty one, which counts in the number of segments."""
    cut = store_by(segmented(records, settings), "segmented", SEGMENT, "offset", buckets=settings.buckets)
    summary = store(unwrap.carry_summary(cut, settings.turn, settings.counter_turn), "carry")
    deviation = int(settings.deviation_seconds * settings.ticks)
    carried = store(unwrap.carry_unwrap_state(summary, settings.turn, settings.counter_turn, settings.carry_from, deviation), "carried")
    unwrapped = unwrap.apply_carry(cut, carried, settings.turn, settings.counter_turn)
    unwrapped = store_by(unwrapped, "unwrapped", SEGMENT, "offset", ("kind",), settings.buckets, laid_out=True)
    _, fits = clock_fits(unwrapped.where("consistency_ok"), settings)
    fits = store(fits, "fits")
    n_fits = fits.count()
    pulses = clock.apply_clock(unwrapped.where("kind = 'PPS'"), fits, n_fits=n_fits)
    counts = unwrapped.groupBy("file_id", "segment").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("PPS", "GNSS", "IMU")], F.first("consistency_ok").alias("consistency_ok"))
    graded = counts.join(fits, ["file_id", "segment"], "left").join(clock.pulse_mismatch(pulses), ["file_id", "segment"], "left")
    if trailing is not None:
        last = cut.groupBy("file_id").agg((F.max("segment") + 1).alias("segments"), F.max_by("imu_filled", "offset").alias("filled"), F.max_by("kind", "offset").alias("last_kind"))
        open_end = last.join(trailing, "file_id", "left").select("file_id", (F.col("segments") + (F.col("filled") & (F.col("last_kind") == "IMU") & F.coalesce("more", F.lit(False))).cast("int")).alias("n_segments"))
        graded = graded.join(open_end, "file_id", "left")
    graded = segments.filter_segments(segments.grade_segments(graded, settings.r2, settings.mismatch))
    graded = store(graded, "segments")
    kept = graded.where("keep").select("file_id", "segment", "segment_out", "slope", "intercept")
    kept = kept if headers is None else kept.join(headers, "file_id", "left")
    rows = unwrapped.join(F.broadcast(kept) if n_fits <= clock.BROADCAST_FITS else kept, ["file_id", "segment"])
    utc = F.col("slope") * F.col("micros_reading_unwrapped") + F.col("intercept")
    rows = rows.withColumn("utc_timestamp_from_pps_regression", utc).withColumn("datetime_timestamp_from_pps_regression", F.timestamp_micros(F.bround(utc * 1e6, 0).cast("long")))
    out = {"segments": graded}
    for kind in ("PPS", "GNSS", "IMU"):
        own = rows.where(F.col("kind") == kind)
        if kind in FLAGGED:
            own = outliers.flag_outliers(own, FLAGGED[kind])
            # segments whose clocks disagree are not tested
            own = own.withColumns({f"{c}_stdchecked": F.col("consistency_ok") & F.col(f"{c}_stdchecked") for c in FLAGGED[kind]})
        out[kind.lower()] = own
    return out


def decode_and_synchronise(raw: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Everything, from raw files to tables ready for write_tables: files, segments, pps, gnss, imu."""
    return synchronise_files(*decode(raw), settings)


def synchronise_files(files: DataFrame, frames: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Tables ready for write_tables from decoded files: files, segments, pps, gnss, imu."""
    records = frames.where("kind <> 'FILE'")
    own = files.select("file_id", "boot_id", F.to_date("file_start").alias("date"), "acc_sensitivity", "gyr_sensitivity")
    ends = records.groupBy("file_id").agg(F.max(F.col("offset") + F.when(F.col("kind") == "IMU", 24).when(F.col("kind") == "PPS", 8).otherwise(40)).alias("end"))
    trailing = ends.join(files.select("file_id", "file_bytes"), "file_id").select("file_id", (F.col("file_bytes") > F.col("end")).alias("more"))
    if settings.rows_per_segment is None:
        # half a row rounds to even, as in the reference; a rate that gives no whole row counts as none
        a_minute = F.when(F.bround(F.col("imu_odr") * 60, 0).between(1, 1e15), F.bround(F.col("imu_odr") * 60, 0).cast("long"))
        records = records.join(files.select("file_id", a_minute.alias("file_rows")), "file_id", "left")
    out = synchronise(records, settings, trailing, own)
    out["imu"] = scale_imu(out["imu"])
    out["gnss"] = scale_gnss(out["gnss"].drop("acc_sensitivity", "gyr_sensitivity"))
    out["pps"] = out["pps"].drop("acc_sensitivity", "gyr_sensitivity")
    return out | {"files": files}


def with_steps(records: DataFrame) -> DataFrame:
    """counter_step and micros_step from the record of the same kind before in the segment, for the quality gates."""
    w = Window.partitionBy("file_id", "segment", "kind").orderBy("offset")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    return records.withColumns({"counter_step": step("counter"), "micros_step": step("micros_reading_unwrapped")})
