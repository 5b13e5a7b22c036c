"""The given ``events`` table seen as a sensor log, and as raw files.

A user is a device with one file; ``error`` events are pulses, ``signup`` events fixes, all others IMU records. The
clock ticks every 64 microseconds in 32 bits, so it turns about every 76 hours; the counter has 8 bits. Offsets are
microseconds, and a block is two days of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .plans import Settings

SETTINGS = Settings(turn=2**32, counter_turn=256, ticks=15_625, jump=2**31, rows_per_segment=8, carry_from=3, deviation_seconds=144_000.0, r2=0.99, mismatch=0.2, block=2 * 86_400_000_000)

#: Frames in a part of a raw file; and the time, a logger's 15 minutes, within which frames are numbered at once.
PART_FRAMES, SLOT_MICROS = 65_536, 900_000_000


def event_micros(events: DataFrame) -> Column:
    """Microseconds since 1970, whether the column has a time zone or not."""
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return F.unix_micros("ts")


def sensor_log(events: DataFrame) -> DataFrame:
    x = events.withColumn("us", event_micros(events))
    kind = F.when(F.col("event_type") == "error", "PPS").when(F.col("event_type") == "signup", "GNSS").otherwise("IMU")
    whole = lambda c: F.floor(c).cast("long")
    v, e = F.col("value"), F.col("event_id")
    return x.select(
        F.col("user_id").alias("file_id"),
        F.col("us").alias("offset"),
        kind.alias("kind"),
        (F.expr("us div 64") % 2**32).alias("micros_reading"),
        (e % 256).alias("counter"),
        whole(v * 100).alias("acc_x"), (whole(v * 10) % 50).alias("acc_y"), (e % 17).alias("acc_z"),
        whole(v).alias("gyr_x"), (e * 7 % 23).alias("gyr_y"), (e % 5).alias("gyr_z"),
        (500_000_000 + whole(v * 1000)).alias("latitude"), (-70_000_000 + e % 1000).alias("longitude"),
        whole(v * 3).alias("ned_vel_north"), (e % 101).alias("ned_vel_east"), (e % 7).alias("ned_vel_down"),
        F.expr("us div 1000000").alias("posix_timestamp"), (F.col("us") % 1_000_000).alias("microseconds"),
        v.alias("value"),
    )


def _le(value: Column, n: int) -> Column:
    """Hexadecimal digits of the value's low ``n`` bytes, least first."""
    digits = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << (8 * n)))), 2 * n, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(n - 1, -1, -1)])


def raw_files(log: DataFrame, part_frames: int = PART_FRAMES) -> DataFrame:
    """file_id, part, path, base and content: the log as raw files, one per device, in parts of ``part_frames`` frames
    at most. ``base`` is the place in the file of the part's first byte; part 0 has the header, the last one the footer.
    Values are cut to the widths of the frames.

    Frames are numbered by slots of time: the windows are within a slot, and only counts per slot are summed over a
    file, so a long file is spread over many tasks and no value holds more than a part."""
    text = lambda s: F.lit(s.encode().hex())
    imu = F.concat(text("\nIMU"), _le(F.col("micros_reading"), 4), _le(F.col("counter"), 2), *[_le(F.col(f"{s}_{a}"), 2) for s in ("acc", "gyr") for a in "xyz"], text("\0\0"))
    gnss = F.concat(text("\nGPS"), *[_le(F.col(c), 4) for c in ("micros_reading", "latitude", "longitude", "posix_timestamp", "microseconds", "ned_vel_north", "ned_vel_east", "ned_vel_down")], text("\3\0\0\0"))
    pps = F.concat(text("\nPPS"), _le(F.col("micros_reading"), 4))
    frame = F.when(F.col("kind") == "PPS", pps).when(F.col("kind") == "GNSS", gnss).otherwise(imu)
    size = F.when(F.col("kind") == "PPS", 8).when(F.col("kind") == "GNSS", 40).otherwise(24).cast("long")
    slot = F.expr(f"offset div {SLOT_MICROS}")
    whole = Window.partitionBy("of")
    before = whole.orderBy("of_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = log.groupBy(F.col("file_id").alias("of"), slot.alias("of_slot")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.min("offset").alias("first"))
    slots = slots.select("of", "of_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.sum("n").over(whole).alias("total"), F.min("first").over(whole).alias("start"))
    frames = log.select("file_id", "offset", slot.alias("slot"), frame.alias("hex"), size.alias("size"))
    frames = frames.join(slots, F.col("file_id").eqNullSafe(F.col("of")) & F.col("slot").eqNullSafe(F.col("of_slot")))
    so_far = Window.partitionBy("file_id", "slot").orderBy("offset", "hex").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frames = frames.withColumns({"at": F.col("n_before") + F.count(F.lit(1)).over(so_far) - 1, "byte": F.col("bytes_before") + F.sum("size").over(so_far) - F.col("size")})
    frames = frames.withColumn("part", F.expr(f"at div {part_frames}"))
    per = frames.groupBy("file_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "hex"))).alias("frames"), F.min("byte").alias("byte"), F.max("total").alias("total"), F.min("start").alias("start"))
    header = "Log start OLA ISM330DHCX SAM-M10Q logger\n\nFirmware commit ID: {}\nISM330DHCX Acc sensitivity (mg/LSB): 0.061000\nISM330DHCX Gyr sensitivity (mdps/LSB): 4.375000\nISM330DHCX ODR (Hz): 417.00\nGNSS update rate (Hz): 10\n"
    before_id, after_id = header.split("{}")
    head = F.concat(text(before_id), F.hex(F.concat(F.lit("c"), F.col("file_id").cast("string"))), text(after_id))
    footer = text("\n\nLog stop OLA ISM330DHCX SAM-M10Q logger\n")
    first, last = F.col("part") == 0, F.col("part") == F.expr(f"(total - 1) div {part_frames}")
    content = F.unhex(F.concat(F.when(first, head).otherwise(""), F.array_join(F.transform("frames", lambda f: f["hex"]), ""), F.when(last, footer).otherwise("")))
    base = F.when(first, 0).otherwise(F.col("byte") + F.expr("length(head) div 2")).cast("long")
    moment = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.expr("start div 1000000").cast("decimal(18,6)"))
    boot = F.lpad(F.col("file_id").cast("string"), 6, "0")
    path = F.concat(F.lit("lake/BOOT_"), boot, F.lit("/DATA_BOOT_"), boot, F.lit("_TIME_"), F.date_format(moment, "yyyyMMdd'T'HHmmss"), F.lit(".dat"))
    return per.withColumn("head", head).select("file_id", "part", path.alias("path"), base.alias("base"), content.alias("content"))


def file_heads(log: DataFrame) -> DataFrame:
    """The first part of each raw file, which has its whole header."""
    return raw_files(log).where("part = 0")
