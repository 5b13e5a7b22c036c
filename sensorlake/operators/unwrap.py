"""Unwrapping counters of fixed width, within segments and across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry, scan
from .carry import SENSORS
from .scan import SO_FAR

WRAP_SHARE, JUMP_SHARE, CARRY_FROM = 0.25, 0.1, 10
MICROS, COUNTER = 2**32, 2**16


def _series(*keys: str):
    return Window.partitionBy("file_id", "segment", *keys).orderBy("offset")


def _wrapped_before(blocked: DataFrame, value: str, max_value: int, keys: tuple[str, ...]) -> DataFrame:
    """Per block the last value before it, and the number of wraps so far, but for one at its first row (__wraps)."""
    local = Window.partitionBy(*keys, "__block").orderBy("offset")
    wraps = F.count_if(F.col("back") > WRAP_SHARE * max_value)
    thin = blocked.select(*keys, "__block", "offset", value).withColumn("back", F.lag(value).over(local) - F.col(value))
    summary = thin.groupBy(*keys, "__block").agg(F.min_by(value, "offset").alias("first"), F.max_by(value, "offset").alias("last"), wraps.alias("wraps"))
    step = F.coalesce(F.lag("last").over(Window.partitionBy(*keys).orderBy("__block")) - F.col("first") > WRAP_SHARE * max_value, F.lit(False))
    summary = summary.withColumn("wraps", F.col("wraps") + step.cast("long"))
    prior = scan.blocks_before(keys)
    return summary.select(*keys, "__block", F.last("last").over(prior).alias(value), F.coalesce(F.sum("wraps").over(prior), F.lit(0)).alias("__wraps"))


def unwrap_counter(rows: DataFrame, value: str, max_value: int, out: str | None = None, keys: tuple[str, ...] = ("kind",), start: Column | None = None, span: int | None = None) -> DataFrame:
    """``out`` (``<value>_unwrapped``): the value plus ``max_value`` for each step back by more than a quarter of it so
    far in the segment, plus ``start``. ``<value>_wrap`` marks those steps.

    A segment is read in one piece; with ``span`` in blocks of so many offsets, for segments of any length."""
    w = _series(*keys)
    if span is not None:
        by = ("file_id", "segment", *keys)
        blocked = scan.with_blocks(rows, span)
        rows, w = scan.with_halo(blocked, _wrapped_before(blocked, value, max_value, by)), scan.within(by)
    back = F.lag(value).over(w) - F.col(value)
    x = rows.withColumn(f"{value}_wrap", F.coalesce(back > WRAP_SHARE * max_value, F.lit(False)))
    wraps = F.sum(F.col(f"{value}_wrap").cast("long")).over(w.rowsBetween(*SO_FAR))
    wraps = wraps if span is None else wraps + scan.carried("__wraps", by)
    x = x.withColumn(out or f"{value}_unwrapped", F.col(value) + wraps * max_value + (F.lit(0) if start is None else start))
    return x if span is None else scan.plain_rows(x, "__wraps")


def carry_summary(rows: DataFrame, max_value: int = MICROS, counter_max: int = COUNTER) -> DataFrame:
    """Per segment what the carry needs: for each kind n, the first and last raw value, wraps inside, and the least and
    greatest unwrapped value before any carry; for the IMU counter the same but for the range."""
    x = unwrap_counter(unwrap_counter(rows, "micros_reading", max_value, "rel"), "counter", counter_max, "counter_rel")
    aggregates = []
    for s in SENSORS:
        own = F.col("kind") == s.upper()
        of = lambda f, c, own=own: f(F.when(own, F.col(c)))
        at = lambda f, c, own=own: f(F.when(own, F.col(c)), F.when(own, F.col("offset")))
        fields = [
            F.count_if(own).alias("n"),
            at(F.min_by, "micros_reading").alias("first"),
            at(F.max_by, "micros_reading").alias("last"),
            F.count_if(own & F.col("micros_reading_wrap")).alias("wraps"),
            of(F.min, "rel").alias("low"),
            of(F.max, "rel").alias("high"),
        ]
        aggregates.append(F.struct(*fields).alias(s))
    imu = F.col("kind") == "IMU"
    counter = F.struct(F.min_by(F.when(imu, F.col("counter")), F.when(imu, F.col("offset"))).alias("first"), F.max_by(F.when(imu, F.col("counter")), F.when(imu, F.col("offset"))).alias("last"), F.count_if(imu & F.col("counter_wrap")).alias("wraps"))
    return x.groupBy("file_id", "segment").agg(*aggregates, counter.alias("counter"))


def carry_unwrap_state(summary: DataFrame, max_value: int = MICROS, counter_max: int = COUNTER, carry_from: int = CARRY_FROM, deviation: int = 10_000_000, chunk: int = carry.CHUNK) -> DataFrame:
    """Per segment the offsets that it starts with, and whether its sensors' clocks agree (spread of the sensors' least
    and of their greatest values within ``deviation`` ticks).

    A segment starts where the one before ended, plus one turn if its first value lies back by more than a quarter. A
    sensor with under ``carry_from`` records hands on nothing, and neither does any sensor of a segment whose clocks
    disagree. Segments are walked in chunks of ``chunk``, side by side also within a file (see ``carry``)."""
    return carry.carry(summary, carry.Rules(WRAP_SHARE, max_value, counter_max, carry_from, deviation), chunk)


def apply_carry(rows: DataFrame, carried: DataFrame, max_value: int = MICROS, counter_max: int = COUNTER) -> DataFrame:
    """micros_reading_unwrapped and, for IMU, counter_unwrapped; ``*_wrap`` also marks a turn between two segments, at
    the first record of the later one."""
    joined = rows.join(carried, ["file_id", "segment"], "left")
    kind, imu = F.col("kind"), F.col("kind") == "IMU"
    own = lambda what: F.when(kind == "PPS", F.col(f"pps_{what}")).when(kind == "GNSS", F.col(f"gnss_{what}")).otherwise(F.col(f"imu_{what}"))
    x = unwrap_counter(joined, "micros_reading", max_value, start=F.coalesce(own("start"), F.lit(0)))
    x = unwrap_counter(x, "counter", counter_max, start=F.coalesce("counter_start", F.lit(0)))
    first = F.row_number().over(_series("kind")) == 1
    x = x.withColumn("micros_reading_wrap", F.col("micros_reading_wrap") | (first & F.coalesce(own("turned"), F.lit(False))))
    x = x.withColumn("counter_wrap", imu & (F.col("counter_wrap") | (first & F.coalesce("counter_turned", F.lit(False)))))
    spare = [f"{s}_{what}" for s in (*SENSORS, "counter") for what in ("start", "turned")]
    return x.withColumn("counter_unwrapped", F.when(imu, F.col("counter_unwrapped"))).drop(*spare)


def _indexed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("index", F.row_number().over(_series(*keys)) - 1)


def wrap_events(rows: DataFrame, value: str, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Positions in the segment, from 0, at which ``value`` wrapped (``<value>_wrap`` as unwrap_counter marks it)."""
    return _indexed(rows, keys).where(F.col(f"{value}_wrap")).select("file_id", "segment", *keys, "index")


def jump_events(rows: DataFrame, value: str, threshold: float, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Positions at which the unwrapped value went back, or forward by more than ``threshold``."""
    step = F.col(f"{value}_unwrapped") - F.lag(f"{value}_unwrapped").over(_series(*keys))
    marked = rows.withColumn("step", step)
    return _indexed(marked, keys).where((F.col("step") < 0) | (F.col("step") > threshold)).select("file_id", "segment", *keys, "index", "step")


def unwrap_stats(rows: DataFrame, value: str, threshold: float, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Per segment and kind: numbers and positions of wraps and jumps of ``value``."""
    step = F.col(f"{value}_unwrapped") - F.lag(f"{value}_unwrapped").over(_series(*keys))
    x = _indexed(rows.withColumn("jump", F.coalesce((step < 0) | (step > threshold), F.lit(False))), keys)
    wrap = F.col(f"{value}_wrap")
    at = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("index").cast("long"))))
    return x.groupBy("file_id", "segment", *keys).agg(F.count_if(wrap).alias("wraps"), F.count_if(F.col("jump")).alias("jumps"), at(wrap).alias("wrap_indices"), at(F.col("jump")).alias("jump_indices"))
