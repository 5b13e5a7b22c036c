"""Steps, gaps and places of records along a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .scan import BLOCK

KIND = ("file_id", "kind")


def normalized_index(records: DataFrame, span: int = BLOCK) -> DataFrame:
    """``normalized_index``: a record's place among its kind in the file, from 0 to under 1. Files are read in blocks of
    ``span`` offsets, here and below."""
    x = scan.numbered(records, KIND, span)
    return x.withColumn("normalized_index", (F.col("__nth") - 1) / F.col("__all")).drop("__nth", "__all")


def relative_time(records: DataFrame, utc: str, span: int = BLOCK) -> DataFrame:
    """``relative_time``: seconds since the first record of the kind in the file."""
    x = scan.numbered(records, KIND, span, {"__first": F.min(F.struct("offset", F.col(utc).alias("utc")))})
    return x.withColumn("relative_time", F.col(utc) - F.col("__first.utc")).drop("__nth", "__all", "__first")


def consecutive_dt(records: DataFrame, utc: str, ticks: int = 1_000_000, span: int = BLOCK) -> DataFrame:
    """``dt_raw_ms`` and ``dt_utc_ms``: steps from the record of the same kind before, across segments. Wraps of the raw
    clock stay visible."""
    step = lambda c: F.col(c) - F.lag(c).over(scan.within(KIND))
    x = scan.with_previous(records, ["micros_reading", utc], KIND, span)
    return scan.plain_rows(x.withColumns({"dt_raw_ms": step("micros_reading") * 1000 / ticks, "dt_utc_ms": step(utc) * 1000.0}))


def dt_stats(steps: DataFrame) -> DataFrame:
    """Mean and population deviation of the steps per file and kind."""
    return steps.groupBy("file_id", "kind").agg(*[f(c).alias(f"{n}_{c}") for c in ("dt_raw_ms", "dt_utc_ms") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def counter_gaps(imu: DataFrame, value: str = "counter_unwrapped", wrap: int = 60_000, span: int = BLOCK) -> DataFrame:
    """Steps of the unwrapped counter other than 1: ``missed`` samples, and whether the step counts as a wrap."""
    x = scan.with_previous(imu, [value], ("file_id",), span)
    x = scan.plain_rows(x.withColumn("step", F.col(value) - F.lag(value).over(scan.within(("file_id",)))))
    step = F.col("step")
    return x.where(step != 1).select("file_id", "offset", "step", (step > wrap).alias("is_wrap"), F.when(step <= wrap, step - 1).alias("missed"))


def debounce_pulses(pulses: DataFrame, least: int = 500_000, turn: int = 2**32, span: int = BLOCK) -> DataFrame:
    """``kept``: pulses at least ``least`` ticks after the one before, which counts even if it was dropped; the first is
    compared with 0. Differences are taken modulo the clock's range."""
    x = scan.with_previous(pulses, ["micros_reading"], ("file_id",), span)
    before = F.lag("micros_reading", 1, 0).over(scan.within(("file_id",)))
    return scan.plain_rows(x.withColumn("kept", F.pmod(F.col("micros_reading") - before, F.lit(turn)) >= least))


def head_tail_sample(records: DataFrame, n: int = 10) -> DataFrame:
    """The first and last ``n`` records of each kind in each file, with ``place`` head, tail or both.

    Each end is a ranking that Spark cuts to 2n rows a group within every task, before it shuffles them, so no file is
    gathered whole. A group of under 2n records is all in the first ranking; only of larger ones the second is used."""
    group = Window.partitionBy(*KIND)

    def end(order):
        x = records.withColumn("__rank", F.row_number().over(group.orderBy(order))).where(F.col("__rank") <= 2 * n)
        return x.withColumn("__n", F.count(F.lit(1)).over(group))

    rank, few = F.col("__rank"), F.col("__n") < 2 * n
    place = F.when(few & (rank <= n) & (F.col("__n") - rank < n), "both").when(rank <= n, "head").when(few, "tail")
    head = end(F.col("offset")).withColumn("place", place).where("place IS NOT NULL")
    tail = end(F.col("offset").desc()).where(~few & (rank <= n)).withColumn("place", F.lit("tail"))
    return head.unionByName(tail).drop("__rank", "__n")
