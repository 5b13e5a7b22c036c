"""Cutting recordings into segments, counting and filtering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .scan import BEFORE, BLOCK, SO_FAR

FILE = ("file_id",)


def _jumped(step: Column, limit: int) -> Column:
    return F.coalesce((step < 0) | (step > limit), F.lit(False))


def flag_imu_jumps(records: DataFrame, limit: int = 1_000_000, span: int = BLOCK) -> DataFrame:
    """``imu_jump``: an IMU record whose raw clock went back, or forward by more than ``limit``, since the IMU record
    before it in the file. Files are read in blocks of ``span`` offsets."""
    imu = F.col("kind") == "IMU"
    blocked = scan.with_blocks(records, span)
    x = scan.with_halo(blocked, scan.last_before(blocked, ["kind", "micros_reading"], FILE, imu))
    before = F.last(F.when(imu, F.col("micros_reading")), ignorenulls=True).over(scan.within(FILE).rowsBetween(*BEFORE))
    return scan.plain_rows(x.withColumn("imu_jump", F.coalesce(imu & _jumped(F.col("micros_reading") - before, limit), F.lit(False))))


def _segment_state(blocked: DataFrame, rows: Column, limit: int) -> DataFrame:
    """What each block has to know of those before it: the last IMU reading (as an IMU record), how many IMU records the
    running series since the last jump has (__run), and how many segments have been opened (__opened).

    A block tells, without knowing those before it: its first and last reading, how many IMU records it has (n), how many
    of them lie before its first jump (head) and from its last one on (tail), and what is opened between."""
    local = Window.partitionBy("file_id", "__block").orderBy("offset")
    imu = F.col("kind") == "IMU"
    opened_in = lambda n: F.when(n > 0, F.floor((n - 1) / F.col("__rows"))).otherwise(0)  # noqa: E731  by a series of n, beyond its start
    x = blocked.select("file_id", "__block", "offset", "kind", "micros_reading", rows.alias("__rows"))
    before = F.last(F.when(imu, F.col("micros_reading")), ignorenulls=True).over(local.rowsBetween(*BEFORE))
    x = x.withColumns({"jump": imu & _jumped(F.col("micros_reading") - before, limit), "so_far": F.sum(imu.cast("long")).over(local.rowsBetween(*SO_FAR))})
    start = F.when(F.col("jump"), F.col("so_far") - 1)
    x = x.withColumn("ended", F.col("so_far") - 1 - F.max(start).over(local.rowsBetween(*BEFORE)))  # at a jump: the series since the one before
    at = F.when(imu, F.col("offset"))
    summary = x.groupBy("file_id", "__block").agg(
        F.min_by("micros_reading", at).alias("first"), F.max_by("micros_reading", at).alias("last"), F.count_if(imu).alias("n"), F.max("__rows").alias("__rows"),
        F.min(start).alias("head"), F.max(start).alias("tail_at"), F.count_if(F.col("jump")).alias("jumps"), F.coalesce(F.sum(F.when(F.col("jump"), opened_in(F.col("ended")))), F.lit(0)).alias("between"),
    )
    prior = scan.blocks_before(FILE)
    s = summary.withColumns({"reading": F.last("last", ignorenulls=True).over(prior), "n_before": F.coalesce(F.sum("n").over(prior), F.lit(0))})
    s = s.withColumn("cut", _jumped(F.col("first") - F.col("reading"), limit))
    begun = F.when(F.col("jumps") > 0, F.col("n_before") + F.col("tail_at")).when(F.col("cut"), F.col("n_before"))
    s = s.withColumn("run", F.col("n_before") - F.coalesce(F.max(begun).over(prior), F.lit(0)))
    head = F.coalesce("head", "n")
    opens = F.when(F.col("cut"), 1 + opened_in(head)).otherwise(opened_in(F.col("run") + head) - opened_in(F.col("run")))
    s = s.withColumn("opens", opens + F.when(F.col("jumps") > 0, F.col("jumps") + F.col("between") + opened_in(F.col("n") - F.col("tail_at"))).otherwise(0))
    return s.select("file_id", "__block", F.lit("IMU").alias("kind"), F.col("reading").alias("micros_reading"), F.col("run").alias("__run"), F.coalesce(F.sum("opens").over(prior), F.lit(0)).alias("__opened"))


def assign_segments(records: DataFrame, rows_per_segment: int | Column, limit: int = 1_000_000, span: int | None = None) -> DataFrame:
    """``segment`` from 0: a jumped IMU record opens one, and so does the record after ``rows_per_segment`` IMU records.
    PPS and GNSS records belong where they lie in the file. ``imu_filled`` tells whether the last IMU record so far has
    filled its segment. ``rows_per_segment`` may be a column, one value per file.

    With ``span`` files may be of any length: records are shuffled and sorted once, by blocks of so many offsets, and each
    block learns from a table of all blocks where the series and the count of segments stand. That table is made from
    four columns. Without it a file is read in one piece, and there is no such table."""
    rows = rows_per_segment if isinstance(rows_per_segment, Column) else F.lit(rows_per_segment)
    if span is None:
        w = Window.partitionBy(*FILE).orderBy("offset")
        x, run, begun = records.withColumns({"__row": F.lit(1), "__block": F.lit(0)}), F.lit(0), F.lit(0)
    else:
        blocked = scan.with_blocks(records, span)
        w = scan.within(FILE)
        x, run, begun = scan.with_halo(blocked, _segment_state(blocked, rows, limit)), scan.carried("__run", FILE), scan.carried("__opened", FILE)
    so_far = w.rowsBetween(*SO_FAR)
    of_imu, imu = F.col("kind") == "IMU", (F.col("kind") == "IMU") & (F.col("__row") == 1)
    before = F.last(F.when(of_imu, F.col("micros_reading")), ignorenulls=True).over(w.rowsBetween(*BEFORE))
    x = x.withColumns({"imu_jump": imu & _jumped(F.col("micros_reading") - before, limit), "so_far": F.sum(imu.cast("long")).over(so_far), "run": run, "begun": begun})
    # a record's place since the last jump: the running count less what it was before that
    x = x.withColumn("nth", F.col("so_far") - F.coalesce(F.max(F.when(F.col("imu_jump"), F.col("so_far") - 1)).over(so_far), -F.col("run")))
    opens = imu & (F.col("imu_jump") | ((F.col("nth") > 1) & ((F.col("nth") - 1) % rows == 0)))
    filled = (F.col("nth") > 0) & (F.col("nth") % rows == 0)
    x = x.withColumn("imu_filled", filled).withColumn("opened", F.col("begun") + F.sum(opens.cast("int")).over(so_far))
    x = x.withColumn("segment", (F.col("opened") + F.when(~imu & filled, 1).otherwise(0)).cast("int"))
    return scan.plain_rows(x, "so_far", "nth", "opened", "run", "begun", "__run", "__opened")


def segment_counts(records: DataFrame) -> DataFrame:
    """Records per kind of each segment and, with a null segment, of each file."""
    n = [F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("PPS", "GNSS", "IMU")]
    return records.rollup("file_id", "segment").agg(*n, F.grouping_id().alias("level")).where("level < 3").drop("level")


def grade_segments(segments: DataFrame, r2: float = 0.99, mismatch: float = 0.2) -> DataFrame:
    """``regression_valid``: a fit exists, explains enough, and no pulse is off by more than ``mismatch`` seconds."""
    good = F.col("slope").isNotNull() & (F.col("r_squared") >= r2) & (F.coalesce("max_mismatch", F.lit(0.0)) <= mismatch)
    return segments.withColumn("regression_valid", F.coalesce(good & F.col("consistency_ok"), F.lit(False)))


def filter_segments(segments: DataFrame) -> DataFrame:
    """``keep``, ``skip_reason`` and the dense ``segment_out`` of the kept. Only files with GNSS and several segments
    lose any: those with under 2 PPS or no GNSS are ``small``, the others without a valid fit are ``poor``.

    ``n_segments`` may give the number of segments of the file including an empty last one."""
    whole = Window.partitionBy("file_id")
    several = F.coalesce(F.col("n_segments"), F.count(F.lit(1)).over(whole)) if "n_segments" in segments.columns else F.count(F.lit(1)).over(whole)
    choosy = (F.max("n_gnss").over(whole) > 0) & (several > 1)
    reason = F.when(choosy & ((F.col("n_pps") < 2) | (F.col("n_gnss") < 1)), "small").when(choosy & ~F.col("regression_valid"), "poor")
    x = segments.withColumn("skip_reason", reason).withColumn("keep", F.col("skip_reason").isNull())
    rank = F.sum(F.col("keep").cast("int")).over(whole.orderBy("segment").rowsBetween(*SO_FAR)) - 1
    return x.withColumn("segment_out", F.when(F.col("keep"), rank).cast("int"))


def kept_rows(records: DataFrame, segments: DataFrame) -> DataFrame:
    """The records of kept segments."""
    return records.join(segments.where("keep").select("file_id", "segment"), ["file_id", "segment"], "left_semi")
