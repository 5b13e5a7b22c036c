"""From the device clock to UTC: pairs of pulses and fixes, a line per segment, and how good it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .outliers import flag_outliers
from .scan import SO_FAR, blocks_before

#: Ticks of the device clock in a second.
TICKS = 1_000_000
SERIES = ("file_id", "segment")
PAIRS_TO_FILTER, PAIR_NEIGHBOURS, PAIR_SIGMA = 7, 4, 1


def check_clock_consistency(records: DataFrame, value: str = "micros_reading_unwrapped", seconds: float = 10.0, ticks: int = TICKS) -> DataFrame:
    """Per segment the spread of the kinds' least and of their greatest values; ``consistency_ok`` unless either is
    over ``seconds``. Nulls are left out, and one kind alone agrees with itself."""
    per_kind = records.groupBy("file_id", "segment", "kind").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    spread = per_kind.groupBy("file_id", "segment").agg((F.max("low") - F.min("low")).alias("min_spread"), (F.max("high") - F.min("high")).alias("max_spread"))
    return spread.withColumn("consistency_ok", F.coalesce(F.greatest("min_spread", "max_spread") <= int(seconds * ticks), F.lit(True)))


def _fixes_beside(both: DataFrame) -> DataFrame:
    """For each block the last fix before it and the first one after it, as rows of the block. A block's own first and last
    fix are all that the table of blocks holds, so it is small however many fixes there are."""
    fix = F.when(F.col("is_fix") == 1, F.struct("offset", "micros", "gnss_utc"))
    # of equal clocks the first in the file counts, at either end
    ends = both.groupBy(*SERIES, "__block").agg(F.min_by(fix, F.when(fix.isNotNull(), F.struct("micros", "offset"))).alias("first"), F.max_by(fix, F.when(fix.isNotNull(), F.struct(F.col("micros"), -F.col("offset")))).alias("last"))
    by = ", ".join(SERIES)
    beside = ends.select(*SERIES, "__block", F.last("last", ignorenulls=True).over(blocks_before(SERIES)).alias("before"), F.expr(f"lead(first) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY __block)").alias("after"))
    rows = beside.select(*SERIES, "__block", F.explode(F.array("before", "after")).alias("fix")).where("fix IS NOT NULL")
    return rows.select(*SERIES, "fix.*", F.lit(1).alias("is_fix"), "__block")


def match_nearest(pulses: DataFrame, fixes: DataFrame, value: str = "micros_reading_unwrapped", span: int | None = None) -> DataFrame:
    """Each pulse with the fix of its segment whose clock is nearest, the earlier one on a tie; pulses of segments
    without fixes have none, nor do pulses without a clock. ``fixes`` has gnss_utc; those without a clock don't count.

    An as-of join by union: the last fix before and the first fix from then on come from windows of one order over the
    segment, so nothing is multiplied and rows are sorted once; of fixes with equal clocks the first in the file counts.
    A segment is read in one piece; with ``span`` in blocks of so many ticks, for segments of any length, each with the
    nearest fix on either side of it."""
    columns = ["file_id", "segment", "offset", "micros"]
    p = pulses.select("file_id", "segment", "offset", F.col(value).alias("micros"), F.lit(None).cast("double").alias("gnss_utc"))
    g = fixes.where(F.col(value).isNotNull()).select("file_id", "segment", "offset", F.col(value).alias("micros"), "gnss_utc")
    both = p.withColumn("is_fix", F.lit(0)).unionByName(g.withColumn("is_fix", F.lit(1)))
    keys = SERIES
    if span is not None:
        both, keys = both.withColumn("__block", F.floor(F.col("micros") / span)), (*SERIES, "__block")
        both = both.unionByName(_fixes_beside(both))
    in_order = Window.partitionBy(*keys).orderBy("micros", "is_fix", F.col("offset").desc())
    again = (F.lead("is_fix").over(in_order) == 1) & (F.lead("micros").over(in_order) == F.col("micros"))
    counts = (F.col("is_fix") == 1) & ~F.coalesce(again, F.lit(False))
    x = both.withColumn("__fix", F.when(counts, F.struct(F.col("micros").alias("gnss_micros"), "gnss_utc")))
    after = F.expr(f"lead(__fix) IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY micros, is_fix, offset DESC)")
    near = x.withColumns({"before": F.last("__fix", ignorenulls=True).over(in_order.rowsBetween(*SO_FAR)), "after": after}).where("is_fix = 0")
    back, ahead = F.col("micros") - F.col("before.gnss_micros"), F.col("after.gnss_micros") - F.col("micros")
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    return near.withColumn("fix", pick).select(*columns, "fix.gnss_micros", "fix.gnss_utc")


def pulse_utc_second(pairs: DataFrame, ticks: int = TICKS) -> DataFrame:
    """``utc_second``: the whole second that the pulse marks, half to even."""
    return pairs.withColumn("utc_second", F.bround(F.col("gnss_utc") + (F.col("micros") - F.col("gnss_micros")) / ticks, 0).cast("long"))


def filter_pairs(pairs: DataFrame) -> DataFrame:
    """``used``: pairs of a segment with 7 or more of them lose those whose clock or second stands out from its 4
    neighbours by more than one deviation, unless under 2 would be left."""
    known = pairs.where(F.col("utc_second").isNotNull())
    flagged = flag_outliers(known, ["micros", "utc_second"], PAIR_NEIGHBOURS, PAIR_SIGMA, suffix="_off", least_rows=1)
    whole = Window.partitionBy("file_id", "segment")
    off = F.col("micros_off") | F.col("utc_second_off")
    n = F.count(F.lit(1)).over(whole)
    x = flagged.withColumn("__n", n).withColumn("__left", F.count_if(~off).over(whole))
    return x.withColumn("used", (F.col("__n") < PAIRS_TO_FILTER) | (F.col("__left") < 2) | ~off).drop("__n", "__left", "micros_off", "utc_second_off")


def fit_clock(pairs: DataFrame) -> DataFrame:
    """Per segment slope, intercept and r_squared of UTC over the clock, n_pairs and n_pairs_used. Sums are taken from
    each segment's own least values, as UTC has ten digits and a slope six zeros. Null where a segment has under two
    pulses or no spread."""
    whole = Window.partitionBy("file_id", "segment")
    x = pairs.withColumns({"x0": F.min("micros").over(whole), "y0": F.min("utc_second").over(whole)})
    x = x.withColumns({"x": (F.col("micros") - F.col("x0")).cast("double"), "y": (F.col("utc_second") - F.col("y0")).cast("double")})
    used = lambda c: F.when(F.col("used"), F.col(c))
    fit = x.groupBy("file_id", "segment").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("used").alias("n_pairs_used"), F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.regr_slope(used("y"), used("x")).alias("slope"), F.regr_intercept(used("y"), used("x")).alias("at0"), F.regr_r2(used("y"), used("x")).alias("r_squared"), F.max(used("y")).alias("top"), F.min(used("y")).alias("bottom"))
    good = (F.col("n_pairs") >= 2) & F.col("slope").isNotNull() & (F.col("top") > F.col("bottom"))
    return fit.select("file_id", "segment", "n_pairs", "n_pairs_used", F.when(good, F.col("slope")).alias("slope"), F.when(good, F.col("y0") + F.col("at0") - F.col("slope") * F.col("x0")).alias("intercept"), F.when(good, F.col("r_squared")).alias("r_squared"))


#: Rows of fits that a broadcast may hold, at about 60 bytes each.
BROADCAST_FITS = 200_000


def apply_clock(records: DataFrame, fits: DataFrame, value: str = "micros_reading_unwrapped", n_fits: int | None = None) -> DataFrame:
    """utc_timestamp_from_pps_regression and datetime_timestamp_from_pps_regression of each record; null without a fit.
    ``n_fits``, the number of fits if it is known, decides between broadcast and shuffle."""
    own = fits.select("file_id", "segment", "slope", "intercept")
    own = F.broadcast(own) if n_fits is not None and n_fits <= BROADCAST_FITS else own
    utc = F.col("slope") * F.col(value) + F.col("intercept")
    x = records.join(own, ["file_id", "segment"], "left").withColumn("utc_timestamp_from_pps_regression", utc)
    return x.withColumn("datetime_timestamp_from_pps_regression", F.timestamp_micros(F.bround(utc * 1e6, 0).cast("long"))).drop("slope", "intercept")


def pulse_mismatch(pulses: DataFrame, utc: str = "utc_timestamp_from_pps_regression") -> DataFrame:
    """Per segment the greatest, mean and root mean square distance of the pulses' UTC from a whole second."""
    off = F.col(utc) - F.bround(utc, 0)
    return pulses.groupBy("file_id", "segment").agg(F.max(F.abs(off)).alias("max_mismatch"), F.avg(off).alias("mean_mismatch"), F.sqrt(F.avg(off * off)).alias("rms_mismatch"))
