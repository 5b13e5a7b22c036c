"""Local n-sigma tests against neighbouring records, and means without outliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_ROWS = 5
#: Rows of a float series that a task takes at a time.
BLOCK = 65_536


def flag_outliers(rows: DataFrame, columns: list[str], neighbours: int = 6, sigma: int = 5, keys: tuple[str, ...] = ("file_id", "segment"), order: str = "offset", suffix: str = "_stdchecked", least_rows: int = LEAST_ROWS) -> DataFrame:
    """``<column><suffix>`` for integer columns: whether the value is more than ``sigma`` sample deviations from the
    mean of its ``neighbours`` (half on each side; at the ends the nearest ones, never itself).

    Nulls are flagged and aren't neighbours. With fewer rows than neighbours + 1 only nulls are flagged, and in series
    of under ``least_rows`` rows nothing is. The test is exact: with m neighbours of sum S and square sum Q it reads
    (m-1)(mx-S)^2 > sigma^2 m (mQ-S^2), on values less the series' least, in 64 bits for columns of 16 bits or fewer and
    in decimals for wider ones. Sums over a row's neighbours are differences of two running sums of the series, so a row
    costs the same however many neighbours there are, and all columns share one sort."""
    half = neighbours // 2
    series = Window.partitionBy(*keys)
    ordered = series.orderBy(order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    short = {k: dict(rows.dtypes)[c] in ("tinyint", "smallint") for k, c in enumerate(columns)}
    x = rows.withColumns({"__n": F.count(F.lit(1)).over(series), "__at": F.row_number().over(ordered), **{f"__b_{k}": F.col(c).cast("long") - F.min(F.col(c).cast("long")).over(series) for k, c in enumerate(columns)}})
    running = {}
    for k in short:
        v = F.col(f"__b_{k}") if short[k] else F.col(f"__b_{k}").cast("decimal(12,0)")
        for name, term in (("m", F.col(f"__b_{k}").isNotNull().cast("long")), ("s", v), ("q", v * v)):
            running[f"{name}_{k}"] = F.coalesce(F.sum(term).over(so_far), F.lit(0))
    x = x.withColumns({f"__{name}": c for name, c in running.items()})
    x = x.withColumn("__sums", F.struct(*[F.col(f"__{name}").alias(name) for name in running])).drop(*[f"__{name}" for name in running])
    # how many rows behind its own the last of a row's neighbours lies
    reach = F.when(F.col("__at") <= half, neighbours + 1 - F.col("__at")).when(F.col("__at") > F.col("__n") - half, F.col("__n") - F.col("__at")).otherwise(half)
    ends, starts = ([F.lead("__sums", d).over(ordered) for d in range(neighbours + 1)], [F.lag("__sums", neighbours + 1 - d).over(ordered) for d in range(neighbours + 1)])
    x = x.withColumns({"__reach": reach, **{f"__e{d}": c for d, c in enumerate(ends)}, **{f"__s{d}": c for d, c in enumerate(starts)}})
    pick = lambda name: F.coalesce(*[F.when(F.col("__reach") == d, F.col(f"__{name}{d}")) for d in range(neighbours + 1)])
    x = x.withColumns({"__end": pick("e"), "__start": pick("s")})
    flags = {}
    for k, c in enumerate(columns):
        v, of = F.col(f"__b_{k}"), lambda name, k=k: F.col(f"__end.{name}_{k}") - F.coalesce(F.col(f"__start.{name}_{k}"), F.lit(0))
        own = F.coalesce(v, F.lit(0))
        m = of("m") - v.isNotNull().cast("long")
        if short[k]:
            s, q = of("s") - own, of("q") - own * own
            left, right = (m - 1) * (m * own - s) * (m * own - s), sigma * sigma * m * (m * q - s * s)
        else:
            own, m3 = own.cast("decimal(12,0)"), m.cast("decimal(3,0)")
            s, q = (of("s") - own).cast("decimal(13,0)"), (of("q") - own * own).cast("decimal(25,0)")
            away = (m3 * own - s).cast("decimal(15,0)")
            left = ((m3 - 1) * (away * away).cast("decimal(30,0)")).cast("decimal(33,0)")
            right = F.lit(sigma * sigma).cast("decimal(4,0)") * m3 * (m3 * q - (s * s).cast("decimal(26,0)")).cast("decimal(28,0)")
        tested = (F.col("__n") > neighbours) & (m >= 2) & (left > right)
        flags[f"{c}{suffix}"] = (F.col("__n") >= least_rows) & (v.isNull() | F.coalesce(tested, F.lit(False)))
    spare = ["__n", "__at", "__sums", "__reach", "__end", "__start", *[f"__{e}{d}" for e in "es" for d in range(neighbours + 1)], *[f"__b_{k}" for k in short]]
    return x.withColumns(flags).drop(*spare)


def float_outliers(values: np.ndarray, neighbours: int, sigma: float) -> np.ndarray:
    """A plain model of ``flag_float_outliers`` for one series; values that aren't finite are flagged and aren't neighbours."""
    finite = np.isfinite(values)
    n, half = len(values), neighbours // 2
    if n < neighbours + 1:
        return ~finite
    begin = np.clip(np.arange(n) - half, 0, n - neighbours - 1)
    begin[:half], begin[n - half :] = 0, n - neighbours - 1
    index = begin[:, None] + np.arange(neighbours + 1)
    near = values[index]
    use = finite[index] & (index != np.arange(n)[:, None])
    m = use.sum(axis=1)
    with np.errstate(all="ignore"):
        mean = np.where(use, near, 0.0).sum(axis=1) / m
        spread = np.sqrt((np.where(use, near - mean[:, None], 0.0) ** 2).sum(axis=1) / (m - 1))
        away = np.abs(values - mean)
        flagged = np.where(spread > 0, away > sigma * spread, away > 0)
    return ~finite | ((m >= 2) & flagged)


def flag_float_outliers(rows: DataFrame, columns: list[str], neighbours: int = 6, sigma: float = 5.0, keys: tuple[str, ...] = ("file_id", "segment"), order: str = "offset", suffix: str = "_stdchecked", block: int = BLOCK) -> DataFrame:
    """The same test for float columns, in the JVM; values that are null or not finite are flagged and aren't neighbours.
    A series of any length is dealt in blocks of ``block`` rows, each with the ``neighbours`` rows before and after it. A
    row's neighbours are an array out of one window; their mean and then their deviation are aggregates of it, in two passes,
    as differences of running sums would lose a float's digits."""
    half = neighbours // 2
    x = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long") - 1)
    of = lambda at: F.floor(at / block).cast("long")
    blocks = F.sequence(of(F.greatest(F.col("__at") - neighbours, F.lit(0))), of(F.col("__at") + neighbours))
    x = x.withColumns({"__own": of(F.col("__at")), "__block": F.explode(blocks)})
    series = Window.partitionBy(*keys, "__block").orderBy("__at")
    count = lambda a, b: F.count(F.lit(1)).over(series.rowsBetween(a, b)).cast("int")
    near = F.collect_list(F.struct(*[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])).over(series.rowsBetween(-neighbours, neighbours))
    x = x.withColumns({"__before": count(-neighbours, -1), "__after": count(1, neighbours), "__near": near}).where("__own = __block")
    # of its neighbours, so many lie before the row: half, but for the ends of the series
    before, after = F.col("__before"), F.col("__after")
    x = x.withColumn("__back", F.when(before < half, before).when(after < half, F.lit(neighbours) - after).otherwise(half))
    x = x.withColumn("__near", F.when(before + after >= neighbours, F.concat(F.slice("__near", before - F.col("__back") + 1, F.col("__back")), F.slice("__near", before + 2, F.lit(neighbours) - F.col("__back")))))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    squares = lambda a, mean: F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    use = lambda k: F.filter(F.transform("__near", lambda r: r[f"v{k}"]), finite)
    x = x.withColumns({f"__u{k}": use(k) for k in range(len(columns))})
    m = [F.size(f"__u{k}") for k in range(len(columns))]
    x = x.withColumns({f"__m{k}": total(F.col(f"__u{k}")) / F.nullif(m[k], F.lit(0)) for k in range(len(columns))})
    flags = {}
    for k, c in enumerate(columns):
        mean = F.col(f"__m{k}")
        spread = F.sqrt(squares(F.col(f"__u{k}"), mean) / F.nullif(m[k] - 1, F.lit(0)))
        away = F.abs(F.col(c).cast("double") - mean)
        # comparisons take NaN, which sums beyond the range of floats give, as the greatest number
        off = ~F.isnan(away) & F.when((spread > 0) & ~F.isnan(spread), away > sigma * spread).otherwise(away > 0)
        flags[f"{c}{suffix}"] = ~finite(F.col(c).cast("double")) | F.coalesce((m[k] >= 2) & off, F.lit(False))
    return x.withColumns(flags).select(*rows.columns, *flags)


def outlier_counts(rows: DataFrame, flags: list[str], groups: dict[str, list[str]], keys: tuple[str, ...] = ("file_id", "segment")) -> DataFrame:
    """Flags per column and per group of columns, for each segment and, with null keys, for each file."""
    one = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    counts = [F.sum(one(c)).alias(f"n_{c}") for c in flags]
    counts += [F.sum(sum((one(c) for c in own), F.lit(0))).alias(f"n_{name}") for name, own in groups.items()]
    return rows.rollup(*keys).agg(*counts, F.grouping_id().alias("level")).where(F.col("level") < 2 ** len(keys) - 1).drop("level")


def sigma_filtered_mean(rows: DataFrame, keys: list[str], value: str, sigma: float = 2.0, whole: bool = True) -> DataFrame:
    """Mean per group of the values within ``sigma`` deviations of the group's mean.

    ``whole``: integers; population deviation, at least 1.5 of them, bounds included, and the result cut to an integer
    in two steps: the mean's whole part, and the whole part of the mean distance from it, to which values exactly on
    the bound don't add. Else floats; sample deviation, bounds excluded. Groups of one value give that value; null
    values are left out and a group of nulls gives 0."""
    k = max(sigma, 1.5) if whole else sigma
    per = Window.partitionBy(*keys)
    x = rows.select(*keys, F.col(value).alias("v")).withColumns({"mean": F.avg("v").over(per), "sd": (F.stddev_pop if whole else F.stddev_samp)("v").over(per), "low": F.min("v").over(per), "high": F.max("v").over(per)})
    away, bound = F.abs(F.col("v") - F.col("mean")), k * F.col("sd")
    inner = F.when(away <= bound if whole else away < bound, F.col("v"))
    if not whole:
        found = x.groupBy(*keys).agg(F.when(F.max("low") == F.max("high"), F.max("low")).otherwise(F.avg(inner)).alias("mean"))
        return found.withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    cut = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")
    strict = F.when(away < bound, F.col("v").cast("long"))
    found = x.groupBy(*keys).agg(F.max("low").alias("low"), F.max("high").alias("high"), F.count(inner).alias("n"), F.sum(inner).alias("total"), F.count(strict).alias("n_strict"), F.sum(strict).alias("strict"))
    found = found.withColumn("coarse", cut(F.col("total") / F.nullif(F.col("n"), F.lit(0))))
    fine = cut((F.coalesce("strict", F.lit(0)) - F.col("n_strict") * F.col("coarse")) / F.nullif(F.col("n"), F.lit(0)))
    mean = F.when(F.col("low") == F.col("high"), F.col("low").cast("long")).otherwise(F.col("coarse") + fine)
    return found.select(*keys, F.coalesce(mean, F.lit(0)).alias("mean"))


def plain_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"))
