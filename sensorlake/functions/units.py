"""Units of the sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What holds where a header lacks a key.
DEFAULTS = {"acc_sensitivity": 0.061, "gyr_sensitivity": 4.375, "imu_odr": 6667.0}
AXES = ("x", "y", "z")


def scale_imu(imu: DataFrame) -> DataFrame:
    """Raw counts to mg and mdps by the sensitivities of the row's own file, which the rows carry."""
    factor = {k: F.coalesce(F.col(f"{k}_sensitivity"), F.lit(DEFAULTS[f"{k}_sensitivity"])) for k in ("acc", "gyr")}
    return imu.withColumns({f"{k}_{a}_{unit}": F.col(f"{k}_{a}") * factor[k] for k, unit in (("acc", "mg"), ("gyr", "mdps")) for a in AXES})


def scale_gnss(gnss: DataFrame) -> DataFrame:
    """Degrees from 1e-7 degrees; velocities are mm/s already; the fix's time to the microsecond."""
    moment = F.timestamp_micros(F.col("posix_timestamp").cast("long") * 1_000_000 + F.col("microseconds"))
    return gnss.withColumns({"latitude_dd": F.col("latitude") / 1e7, "longitude_dd": F.col("longitude") / 1e7, **{f"ned_vel_{a}_mmps": F.col(f"ned_vel_{a}") for a in ("north", "east", "down")}, "datetime_utc": moment})


def gnss_posix_seconds(posix: Column, microseconds: Column) -> Column:
    return posix + microseconds / 1e6


def utc_micros(utc: Column) -> Column:
    """Struct of a UTC time in microseconds and whether there is one."""
    return F.struct((utc * 1e6).alias("micros"), utc.isNotNull().alias("valid"))


def outlier_masks(rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """For each name, whether any of its flag columns is set."""
    out = {}
    for name, flags in groups.items():
        mask = F.lit(False)
        for f in flags:
            mask = mask | F.coalesce(F.col(f), F.lit(False))
        out[name] = mask
    return rows.withColumns(out)
