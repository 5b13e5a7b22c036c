"""Decoded tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table below ``path``, partitioned by boot_id and date where it has them. Records carry ``segment_out``, the
    number of their segment among the kept ones; rows without one aren't written."""
    for name, table in tables.items():
        kept = table.where(F.col("segment_out").isNotNull()) if "segment_out" in table.columns else table
        by = [c for c in ("boot_id", "date") if c in table.columns]
        kept.write.mode(mode).partitionBy(*by).parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def combine_segments(records: DataFrame, files: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """All segments of each file as one series, with the file's header values beside them; sorted only if asked for."""
    x = records
    if files is not None:
        own = files.select("file_id", *[c for c in ("acc_sensitivity", "gyr_sensitivity", "imu_odr", "gnss_rate", "firmware_commit") if c not in records.columns and c in files.columns])
        x = records.join(own, "file_id", "left")
    return x.orderBy("file_id", "segment_out", "offset") if ordered else x
