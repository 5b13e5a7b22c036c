"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A temporary one stands in only where all executors are in this process
    (a local master, as in tests); a cluster without the setting is an error, as its machines share no folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sensorlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def store(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, and a lost executor
    costs only the tasks that it was running. ``rows_per_file``, if not 0, bounds the rows of a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def store_by(df: DataFrame, name: str, keys: list[str], order: str, split: tuple[str, ...] = (), buckets: int | None = None, laid_out: bool = False) -> DataFrame:
    """As ``store``, in buckets of ``keys``, sorted by them and ``order``, with a folder for each value of ``split``. Windows,
    aggregates and joins over ``keys`` read the table without an exchange. There are as many buckets as shuffle partitions,
    unless told otherwise; rows are dealt to them first, so a task writes one bucket, unless they are ``laid_out`` so
    already. A key's rows lie in one bucket: take keys whose rows are bounded, such as segments."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    dealt = df if laid_out else df.repartition(n, *keys)
    writer = dealt.write.format("parquet").bucketBy(n, *keys).sortBy(*keys, order).option("path", path)
    (writer.partitionBy(*split) if split else writer).saveAsTable(table)
    out = spark.table(table)
    out.stored_at = path
    return out


def discard(stored: DataFrame) -> None:
    """Delete the files of a table that ``store`` wrote, once nothing that is still to run reads it."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
