"""From files as they appear to finished tables, each file once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Settings, decode_log_files, synchronise_files
from .live import RAW

SETTLED, FILES = "1 minute", 64
TABLES = ("files", "segments", "pps", "gnss", "imu")


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def finished(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table that ``ingest_tables`` writes, with batch_id: what belongs to batches that were finished; None before the
    first one."""
    table, done = _written(spark, f"{path}/{name}"), _written(spark, f"{path}/batches")
    return None if table is None or done is None else table.join(F.broadcast(done.select("batch_id").distinct()), "batch_id", "left_semi")


def ingest_tables(spark: SparkSession, folder: str, path: str, checkpoint: str, settings: Settings | None = None, settled: str = SETTLED, files_per_trigger: int = FILES, glob: str = "DATA_*.dat", **options: str):
    """A started query that turns new raw files below ``folder`` into the tables of ``synchronise_files`` below ``path``.

    Spark's checkpoint remembers which files have been handed to which batch. A batch writes its part of each table as a
    folder of its own, in place of what an attempt before may have left there, and only then its row in ``batches``; so
    a batch that is repeated after a crash leaves the same tables, and ``finished`` never shows half of one. All state of the
    stages is within a file, so a batch is complete in itself.

    A file that was changed within ``settled`` before its batch may still grow. It is set aside in ``waiting`` and taken up
    with the next batch, of which there is one as soon as there is another new file. Paths of a batch, a bounded number, come
    to the driver; contents don't. Spark hands on no file without a byte. A batch without files that are ready writes nothing but its row."""
    own = settings or Settings()

    def batch(listed: DataFrame, batch_id: int) -> None:
        session = listed.sparkSession
        waiting = _written(session, f"{path}/waiting")
        listed = listed.select("path")
        if waiting is not None:
            listed = listed.union(waiting.where(F.col("batch_id") == batch_id - 1).select("path"))
        paths = sorted({r["path"] for r in listed.collect()})
        # how the files look now, not when they were listed
        now = session.read.format("binaryFile").load(paths).select("path", "modificationTime") if paths else session.createDataFrame([], "path string, modificationTime timestamp")
        growing = sorted(r["path"] for r in now.where(F.col("modificationTime") > F.current_timestamp() - F.expr(f"interval {settled}")).collect())
        ready = [p for p in paths if p not in growing]
        session.createDataFrame([(p,) for p in growing], "path string").coalesce(1).write.mode("overwrite").parquet(f"{path}/waiting/batch_id={batch_id}")
        if ready:
            tables = synchronise_files(*decode_log_files(session, paths=json.dumps(ready), **options), own)
            for name in TABLES:
                table = tables[name]
                kept = table.where(F.col("segment_out").isNotNull()) if "segment_out" in table.columns else table
                kept.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        session.createDataFrame([(len(ready),)], "n_files long").coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")

    new = spark.readStream.format("binaryFile").schema(RAW).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return new.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
