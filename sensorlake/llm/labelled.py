"""Bounded samples of labelled rows, chosen by the hash of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import store

#: Labelled documents that a classifier is fitted on, at most; chosen by the hash of their ids.
SAMPLE = 16_000
#: Hashes are counted by their upper 12 bits.
SHIFT = 52


def least_hashed(ids: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """Of the distinct doc_ids of ``ids`` (of each ``key``, of which there are few) the ``n`` whose hashes are least.

    A histogram of hash prefixes, of 4096 rows a key at most, tells up to which prefix ids are needed. Only those are
    ranked: n, and a 4096th part of the key's ids."""
    x = ids.withColumns({"__hash": F.xxhash64("doc_id"), "__key": F.lit(0) if key is None else F.col(key)})
    x = x.withColumn("__prefix", F.shiftright("__hash", SHIFT))
    before = Window.partitionBy("__key").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    counted = x.groupBy("__key", "__prefix").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    last = counted.where(F.col("__before") < n).groupBy("__key").agg(F.max("__prefix").alias("__last"))
    near = x.join(F.broadcast(last), "__key").where(F.col("__prefix") <= F.col("__last"))
    rank = F.row_number().over(Window.partitionBy("__key").orderBy("__hash", "doc_id"))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= n).select(*[F.col(f"`{c}`") for c in ids.columns])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, n: int = SAMPLE) -> DataFrame:
    """(doc_id, label int, text): at most ``n`` labelled documents out of those that ``allowed`` (over doc_id) admits.

    A label that is given twice counts as the greater one; null ids and labels are left out; of repeated documents the
    greatest text stands. The labels are broadcast, as their number is bounded by ``n``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & allowed)
    chosen = least_hashed(store(known.groupBy("doc_id").agg(F.max("label").alias("label")), "labels"), n)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.coalesce(F.max("text"), F.lit("")).alias("text"))
