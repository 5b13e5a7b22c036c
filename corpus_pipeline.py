"""From raw documents to packed training sequences: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm import mixing, neardup, packing, pii, toxicity
from sensorlake.llm.common import fold
from sensorlake.shared import store

#: Documents from this score on are rejected.
TOXIC = 0.5


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model is fitted on labelled documents whose crc32(doc_id) mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, allowed=fold(F.col("doc_id"), 5) != 0)
    scored = model.score(docs)
    return scored.where(F.col("__tox_score") < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return neardup.one_of_each(docs)


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars follows."""
    text = docs.withColumn("text", pii.redacted(F.col("text")))
    return text.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else text


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: documents are left out, or repeated as rows."""
    return mixing.mixed(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece of a document, with its ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokenizers, trees and signatures have no SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
