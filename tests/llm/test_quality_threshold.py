"""The threshold of quality over all documents."""

from pyspark.sql import functions as F
from sensorlake.llm import quality

SF = "/root/testdata/sf0.001"


def test_threshold_over_all_documents(spark):
    ranked = spark.range(10_000).select(F.col("id").cast("double").alias("__quality_rank"))
    model = quality.QualityModel([], [], -5.0, 1.0, 0.3)
    model.settle(ranked)
    assert abs(model.cut - 7000) <= 1 and abs(model.spread - 10_000 / 12**0.5 / 3) < 1
    assert abs(model.scaled(ranked, "s").where(F.col("s") >= quality.CUT).count() - 3000) <= 1
    model.settle(ranked.limit(0))
    assert abs(model.cut - 7000) <= 1


def test_query_predicts_the_share_of_the_labels(spark, monkeypatch):
    found = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: found.append(fit(*a, **k | {"n": 60})) or found[0])
    rows = quality.query(spark, SF).agg(F.sum("predicted").alias("good"), F.count(F.lit(1)).alias("n")).first()
    assert abs(rows.good - rows.n * found[0].share) <= 2
