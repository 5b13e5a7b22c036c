import random
import re
import time

import pytest
from pyspark.sql import functions as F
from sensorlake.llm import quality, toxicity
from sensorlake.llm.common import fold

SF = "/root/testdata/sf0.1"


def auc(rows):
    ones, zeros = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.query(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert auc([(r.score, r.toxic) for r in rows]) > 0.95
    told = [r for r in rows if r.predicted]
    assert sum(r.toxic for r in told) / len(told) > 0.9 and sum(r.toxic for r in told) / sum(r.toxic for r in rows) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_features():
    names = dict(zip(toxicity.FEATURES, toxicity.features_of("You are an IDIOT! really st4pid and i.d.i.o.t here", {"really": 3.0}, {"her": 1.0})))
    assert names["insults"] == 1 and names["learned"] == 1 and names["near_second_person"] > 0
    assert dict(zip(toxicity.FEATURES, toxicity.features_of("what a w0rthless m0r0n", {}, {})))["obfuscated_hits"] == 2
    assert toxicity.features_of("", {}, {})[0] == 0


@pytest.mark.parametrize("text", ["x" * 10**6, "\u4e2d" * 10**6, "x" * (10**6 - 1) + "!", "x!" * 500_000, "x !" * 300_000, "a_" * 500_000, "a." * 500_000 + "1", "ab1" * 300_000], ids=["latin", "han", "symbol", "pairs", "blanks", "underscores", "dots", "digits"])
def test_features_of_long_runs_are_linear(text):
    """Junk of any length must not stop a task."""
    begun = time.time()
    assert len(toxicity.features_of(text, {"x": 1.0}, {"xxxx": 1.0})) == len(toxicity.FEATURES)
    assert time.time() - begun < 2


def test_mixed_words_are_found_as_by_the_plain_pattern():
    plain = re.compile(r"[^\W\d_]+[0-9@$*!|+.]{1,3}(?:[^\W\d_]+[0-9@$*!|+.]{0,3})+")
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("ab\u00e9 .!1@_-") for _ in range(rng.randrange(20)))
        assert toxicity._MIXED.findall(text) == plain.findall(text), text


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.query(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert auc([(r.score, r.quality) for r in rows]) > 0.97
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_pairs_are_one_of_each_label(spark):
    sample = spark.createDataFrame([(i, int(i % 4 > 0), [float(i % 4 > 0), float(i)]) for i in range(40)], "doc_id long, label int, x array<double>")
    pairs = quality.preference_pairs(sample, 300).collect()
    assert len(pairs) == 300 and all(p.better[0] == 1.0 and p.worse[0] == 0.0 for p in pairs)
    assert {p.better[1] for p in pairs} == {float(i) for i in range(40) if i % 4}


CASES = [(1, None, "a"), (2, "", "a"), (None, "some words", "a"), (3, "some words", "a"), (3, "some words", "a"), (4, "x" * 300_000, "a")]


@pytest.mark.parametrize("module", [toxicity, quality])
@pytest.mark.parametrize("labels", [[], [(3, 1), (4, 1)], [(3, None), (None, 1)], [(1, 0), (2, 0), (3, 1), (3, 0), (4, 1)], [(k, k % 2) for k in range(1, 40)]])
def test_cases(spark, module, labels):
    cases = CASES if len(labels) < 9 else [*CASES, *((k, "good words" if k % 2 else "you idiot", "a") for k in range(5, 40))]
    docs = spark.createDataFrame(cases, "doc_id long, text string, score string")
    known = spark.createDataFrame([(*x, *x[1:]) for x in labels], "doc_id long, toxic int, quality int")
    model = module.fit(docs, known)
    rows = model.score(docs, "s").collect()
    assert module is not toxicity or len(labels) < 9 or model.trees is not None
    assert len(rows) == len(cases) and all(0 <= r.s <= 1 and r.score == "a" for r in rows)
    assert len({r.s for r in rows if r.text == "some words"}) == 1
    assert model.score(docs.limit(0), "s").count() == 0
    assert module.fit(docs.limit(0), known).score(docs, "s").count() == len(cases)


def test_only_allowed_labels_are_learned(spark):
    """Turning the labels of held-out documents round changes no score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = fold(F.col("doc_id"), 4) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x, allowed=~held) for x in (labels, turned))
    assert a.weights == b.weights and a.cut == b.cut
