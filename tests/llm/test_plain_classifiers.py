"""The two classifiers against plain versions: features, lexicon, trees, calibration, pairs and threshold."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sensorlake.llm import quality, toxicity
from sensorlake.llm.common import fold
from sensorlake.llm.labelled import labelled_sample, least_hashed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_least_hashed_against_sorting(spark):
    rows = [(i, "ab"[i % 3 == 0], i * i) for i in range(3000)]
    x = spark.createDataFrame(rows, "doc_id long, lang string, __rank long")
    hashed = {r.doc_id: r.h for r in x.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    order = sorted(hashed, key=hashed.get)
    for n in (0, 1, 7, 500, 5000):
        assert {r.doc_id for r in least_hashed(x.select("doc_id", "lang"), n).collect()} == set(order[:n])
        got = least_hashed(x.select("doc_id", "lang"), n, "lang")
        assert got.columns == ["doc_id", "lang"]
        want = {i for lang in "ab" for i in [i for i in order if rows[i][1] == lang][:n]}
        assert {r.doc_id for r in got.collect()} == want
    assert least_hashed(x.limit(0).select("doc_id", "lang"), 5, "lang").count() == 0


def plain_lexicon(rows, most=toxicity.LEXICON):
    held, n = {0: Counter(), 1: Counter()}, Counter(label for label, _ in rows)
    for label, text in rows:
        words = {w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) > 2}
        held[label].update(words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k})
    odds = {}
    for w, a in held[1].items():
        x = np.log((a + 0.5) / (n[1] + 1)) - np.log((held[0][w] + 0.5) / (n[0] + 1))
        if a >= max(3, n[1] // 400) and x >= 2:
            odds[w] = (x, x * np.log1p(a))
    best = sorted(odds, key=lambda w: (-odds[w][1], w))[:most]
    return {w: odds[w][0] for w in best}


def steps(tree: str):
    """A tree's printed form as a function of the features."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in tree.splitlines() if x.strip() and ("Predict" in x or "If" in x or "Else" in x)]

    def node(at):
        depth, line = lines[at]
        if line.startswith("Predict"):
            value = float(line.split(":")[1])
            return lambda f: value, at + 1
        k, bound = re.match(r"If \(feature (\d+) <= ([-+.eE\d]+)\)", line).groups()
        low, at = node(at + 1)
        assert lines[at][1].startswith("Else")
        high, at = node(at + 1)
        return (lambda f, k=int(k), b=float(bound), low=low, high=high: low(f) if f[k] <= b else high(f)), at

    return node(0)[0]


def test_toxicity_against_a_plain_version(spark, tables):
    docs, labels = tables
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels, allowed=~held_out)
    sample = labelled_sample(docs, labels, "toxic", ~held_out)
    for_trees = [(r.label, r.text) for r in sample.where(fold(F.col("doc_id"), 3) != 1).collect()]
    want = plain_lexicon(for_trees)
    assert model.lexicon.keys() == want.keys() and all(abs(model.lexicon[w] - v) < 1e-9 for w, v in want.items())
    trees = [steps(t.toDebugString) for t in model.trees.trees]
    bounds, levels = np.array(model.calibration.boundaries.toArray()), np.array(model.calibration.predictions.toArray())
    assert (np.diff(bounds) >= 0).all() and (np.diff(levels) >= 0).all()
    words = {k: v for k, v in model.lexicon.items() if not k.endswith("*")}
    starts = {k[:-1]: v for k, v in model.lexicon.items() if k.endswith("*")}
    for r in model.score(docs.select("doc_id", "text"), "score").collect():
        f = toxicity.features_of(r.text or "", words, starts)
        margin = sum(w * t(f) for w, t in zip(model.trees.treeWeights, trees))
        p = 1 / (1 + np.exp(-2 * margin))
        want = min(1.0, max(0.0, 0.998 * np.interp(p, bounds, levels) + 0.002 * p))
        assert abs(r.score - want) < 1e-6, r.doc_id


def test_only_allowed_toxic_labels_are_learned(tables):
    """Turning the labels of held-out documents round changes no score."""
    docs, labels = tables
    held_out = fold(F.col("doc_id"), 5) == 0
    turned = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.fit(docs, x, allowed=~held_out).score(docs.select("doc_id", "text"), "score").collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_against_a_plain_fit(spark, tables):
    """The pairs' logistic loss minimized by Newton's steps in numpy, and the quantile of all documents' scores."""
    docs, labels = tables
    held_out = fold(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, labels, allowed=~held_out, pairs=4000)
    sample = labelled_sample(docs, labels, "quality", ~held_out)
    rows = [(r.doc_id, r.label, quality.features_of(r.text)) for r in sample.collect()]
    x = np.array([f for _, _, f in rows])
    means, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    assert np.allclose([m for m, _ in model.means], means) and np.allclose([s for _, s in model.means], spread)
    standard = np.clip((x - means) / spread, -8, 8)
    frame = spark.createDataFrame([(d, y, z.tolist()) for (d, y, _), z in zip(rows, standard)], "doc_id long, label int, x array<double>")
    d = np.array([np.array(p.better) - np.array(p.worse) for p in quality.preference_pairs(frame, 4000).collect()])
    assert len(d) == 4000
    w = np.zeros(d.shape[1])
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 0.5e-4 * w @ w
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-4 * np.eye(len(w)), d.T @ p / len(d) - 1e-4 * w)
        t = 1.0
        while loss(w + t * step) > loss(w) and t > 1e-9:
            t /= 2
        w = w + t * step
    got = np.array(model.weights)
    assert loss(got) <= loss(w) + 2e-3
    # both rank nearly all documents alike
    a, b = standard @ got, standard @ w
    assert np.corrcoef(a.argsort().argsort(), b.argsort().argsort())[0, 1] > 0.97
    ranks = {r.doc_id: r.rank for r in model.ranked(docs.select("doc_id", "text"), "rank").collect()}
    plain = {r.doc_id: np.clip((np.array(quality.features_of(r.text or "")) - means) / spread, -8, 8) @ got for r in docs.select("doc_id", "text").collect()}
    assert all(abs(ranks[k] - v) < 1e-6 for k, v in plain.items())
    model.settle(model.ranked(docs.select("doc_id", "text"), "rank"), "rank")
    assert abs(np.mean([v < model.cut for v in ranks.values()]) - (1 - model.share)) < 0.01
