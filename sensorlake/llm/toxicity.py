"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import store
from .common import fold
from .labelled import SAMPLE, labelled_sample

#: Insults that hold without any labels.
INSULTS = "bastard bitch clown coward creep cretin degenerate disgusting dumb dumbass fool freak garbage idiot idiotic imbecile jerk loser lunatic maggot moron moronic nasty parasite pathetic pig psycho rat scum shameful sleazy slob stupid trash ugly useless vermin vile worm worthless wretch".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus su ustedes".split())
#: Words and beginnings of words that are learned, at most.
LEXICON = 256
PREFIXES = (4, 5, 6)
NEAR = 5

_WORD = re.compile(r"[^\W\d_]+")
#: Looked for at the beginnings of runs of letters only: a run without a symbol behind it is left at once.
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$*!|+.]{1,3}(?:[^\W\d_]++[0-9@$*!|+.]{0,3})++")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "*": None, ".": None, " ": None, "-": None, "_": None})
FEATURES = ["insult_density", "learned_density", "prefix_density", "insults", "learned", "prefixes", "distinct_hits", "strength", "near_second_person", "second_person_density", "capitals", "shouted_words", "exclamations", "questions", "symbols", "obfuscated_density", "obfuscated_hits", "log_words", "mean_word"]


def learn_lexicon(sample: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Words, and beginnings of words (written with a trailing ``*``), that stand out in documents of label 1: smoothed
    log odds of the share of documents that hold them, at least 2 and in at least three documents."""
    word = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 2))
    starts = [F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]  # noqa: B023
    items = sample.select("label", word.alias("words")).select("label", F.explode(F.array_distinct(F.concat("words", *starts))).alias("item"))
    size = sample.agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("all")).first()
    if not size["ones"] or size["ones"] == size["all"]:
        return {}
    ones, others = size["ones"], size["all"] - size["ones"]
    counts = items.groupBy("item").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("a") >= max(3, ones // 400))
    odds = F.log((F.col("a") + 0.5) / (ones + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / (others + 1.0))
    best = counts.withColumn("odds", odds).where("odds >= 2").orderBy((F.col("odds") * F.log1p("a")).desc(), "item").limit(most)
    return {r["item"]: float(r["odds"]) for r in best.collect()}


def features_of(text: str, words_known: dict[str, float], starts_known: dict[str, float]) -> list[float]:
    lower = text.lower()
    words = _WORD.findall(lower)
    n = max(1, len(words))
    insults = [k for k, w in enumerate(words) if w in _INSULTS]
    learned = [k for k, w in enumerate(words) if w in words_known]
    starts = [k for k, w in enumerate(words) if (w[:5] in starts_known or w[:4] in starts_known or w[:6] in starts_known) and w not in words_known]
    hits = sorted({*insults, *learned, *starts})
    second = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        padded = np.array([-(10**9), *second, 10**9])
        near = int((np.minimum(np.array(hits) - padded[at], padded[at + 1] - np.array(hits)) <= NEAR).sum())
    strength = sum(words_known.get(words[k], 0.0) for k in learned)
    mixed = [m.translate(_LEET) for m in _MIXED.findall(lower)]
    mixed += [m.translate(_LEET) for m in _SPACED.findall(lower)]
    hidden = sum(m in _INSULTS or m in words_known for m in mixed)
    letters = max(1, sum(map(len, words)))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if upper > len(text) // 20 else 0
    length = max(1, len(text))
    return [len(insults) / n, len(learned) / n, len(starts) / n, len(insults), len(learned), len(starts), len({words[k] for k in hits}), strength / n, near / n, len(second) / n, upper / letters, shouted / n, text.count("!") / length, text.count("?") / length, sum(map(text.count, "#$%&*")) / length, len(mixed) / n, hidden, float(np.log1p(len(words))), letters / n]


_INSULTS = frozenset(INSULTS)


class ToxicityModel:
    """Fitted trees and calibration. ``score`` adds columns to any table with a text column."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def features(self, text: Column) -> Column:
        words = {k: v for k, v in self.lexicon.items() if not k.endswith("*")}
        starts = {k[:-1]: v for k, v in self.lexicon.items() if k.endswith("*")}

        @F.pandas_udf("array<double>")
        def dense(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [float(x) for x in features_of(t or "", words, starts)])

        return dense(text)

    def score(self, docs: DataFrame, column: str = "__tox_score") -> DataFrame:
        """``docs`` with ``column``: 0 to 1. All columns are kept; names that begin with __tox_ are reserved."""
        if self.trees is None:
            return docs.withColumn(column, F.lit(float(self.share)))
        x = docs.withColumn("__tox_features", array_to_vector(self.features(F.col("text"))))
        x = self.trees.transform(x).withColumn("__tox_p", vector_to_array("__tox_probability")[1])
        if self.calibration is None:
            score = F.col("__tox_p")
        else:  # the trees' own order stays visible where the calibration is flat
            x = self.calibration.transform(x)
            score = 0.998 * F.col("__tox_iso") + 0.002 * F.col("__tox_p")
        spare = [c for c in x.columns if c.startswith("__tox_") and c != column and c not in docs.columns]
        return x.withColumn(column, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop(*spare)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed: Column | None = None, n: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``n`` labelled documents that ``allowed`` (a condition over doc_id) admits. A third of them,
    chosen by hash, calibrate the trees that the others grow.

    Without both labels among them every score is the share of label 1, or 0. Null texts count as empty, in fitting
    and scoring; repeated rows are scored alike. Features cost time in proportion to a text's length, whatever it holds
    (about a second per million characters), and a text is held whole by its task."""
    allowed = F.lit(True) if allowed is None else allowed
    sample = store(labelled_sample(docs, labels, label, allowed, n).coalesce(8), "toxicity-sample")
    held = fold(F.col("doc_id"), 3) == 1
    for_trees = sample.where(~held)
    counts = {r["label"]: r["n"] for r in for_trees.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    model = ToxicityModel(learn_lexicon(for_trees), None, None, counts.get(1, 0) / total if total else 0.0)
    if len(counts) < 2:
        return model
    table = sample.select("doc_id", F.col("label").cast("double").alias("label"), array_to_vector(model.features(F.col("text"))).alias("__tox_features"))
    table = store(table.coalesce(4), "toxicity-features").coalesce(4)
    grow = GBTClassifier(featuresCol="__tox_features", labelCol="label", predictionCol="__tox_class", maxIter=15, maxDepth=3, stepSize=0.3, subsamplingRate=1.0, seed=7, cacheNodeIds=False, checkpointInterval=-1)
    grow.setProbabilityCol("__tox_probability").setRawPredictionCol("__tox_raw")
    model.trees = grow.fit(table.where(~held))
    judged = model.trees.transform(table.where(held)).withColumn("__tox_p", vector_to_array("__tox_probability")[1])
    if judged.select("label").distinct().count() == 2:
        model.calibration = IsotonicRegression(featuresCol="__tox_p", labelCol="label", predictionCol="__tox_iso").fit(judged)
    return model


def query(spark, sf_dir: str) -> DataFrame:
    """The score of every document, from labels of documents whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = fit(docs, labels, allowed=~held_out).score(docs.select("doc_id", "text"), "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
