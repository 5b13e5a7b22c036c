"""Quality: Bradley-Terry ranking of documents from preference pairs, and a threshold at a quantile of the scores."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import store
from .common import fold
from .labelled import SAMPLE, labelled_sample

#: Preference pairs, at most.
PAIRS = 60_000
#: A document at the threshold gets this score.
CUT = 0.7
FEATURES = ["log_words", "mean_word", "distinct", "top_word", "runs", "repeated_lines", "symbols", "bars", "digits", "capitals", "all_capitals", "line_words", "marked_words", "sentence_ends", "exclamations", "letters", "short_lines", "braces", "long_words", "distinct_pairs"]
_MARKED = re.compile(r"[#$%&*!|=<>~^]{2,}")
_END = re.compile(r"[.!?](?:\s|$)")


def features_of(text: str) -> list[float]:
    words = text.split()
    n, length = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    letters = sum(map(str.isalpha, text))
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    symbols = sum(map(text.count, "#$%&*|=<>~^@\\/{}[]_"))
    return [
        math.log1p(len(words)),
        min(30.0, sum(map(len, words)) / n),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / n_lines,
        symbols / length,
        text.count("|") / n,
        sum(map(str.isdigit, text)) / length if not text.isalpha() else 0.0,
        capitals / max(1, letters),
        float(capitals > 0.5 * letters),
        math.log1p(len(words) / n_lines),
        min(1.0, len(_MARKED.findall(text)) / n),
        min(1.0, len(_END.findall(text)) / n),
        text.count("!") / n,
        letters / length,
        sum(len(x) < 20 for x in lines) / n_lines,
        sum(map(text.count, "{};()")) / length,
        sum(len(w) > 20 for w in words) / n,
        len(set(zip(words, words[1:]))) / n,
    ]


def features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(x) for x in features_of(t or "")])

    return dense(text)


class QualityModel:
    """score = weights . features; ``cut`` is the score at the threshold, ``spread`` scales to 0..1, ``share``
    is the labels' share of 1."""

    def __init__(self, means: list[float], weights: list[float], cut: float, spread: float, share: float = 0.5):
        self.means, self.weights, self.cut, self.spread, self.share = means, weights, cut, spread, share

    def ranking(self, x: Column) -> Column:
        """The Bradley-Terry score of an array of features. Features beyond the range that was seen in fitting by far
        don't run away: each is cut to 8 deviations."""
        terms = [F.lit(w) * F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (x[k] - F.lit(m)) / F.lit(s))) for k, (w, (m, s)) in enumerate(zip(self.weights, self.means)) if w]
        return sum(terms, F.lit(0.0))

    def ranked(self, docs: DataFrame, column: str = "__quality_rank") -> DataFrame:
        """``docs`` with their Bradley-Terry scores."""
        return docs.withColumn("__quality_x", features(F.col("text"))).withColumn(column, self.ranking(F.col("__quality_x"))).drop("__quality_x")

    def settle(self, ranked: DataFrame, column: str = "__quality_rank") -> None:
        """Take the threshold, at the labels' share of 0, and the spread from all ``ranked`` documents. The quantile is
        off by a hundred-thousandth of the documents at most."""
        seen = ranked.agg(F.percentile_approx(column, 1 - self.share, 100_000).alias("cut"), F.stddev_pop(column).alias("spread")).first()
        if seen["cut"] is not None:
            self.cut, self.spread = seen["cut"], max(1e-9, (seen["spread"] or 1.0) / 3)

    def scaled(self, ranked: DataFrame, column: str = "__quality_score", rank: str = "__quality_rank") -> DataFrame:
        """``ranked`` with ``column`` from 0 to 1 in place of ``rank``: CUT for a document at the threshold, more for
        better ones."""
        away = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (F.col(rank) - F.lit(self.cut)) / F.lit(self.spread)))
        return ranked.withColumn(column, 1 / (1 + F.lit((1 - CUT) / CUT) * F.exp(-away))).drop(rank)

    def score(self, docs: DataFrame, column: str = "__quality_score") -> DataFrame:
        """``docs`` with ``column``, by the threshold as it is: the sample's, or what ``settle`` took."""
        return self.scaled(self.ranked(docs), column)


def preference_pairs(sample: DataFrame, pairs: int) -> DataFrame:
    """(better, worse) arrays of features: each pair one document of label 1 and one of label 0, dealt by number so
    that every document of the rarer label takes part about equally often. ``sample`` is bounded."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    numbered = sample.withColumn("at", F.row_number().over(order) - 1)
    side = lambda label, name: numbered.where(F.col("label") == label).select(F.col("at").alias(f"{name}_at"), F.col("x").alias(name))
    n = min(pairs, 20 * max(sizes.values()))
    dealt = sample.sparkSession.range(0, n, 1, 4).select((F.col("id") % sizes[1]).alias("better_at"), (F.pmod(F.xxhash64("id"), F.lit(sizes[0]))).alias("worse_at"))
    return dealt.join(side(1, "better"), "better_at").join(side(0, "worse"), "worse_at").select("better", "worse")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed: Column | None = None, n: int = SAMPLE, pairs: int = PAIRS) -> QualityModel:
    """Fit on at most ``n`` labelled documents that ``allowed`` (a condition over doc_id) admits, and ``pairs`` pairs.

    The logistic loss of the pairs' feature differences, without an intercept, is the Bradley-Terry likelihood. The
    threshold is the quantile of the sample's scores at its share of label 0, until ``settle`` takes that of all documents.
    Without both labels every document gets
    the score CUT. Null texts count as empty; repeated rows are scored alike."""
    allowed = F.lit(True) if allowed is None else allowed
    sample = labelled_sample(docs, labels, label, allowed, n).select("doc_id", "label", features(F.col("text")).alias("x"))
    sample = store(sample.coalesce(8), "quality-sample").coalesce(4)
    columns = [F.col("x")[k] for k in range(len(FEATURES))]
    seen = sample.agg(F.avg("label").alias("share"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    if seen["share"] is None or not 0 < seen["share"] < 1:
        return QualityModel([], [], 0.0, 1.0)
    means = [(seen[f"m{k}"], seen[f"s{k}"] or 1.0) for k in range(len(FEATURES))]
    standard = F.array(*[F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (c - F.lit(m)) / F.lit(s))) for c, (m, s) in zip(columns, means)])
    dealt = preference_pairs(sample.select("doc_id", "label", standard.alias("x")), pairs)
    difference = F.zip_with("better", "worse", lambda a, b: a - b)
    # half of the pairs are turned round, so that both outcomes occur
    turned = F.pmod(F.xxhash64("better", "worse"), F.lit(2))
    outcome = dealt.select(array_to_vector(F.when(turned == 1, F.transform(difference, lambda d: -d)).otherwise(difference)).alias("features"), (1 - turned).cast("double").alias("label"))
    fitted = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-4, maxIter=50).fit(store(outcome.coalesce(4), "quality-pairs").coalesce(4))
    model = QualityModel(means, fitted.coefficients.toArray().tolist(), 0.0, 1.0, seen["share"])
    ranked = sample.select("label", model.ranking(F.col("x")).alias("r"))
    cuts = ranked.agg(F.percentile("r", 1 - seen["share"]).alias("cut"), F.stddev_pop("r").alias("spread")).first()
    model.cut, model.spread = cuts["cut"], max(1e-9, (cuts["spread"] or 1.0) / 3)
    return model


def query(spark, sf_dir: str) -> DataFrame:
    """The score of every document, from labels of documents whose crc32(doc_id) mod 4 is not 2."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs, labels, allowed=~held_out)
    ranked = store(model.ranked(docs.select("doc_id", "text")).drop("text"), "quality-ranks")
    model.settle(ranked)
    scored = model.scaled(ranked, "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
