import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from sensorlake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, queries, k):
    import math

    def ints(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(64 * x) for x in v]

    own = {}
    for i, v, _ in queries:
        if i is not None and ints(v):
            own[i] = max(own.get(i, ints(v)), ints(v))
    out = []
    for q, v in own.items():
        scores = [(-sum(map(lambda a, b: a * b, v, c)), i) for i, w, _ in rows if i is not None and i != q and (c := ints(w)) and len(c) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, k=5, lists=3, **sizes):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, value in sizes.items():
        setattr(topk, name, value)
    got = topk.top_k(table, table.where(F.col("vec_id") % 4 == 0), k=k, lists=lists).collect()
    return sorted(tuple(r) for r in got)


def test_against_brute_force_with_ties_nulls_and_lengths(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)], 0) for i in range(90)]
    rows += [(100 + i, [0.5] * 6, 0) for i in range(20)] + [(200, [1.0, 2.0], 0), (204, [2.0, 1.0], 0)]
    rows += [(300, None, 0), (304, [], 0), (308, [float("nan")] * 6, 0), (312, [float("inf")] * 6, 0), (316, [None] * 6, 0), (None, [1.0] * 6, 0)]
    rows += [rows[8], rows[9], (320, [1e9] * 6, 0), (324, [3e4] * 6, 0)]
    assert run(spark, rows) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 4 == 0], 5)


def test_fewer_than_k_and_none(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(4)]
    assert run(spark, rows, k=20) == brute(rows, rows[:1], 20)
    assert run(spark, [], k=20) == []


def test_sums_beyond_double_precision_are_exact(spark):
    rows = [(0, [2.0**25, 1.0, 0.0], 0), (1, [2.0**24, 1.0, 0.0], 0), (2, [2.0**24, 2.0, 0.0], 0), (3, [2.0**24, 1.5, 0.0], 0)]
    assert run(spark, rows) == brute(rows, rows[:1], 5)


def cell(monkeypatch, c, q_every, lists):
    """Phases 1 to 3 of one cell in this process: (rows found, rows wanted, share of all products that were made)."""
    ids, q = np.arange(len(c)) * 7, c[::q_every]
    qi = ids[::q_every]
    done = []
    dense, pairs = topk.all_products, topk.pair_products
    row = {"dim": c.shape[1], "q_part": 0} | {f"q_{k}": v for k, v in topk.packed(qi, q).items()} | {f"c_{k}": v for k, v in topk.packed(ids, c).items()}
    local = [x for b in topk.local_lists(20, lists)(iter([pa.RecordBatch.from_pylist([row])])) for x in b.to_pylist()]
    scores = {}
    for x in local:
        scores.setdefault(x["query_id"], []).append(x["score"])
    cutoffs = [{"query_id": i, "cutoff": min(s)} for i, s in scores.items() if len(s) == 20]
    assert len(cutoffs) == len(qi)
    monkeypatch.setattr(topk, "all_products", lambda q, c: done.append(len(q) * len(c) * q.shape[1]) or dense(q, c))
    monkeypatch.setattr(topk, "pair_products", lambda q, c: done.append(q.size) or pairs(q, c))
    got, want = [], []
    for b in topk.sufficient(20, lists)(iter([pa.RecordBatch.from_pylist([row | {"cutoffs": cutoffs}])])):
        got += [(x["query_id"], -x["score"], x["vec_id"]) for x in b.to_pylist()]
    for n, s in enumerate((q @ c.T).astype(int)):
        want += [(qi[n], *x) for x in sorted((-int(s), int(v)) for s, v in zip(s, ids) if v != qi[n])[:20]]
    return sorted(got), want, sum(done) / (len(q) * c.size)


def test_clustered_vectors_are_passed_over(monkeypatch):
    rng = np.random.default_rng(6)
    heart = rng.normal(0, 40, (24, 32))
    c = np.floor(heart[rng.integers(0, 24, 6000)] + rng.normal(0, 3, (6000, 32)))
    monkeypatch.setattr(topk, "GROUP", 100)
    got, want, share = cell(monkeypatch, c, 60, 4)
    assert got == want and share < 0.05, share


def test_the_threshold_spares_products_of_vectors_without_clusters(monkeypatch):
    """Components of equal weight leave the most to bounds: the last of the lists are spared."""
    c = np.floor(np.random.default_rng(8).normal(0, 8, (20_000, 64)))
    monkeypatch.setattr(topk, "FEW", 1 / 8)
    got, want, share = cell(monkeypatch, c, 100, 6)
    assert got == want and share < 0.9, share


def test_lists_of_uneven_weight(monkeypatch):
    """Where most of a vector's length lies in few components, the lists with the rest are hardly ever multiplied."""
    c = np.floor(np.random.default_rng(9).normal(0, 1, (20_000, 64)) * (120 / (1 + np.arange(64))))
    got, want, share = cell(monkeypatch, c, 100, 4)
    assert got == want and share < 0.1, share


def test_no_cutoff_and_equal_vectors(monkeypatch):
    got, want, _ = cell(monkeypatch, np.floor(np.ones((600, 5)) * 3), 60, 4)
    assert got == want
    q, c = np.eye(4) * 10, np.arange(40.0).reshape(10, 4)
    of = topk.spans(4, 3)
    mean, radius, _ = topk.centres(c, np.array([0, 10]), of)
    r, v, total = topk.collect(q, c, of, mean[0], radius[0], np.full(4, -np.inf))
    assert len(r) == 40 and (total == (q @ c.T)[r, v]).all()


def test_scores_below_64_bits(spark):
    rows = [(0, [2.0**60, 1.0], 0), *[(k, [-(2.0**40) - k, 1.0], 0) for k in range(1, 9)]]
    got = run(spark, rows, k=3)
    assert [(q, r, v) for q, r, v, _ in got if q == 0] == [(q, r, v) for q, r, v, _ in brute(rows, rows[:1], 3)]
