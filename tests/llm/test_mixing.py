import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from sensorlake.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Caps and shares again and again, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    out, left, free = {}, share * sum(sizes.values()), list(order)
    while free:
        part = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if part[s] > cap * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def check(rows, docs):
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id][0] or "")) and 0 <= r.taken <= 2 * r.size
        s = docs[r.doc_id][1]
        sizes[s], taken[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken
    want = targets(sizes)
    for r in rows:
        s = docs[r.doc_id][1]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-3
    for s, t in taken.items():
        biggest = max(r.size for r in rows if docs[r.doc_id][1] == s)
        assert abs(t - want[s]) <= biggest / 2 + 1e-6, (s, t, want[s])


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = mixing.query(spark, sf).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(mixing.SQL).fetchall()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in rows) == sorted((a, b, c, round(d, 3), e) for a, b, c, d, e in want)


@pytest.mark.parametrize("few", [True, False])
def test_uneven_sources(spark, monkeypatch, few):
    rng = random.Random(6)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 100 if few else 0)
    docs = {d: (" ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "a", "é", "b", None, "", "Z"])) for d in range(900)}
    docs[900] = ("w " * 5000, "tiny")
    docs[901] = (None, "empty")
    rows = [(d, t, s, 1, 1) for d, (t, s) in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int").repartition(5)
    first = mixing.mix(frame).collect()
    check(first, docs)
    again = mixing.mix(frame.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)
    copies = {r.doc_id: r.copies for r in first}
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    counted = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counted == {d: c for d, c in copies.items() if c}


def test_cases(spark):
    rows = [(None, "a b", None), (None, "a b", None), (1, None, None), (2, "", "x"), (3, "one two three", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame).collect()
    assert len(got) == 5 and len({r.taken for r in got if r.doc_id is None}) == 1
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixed(frame.limit(0)).count() == 0
    assert mixing.mix(frame.where("doc_id = 2")).first().taken == 0


@pytest.mark.parametrize("block", [3, 65_536])
def test_repeated_rows_at_the_boundary(spark, monkeypatch, block):
    """A third of all rows is one row; others differ from each other in further columns only."""
    monkeypatch.setattr(mixing, "COPIES", block)
    rows = [(1, "one two three", "a", k % 2) for k in range(40)] + [(2, "four five", "b", k) for k in range(50)]
    rows += [(k, "w " * (k % 7), "c", k) for k in range(10, 50)] + [(None, "six", None, 0)] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, __mix_rows int")
    sizes = {s: sum(len(t.split()) for _, t, x, _ in rows if x == s) for s in ("a", "b", "c", None)}
    want = targets(sizes)
    got = mixing.mix(frame.repartition(4)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(t.split())) for d, t, s, _ in rows)
    for s, largest in (("a", 3), ("b", 2), ("c", 6), (None, 1)):
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= largest / 2 + 1e-6
    assert all(r.taken <= 2 * r.size for r in got)
    key = lambda r: (r.doc_id or 0, r.source or "", r.taken)
    assert sorted(map(key, mixing.mix(frame.repartition(2)).collect())) == sorted(map(key, got))
    runs = [Counter(tuple(r) for r in mixing.mixed(frame.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and runs[0].keys() <= set(rows)
    copies = Counter()
    for r in got:
        copies[r.doc_id, r.source] += r.copies
    held = Counter()
    for (d, _, s, _), n in runs[0].items():
        held[d, s] += n
    assert held == +copies
    for (d, t, s, x), n in runs[0].items():
        assert n <= 2 * rows.count((d, t, s, x))
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "x"]).astype({"doc_id": "Int64"})  # noqa: F841
    sql = con.execute(mixing.SQL).fetchall()
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got) == sorted((r[0] or 0, r[1], r[4]) for r in sql)


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    frame = frame.union(frame).union(frame)
    plan = mixing.mix(frame)._jdf.queryExecution().executedPlan().toString() + mixing.mixed(frame.select("doc_id", "text", "source"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
