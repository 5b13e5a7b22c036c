import random
import re
from collections import Counter

import numpy as np
from sensorlake.llm import dartminhash, neardup
from sensorlake.llm.dartminhash import signatures


def plain(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(texts):
    """Class of each document from all pairs that share a shingle."""
    sets, held, parent = {d: plain(t) for d, t in texts.items()}, {}, {d: d for d in texts}
    for d, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = Counter()
        for g, n in s.items():
            for e in held[g]:
                if e < d:
                    common[e] += min(n, sets[e][g])
        for e, x in common.items():
            if 5 * x >= 4 * (s.total() + sets[e].total() - x):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d in texts}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for size, top in ((300, 1), (20, 1), (1, 1), (4000, 1), (200, 7)):
        a = {int(x): int(rng.integers(1, top + 1)) for x in rng.integers(0, 2**62, size)}
        b = dict(a)
        for key in list(b)[: size // 6]:
            del b[key]
            b[int(rng.integers(0, 2**62))] = int(rng.integers(1, top + 1))
        rows = [(0, k, v) for k, v in a.items()] + [(1, k, v) for k, v in b.items()]
        d, e, w = map(np.array, zip(*rows))
        s = signatures(d, e.astype(np.uint64), w.astype(float), 2, 3000)
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        assert abs((s[0] == s[1]).mean() - true) < 0.04
        alone = signatures(d[d == 1] - 1, e[d == 1].astype(np.uint64), w[d == 1].astype(float), 1, 3000)
        assert (alone[0] == s[1]).all()


def test_fractional_weights():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**62, 400).astype(np.uint64)
    x, y = rng.random(400) * 3 + 0.1, rng.random(400) * 3 + 0.1
    s = signatures(np.repeat([0, 1], 400), np.tile(e, 2), np.concatenate([x, y]), 2, 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs.repartition(3)).collect()}
    assert got == want and len(set(want.values())) < len(want)


def copies(n, words, edits, seed):
    """Near copies of one text, of which many are under 0.8 to each other; a passage that unlike texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    out = {}
    for d in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = word()
        out[d] = " ".join(w)
    passage = " ".join(word() for _ in range(40))
    for d in range(n, n + 60):
        out[d] = passage + " " + " ".join(word() for _ in range(rng.randint(5, 60)))
    return out


def test_large_groups_and_shared_passages(spark):
    texts = copies(250, 150, 7, 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_rows_grow_with_a_group_not_with_its_pairs(spark, monkeypatch):
    """Near copies, many under 0.8 to each other, and texts that are mostly one long passage."""
    made = []

    def counted(df, name, store=neardup.store):
        out = store(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(neardup, "store", counted)
    found = []
    for n in (120, 720):
        rng = random.Random(n)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
        passage, licence = " ".join(word() for _ in range(120)), " ".join(word() for _ in range(12))
        texts = copies(n, 150, 8, 5)
        texts |= {10_000 + d: passage + " " + " ".join(word() for _ in range(rng.randint(10, 50))) + " " + licence for d in range(n)}
        made.clear()
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
        found.append({k: max(m for name, m in made if name == k) for k in {name for name, _ in made}})
        if n == 120:
            assert got == brute(texts)
    few, many = found
    assert {"dup-rest", "dup-pairs", "dup-around"} <= few.keys()
    assert all(many[k] <= 6 * 1.6 * few[k] + 100 for k in few), (few, many)


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé_9") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["x" * 300, "", "..."]
    whole = [x.tolist() for x in neardup.shingled(texts)]
    for piece in (1, 7, 50):
        monkeypatch.setattr(neardup, "PIECE", piece)
        assert [x.tolist() for x in neardup.shingled(texts)] == whole


def test_signatures_of_portions(monkeypatch):
    rng = np.random.default_rng(4)
    d, e = np.repeat(np.arange(30), 20), rng.integers(0, 2**62, 600).astype(np.uint64)
    w = rng.integers(1, 4, 600).astype(float)
    whole = signatures(d, e, w, 30, 64)
    monkeypatch.setattr(dartminhash, "DOCUMENTS", 7)
    monkeypatch.setattr(dartminhash, "ELEMENTS", 33)
    assert (signatures(d, e, w, 30, 64) == whole).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(159, 200), (-5, 200)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long"), None).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 160)} == {-5}


def test_hot_labels_and_centres_are_split(spark, monkeypatch):
    """Spark's adaptive execution can split both the links of one centre and the rows of one label."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "64",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    plans = []

    def seen(df, name, store=neardup.store):
        out = store(df, name)
        executions = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans.append((name, executions.apply(executions.size() - 1).physicalPlanDescription().split("== Initial Plan ==")[0]))
        return out

    monkeypatch.setattr(neardup, "store", seen)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        star = spark.range(1, 60_001).selectExpr("30000L as a", "id as b").where("a <> b")
        pairs = spark.range(100_000, 130_000).selectExpr("2 * id as a", "2 * id + 1 as b")
        got = neardup.components(star.union(pairs), None)
        assert got.where("label = 1").count() == 60_000 and got.count() == 120_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    steps = [plan for name, plan in plans if name == "dup-labels"][1:]
    assert any("SortMergeJoin(skew=true) Inner" in p for p in steps), steps[0]
    assert any("SortMergeJoin(skew=true) LeftOuter" in p for p in steps), steps[0]


def joined_rows(spark, since):
    """Rows that the joins of all executions from number ``since`` on have made."""
    status = spark._jsparkSession.sharedState().statusStore()
    total = 0
    for i in range(since, status.executionsList().size()):
        run = status.executionsList().apply(i).executionId()
        values, nodes = status.executionMetrics(run), status.planGraph(run).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = (node.metrics().apply(k) for k in range(node.metrics().size())) if "Join" in node.name() else ()
            for m in metrics:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_joined_rows_of_components_grow_with_the_links(spark):
    """Not with the rounds that a chain or a hub of hubs takes, nor with the links that earlier labels stand for."""
    chain = [(i, i + 1) for i in range(1, 129)]
    hubs = [(1000 + h, 2000 + 10 * h + k) for h in range(60) for k in range(10)] + [(1000 + h, 1001 + h) for h in range(59)]
    cross = [(1000 + h, 2000 + (10 * h + 7 * k) % 600) for h in range(60) for k in range(1, 20)]
    seen = lambda: spark._jsparkSession.sharedState().statusStore().executionsList().size()
    links = spark.createDataFrame([(a, b, 0.9) for a, b in sorted({*chain, *hubs, *cross})], "a long, b long, similarity double")
    since, n = seen(), links.count()
    labels = neardup.components(links, None)
    made = joined_rows(spark, since)
    got = {r.node: r.label for r in labels.collect()}
    assert {got[i] for i in range(1, 130)} == {1} and {v for k, v in got.items() if k >= 1000} == {1000}
    assert len(got) == 129 + 660 and n < made <= 6 * n, (made, n)
    # three more links, to the two components and two nodes without a label: a join or two of the labels, none of the links
    since, nodes = seen(), labels.count()
    assert joined_rows(spark, since) == 0
    _, after = neardup.joined(links, labels, spark.createDataFrame([(129, 2005, 0.9), (-7, 50, 0.9), (7000, 7001, 0.8)], "a long, b long, similarity double"))
    made = joined_rows(spark, since)
    got = {r.node: r.label for r in after.collect()}
    assert {got[i] for i in (-7, 1, 64, 129, 1000, 2599)} == {-7} and got[7000] == got[7001] == 7000 and len(got) == nodes + 3
    assert made <= nodes + 60, (made, nodes)


def check_links(texts, rows):
    """Each stated similarity is that of the two texts, and the links of a class are enough to hold it together."""
    sets = {d: plain(t) for d, t in texts.items()}
    by_class = {}
    for r in rows:
        by_class.setdefault(r.class_id, []).append(r)
        if r.linked_id is None:
            assert r.similarity is None
        else:
            x, y = sets[r.doc_id], sets[r.linked_id]
            assert abs(r.similarity - (x & y).total() / (x | y).total()) < 1e-9 and r.similarity >= 0.8 and x != y
    for own in by_class.values():
        different = len({tuple(sorted(sets[r.doc_id].items())) for r in own})
        assert len({r.n_links for r in own}) == 1 and different - 1 <= own[0].n_links <= different * (different - 1) // 2
        assert all((r.linked_id is None) == (different == 1) for r in own)
        assert all(r.linked_id is None or r.linked_id in {x.doc_id for x in own} for r in own)


def test_links_are_stated_with_their_similarity(spark):
    texts = copies(150, 150, 7, 9)
    texts |= {5000 + d: texts[d].upper() + "!" for d in range(0, 40, 3)}  # the same words
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = neardup.near_duplicates(docs).collect()
    check_links(texts, rows)
    assert sum(r.linked_id is not None for r in rows) > 50 and max(r.n_links for r in rows) > 30


ROWS = [(1, None, "a"), (2, "", "a"), (3, " .!", "b"), (9, "One two, three four five six", "a"), (4, "one TWO three four five six!", "b"), (4, "one TWO three four five six!", "c"), (None, "one two three four five six", "a"), (5, "hi", "a"), (6, "Hi", "a"), (7, "w " * 50_000, "a"), (None, "no id here", "a"), (None, "no id here", "a")]


def test_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, class_id string")
    found = neardup.near_duplicates(docs).collect()
    assert all(r.n_links == 0 and r.linked_id is None for r in found)
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in found)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (9, 4), (4, 4), (4, 4), (0, 4), (5, 5), (6, 5), (7, 7), (0, 0), (0, 0)])
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 1, 2, 3, 4, 5, 7]
    clash = docs.selectExpr("*", "doc_id as own_id", "1 as __dup_id", "2 as row", "3 as label", "true as __dup_all")
    kept = neardup.one_of_each(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id or 0 for r in kept.collect()) == ids
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.one_of_each(docs.limit(0)).count() == 0
