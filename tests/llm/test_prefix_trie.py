import hashlib
import random
import zlib

import pytest

from sensorlake.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes, built by inserting one conversation after the other."""
    turns = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    members = {(): []} if turns else {}
    ends = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = turns.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    out = []
    for node, own in members.items():
        below = [v for v in members if v[: len(node)] == node]
        childless = [v for v in below if not any(len(w) == len(v) + 1 and w[:-1] == v for w in members)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        children = sum(len(w) == len(node) + 1 and w[:-1] == node for w in members)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, len(childless), saved, sha))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA):
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.trie(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=str)


def conversations(rng, n, longest, texts):
    return [(c, k, ("user", "assistant")[k % 2], rng.choice(texts)) for c in range(n) for k in range(rng.randrange(1, longest + 1))]


def test_nodes_equal_plain_ones_over_many_blocks(spark):
    rng = random.Random(4)
    rows = conversations(rng, 30, 11, ["a", "bé", "c" * 9])
    rows += [(c, k, "user", f"{k}") for c in (100, 105, 111) for k in range(45)] + [(112, k, "user", f"{k}" if k < 37 else "x") for k in range(50)]
    assert found(spark, rows) == plain(rows)


def test_turnless_conversations_nulls_ties_and_repeated_rows(spark):
    rows = [(c, 0, "user", "only") for c in range(40, 60) if c % 5] + [(-7, 1, None, None), (-7, None, "system", ""), (-5, 2, "user", "x"), (None, 1, "user", "lost")]
    rows += [(3, 1, "user", "tie"), (3, 1, "assistant", "tie"), (3, 1, "user", "tie"), (3, None, "user", "first")]
    want = plain(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)  # some end in the root
    assert found(spark, rows) == want


@pytest.fixture
def apart(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_conversations_in_several_chunks_scans_and_pieces(spark, apart, monkeypatch):
    monkeypatch.setattr(pt, "SCANNED", 3)
    monkeypatch.setattr(pt, "PIECE", 4)
    rng = random.Random(8)
    rows = conversations(rng, 25, 4, ["a", "b"]) + [(c, k, "user", f"{k % 50}") for c in (200, 203) for k in range(70)]
    rows += [(c, 0, "user", "the same") for c in range(300, 330)]
    assert found(spark, rows) == plain(rows)
    turns = pt.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert turns.where("conv_id = 200").select("chunk").distinct().count() > 1
    assert sorted(r["pos"] for r in turns.where("conv_id = 200").collect()) == list(range(1, 71))


def test_empty_tables_clashing_columns_and_long_texts(spark):
    assert found(spark, []) == []
    rows = [(5, 0, "user", "y" * 2_000_000, 1, "k", 3), (6, 0, "user", "z", None, None, None)]
    assert found(spark, rows, SCHEMA + ", pos long, kind string, block long") == plain([r[:4] for r in rows])
