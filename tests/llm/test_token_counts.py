import random

import numpy as np
import pytest
from sensorlake.llm import token_counts
from sensorlake.llm.tokenizing import byte_encoder, vocabulary
from tokenizers import Tokenizer


def encoder():
    return byte_encoder(vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json"))


def test_spans_equal_the_other_library():
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    pieces = ["the", " ", "\n", "\n\n", "é", "日本", "🙂", "  ", "1", "don't", "<|endoftext|>", "."]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30)))
        ids, a, b = encoder().spans(text)
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        assert all(0 <= x < y <= len(text) for x, y in zip(a, b))
        assert a[0] == 0 and b[-1] == len(text) and (a[1:] <= b[:-1]).all() and (b[:-1] - a[1:] <= 1).all()


def brute(starts, ends, cuts, rule):
    tokens, share, touching, crossing = [0] * len(cuts), [0.0] * len(cuts), [0] * len(cuts), [0] * len(cuts)
    for a, b in zip(starts, ends):
        chars = []
        for s in range(len(cuts)):
            lo = cuts[s - 1] if s else 0
            chars.append(sum(1 for c in range(a, b) if lo <= c < cuts[s]))
        at = next(k for k, n in enumerate(chars) if n) if rule == "first" else chars.index(max(chars))
        tokens[at] += 1
        held = [k for k, n in enumerate(chars) if n]
        for k in held:
            share[k] += chars[k] / (b - a)
            touching[k] += 1
            crossing[k] += len(held) > 1
    return tokens, share, touching, crossing


@pytest.mark.parametrize("rule", ["first", "most"])
def test_allocation_against_brute_force(rule):
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 40)
        cuts = sorted(rng.sample(range(1, n + 1), rng.randint(1, n)))
        if cuts[-1] != n:
            cuts.append(n)
        bounds = sorted(rng.sample(range(1, n), rng.randint(0, n - 1))) if n > 1 else []
        starts, ends = np.array([0, *bounds]), np.array([*bounds, n])
        got = token_counts.allocate(starts, ends, np.array(cuts), rule)
        want = brute(starts, ends, cuts, rule)
        for g, w in zip(got, want):
            assert np.allclose(g, w)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {}
    for r in token_counts.attribute_tokens(docs).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows.keys() == texts.keys()
    for doc_id, parts in rows.items():
        parts.sort(key=lambda r: r.section)
        assert parts[0].start == 0 and parts[-1].end == len(texts[doc_id])
        assert all(p.end == q.start for p, q in zip(parts, parts[1:]))
        n = len(encoder().ids(texts[doc_id]))
        assert sum(p.tokens for p in parts) == n == parts[0].doc_tokens and abs(sum(p.share for p in parts) - n) < 1e-6
        assert "".join(texts[doc_id][p.start : p.end] for p in parts) == texts[doc_id]


def test_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a\n\nb", 5), (3, " " * 2_000_000, 5), (4, "a" * 500_000, 5)]
    got = token_counts.attribute_tokens(spark.createDataFrame(rows, "doc_id long, text string, tokens int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.start, r.end, r.tokens) for r in by[1] + by[2]] == [(0, 0, 0), (0, 0, 0)]
    assert len(by[None]) == 3 and by[3][0].tokens > 0 and by[4][0].tokens > 0
    assert token_counts.attribute_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        token_counts.attribute_tokens(spark.createDataFrame(rows, "doc_id long, text string, tokens int"), rule="last")
