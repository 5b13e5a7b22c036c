"""Each stage against a plain version, on what the stage before kept."""

import corpus_pipeline
import pytest
from sensorlake.llm import mixing, pii
from sensorlake.shared import store
from test_neardup import brute


SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_stay(stages):
    assert all(d.columns == COLUMNS for d in stages[:-1])


def test_toxicity_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in d.collect()} for d in stages[:2])
    gone = before - after
    assert gone and after
    known = [labels[d] for d in gone if d in labels]
    assert sum(known) >= 0.8 * len(known)
    assert sum(1 for d, t in labels.items() if not t and d in gone) <= 0.02 * len(labels)


def test_one_of_each_class_stays(stages):
    texts = {r.doc_id: r.text for r in stages[1].collect()}
    assert {r.doc_id for r in stages[2].collect()} == set(brute(texts).values())


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert r.text == (None if before[d].text is None else pii.redact_text(before[d].text)) and r.n_chars == len(r.text or "")
        assert not [s for s in pii.spans_of(r.text or "") if s[0] in ("email", "ip", "card")]


def test_copies_follow_the_mix(stages):
    want = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()} == want


def test_packing_holds_every_copy(stages):
    copies = {}
    for r in stages[4].collect():
        copies.setdefault(r.doc_id, [r.text, 0])[1] += 1
    rows = stages[5].collect()
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    once = {r.doc_id: r.doc_tokens for r in rows}
    assert tokens == {d: once[d] * n for d, (_, n) in copies.items()}
    single = {d: t for d, (t, n) in copies.items() if n == 1}
    chosen = [r for r in rows if r.doc_id in single]
    ends = {}
    for r in rows:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert max(ends.values()) <= 4096 and sum(ends.values()) == sum(r.length for r in rows)
    assert chosen


def test_run_and_extra_columns(spark, tmp_path, stages):
    again = corpus_pipeline.run(spark, SF)
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(again.collect()) == key(stages[5].collect())
    clash = stages[0].selectExpr("*", "1 as score", "'x' as size", "2 as prediction", "3 as label", "4 as hash", "5 as node")
    docs = clash
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, SF), "clash")
        assert docs.columns == clash.columns
    assert corpus_pipeline.pack(spark, docs, SF).count() > 0


def test_empty_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "", None, "a", 0), (2, "word", None, None, None)], docs.schema)
    for start in (odd, docs.limit(0)):
        x = start
        for _, stage in corpus_pipeline.STAGES:
            x = store(stage(spark, x, SF), "odd")
        assert x.count() > 0 if start is odd else x.count() == 0
