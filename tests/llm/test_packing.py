import random
import zlib

import numpy as np
from sensorlake.llm import packing, tokenizing
from sensorlake.llm.tokenizing import vocabulary, word_encoder


def whole(text):
    return np.frombuffer(word_encoder(vocabulary("word_bpe_49k.json"))._whole(text), "<u4").tolist()


def test_memo_gives_the_ids_of_the_whole_text():
    rng = random.Random(5)
    encoder = word_encoder(vocabulary("word_bpe_49k.json"))
    pieces = ["the", "DON'T", "'ll", "é", "É", "ß", "²", "½", "ª", "_", "__a", "1984", " ", "\u0085", "\x1c", "İ", "Σ", "日本", "é", "<|endoftext|>", " ", "\n", "!!", "a.b", "ŉ", "ǅ", "​", "'", "s", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole(text), repr(text)


def test_special_tokens_as_the_library_has_them():
    """Against a tokenizer with its default settings, and one that takes their names as text."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    plain, spelled = Tokenizer.from_file(path), Tokenizer.from_file(path)
    spelled.encode_special_tokens = True
    texts = ["<|endoftext|>", "a <|ENDOFTEXT|> b", "x<|startoftext|>y", "<|end oftext|>", "<| a", "a <|endoftext", "é<|endoftext|>日本", "plain words, 12 of them"]
    for text in texts:
        for tokenizer, special in ((plain, True), (spelled, False)):
            got = np.frombuffer(word_encoder(path, special).ids(text), "<u4").tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids, (text, special)
    assert np.frombuffer(word_encoder(path).ids("<|endoftext|>"), "<u4").tolist() == [49407]


def test_memos_are_bounded():
    encoder = tokenizing.WordEncoder(vocabulary("word_bpe_49k.json"), memo=50)
    for k in range(300):
        text = f"word{k} a.b{k} word"
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole(text)
        assert len(encoder.memo) <= 50 and len(encoder.words) <= 50


def test_every_character_of_the_fast_range():
    encoder = word_encoder(vocabulary("word_bpe_49k.json"))
    for c in map(chr, range(0x250)):
        for text in (f"a{c}b", f"{c}{c}", f"1{c}.", f"'{c}s", f"A {c}"):
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole(text), repr(text)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(200):
        sizes = np.array([rng.randint(1, 50) for _ in range(rng.randint(1, 60))])
        window, offset, n = packing.best_fit_decreasing(sizes, 50)
        rooms = []
        for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in rooms if r >= sizes[item]]
            room = min(fits) if fits else 50
            if fits:
                rooms.remove(room)
            assert offset[item] == 50 - room
            rooms.append(room - sizes[item])
        assert n == len(rooms)


def check(rows, texts, capacity):
    """Round trip: pieces rebuild every document, and fill windows without gap or overlap."""
    got, windows = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for doc_id, text in texts.items():
        pieces = sorted(got[doc_id], key=lambda r: r.start)
        ids = [i for r in pieces for i in r.ids]
        assert ids == [*whole(text or ""), 2] and {r.doc_tokens for r in pieces} == {len(ids)}
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    for pieces in windows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs.repartition(3), pool_tokens=50_000).collect()
    check(rows, texts, 4096)
    full = sum(r.length for r in rows) / (4096 * len({r.sequence_id for r in rows}))
    assert full > 0.9


def test_nulls_long_texts_and_empty_table(spark):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "x"}
    docs = spark.createDataFrame([(*kv, 0) for kv in texts.items()], "doc_id long, text string, length int")
    check(packing.pack(docs, capacity=1024).collect(), texts, 1024)
    twice = packing.pack(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string").coalesce(1)).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, 2}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
