import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from sensorlake.llm import language
from sensorlake.llm.common import fold

SF = "/root/testdata/sf0.01"


def brute(scores, penalty):
    """Best path of one text over all languages, by trying every predecessor."""
    best, back = list(scores[0]), []
    for row in scores[1:]:
        step = []
        for k in range(len(row)):
            j = max(range(len(row)), key=lambda j: best[j] - (penalty if j != k else 0))
            step.append(j)
        back.append(step)
        best = [best[step[k]] - (penalty if step[k] != k else 0) + row[k] for k in range(len(row))]
    return max(best)


def value(scores, labels, penalty):
    return sum(s[k] for s, k in zip(scores, labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:]))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 60)
    scores = rng.normal(0, 3, (counts.sum(), 3))
    labels = language.viterbi(scores, counts, 2.5)
    first = 0
    for n in counts:
        own = scores[first : first + n]
        if n:
            assert abs(value(own, labels[first : first + n], 2.5) - brute(own, 2.5)) < 1e-9
        first += n


def test_words_and_scores_by_hand():
    texts = ["Ab cd!", "", "éA\nx", "1 2"]
    w = language.Words(texts)
    assert [(t, texts[t][a:b]) for t, a, b in zip(w.text, w.first, w.last)] == [(0, "Ab"), (0, "cd"), (2, "éA"), (2, "x")]
    tables = np.random.default_rng(1).normal(size=(2, 1 << language.BUCKET_BITS))
    model = language.LanguageModel(["p", "q"], tables.astype(np.float32), np.ones((1 + len(language.SCRIPTS), 2), bool))
    together = w.scores(model)
    alone = np.concatenate([language.Words([x]).scores(model) for x in ("ab", "cd", "éa", "x")])
    assert np.allclose(together, alone)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_is_cut_into_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text").between(300, 3000))
    model = language.fit(docs, fold(F.col("doc_id"), 5) != 0)
    en, de = (docs.where((F.col("lang") == x) & (fold(F.col("doc_id"), 5) == 0)).orderBy("doc_id").first().text for x in ("en", "de"))
    r = language.identify(spark.createDataFrame([(1, en + "\n" + de)], "doc_id long, text string"), model).first()
    assert {s.lang for s in r.spans} >= {"en", "de"}
    assert any(s.lang == "en" and s.end > 0.8 * len(en) and s.start < 0.2 * len(en) for s in r.spans)
    long = max(r.spans, key=lambda s: (s.lang == "de") * (s.end - s.start))
    assert abs(long.start - len(en)) < 200


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, x, lang) for i, (x, lang) in enumerate([("hello there my friend", "en"), ("привет мой друг", "ru")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = language.identify(spark.createDataFrame([(1, "zzz qqq"), (2, "щщщ ъъъ")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "en", 2: "ru"}


def test_cases(spark):
    rows = [(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "12 !", None, 0.5), (None, "some words here", "en", 0.5), (5, "some words here", "en", 0.5), (5, "some words here", "en", 0.5), (6, "w" * 200_000, "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.identify(docs, language.fit(docs)).collect()
    assert [(r.lang_pred, len(r.spans)) for r in got] == [("und", 0)] * 3 + [("en", 1)] * 4
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert language.identify(docs.limit(0), language.fit(docs)).count() == 0


def test_labels_ids_and_sources_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs, fold(F.col("doc_id"), 5) != 0)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(other, model).collect()} == plain
    assert random.choice(list(plain.values()))


def test_long_texts_in_pieces(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(60).collect()] + ["", "x" * 500, " ".join(r.text for r in docs.where("text is not null").limit(40).collect())]
    whole = language.scored(texts, model)
    monkeypatch.setattr(language, "PIECE", 90)
    parts = language.scored(texts, model)
    assert all((a == b).all() for a, b in zip(whole[:3], parts[:3])) and np.allclose(whole[3], parts[3])


def plain_words(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text)]


def plain_bucket(gram):
    """As the module states: a polynomial of the code points in 64 bits, mixed, its upper bits."""
    h = 0
    for c in gram:
        h = (h * 0x9E3779B1 + ord(c)) % 2**64
    return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - language.BUCKET_BITS)


def plain_grams(text, a, b):
    """The n-grams that begin at the blank before a word or at one of its letters and lie in it with a blank on each side;
    of pairs also those that end in what follows."""
    word = " " + text[a:b].lower() + " "
    for n in language.ORDERS:
        for k in range(len(word) - n + 1):
            yield word[k : k + n]


def script_of(c):
    return next((k for k, ranges in enumerate(language.SCRIPTS.values(), 1) if any(x <= ord(c) <= y for x, y in ranges)), 0)


def test_fit_scores_and_labels_by_brute_force(spark):
    samples = {"en": ["the cat and the dog", "a word of the day", "and then of"], "de": ["der hund und die katze", "ein wort der zeit"], "ru": ["привет мой друг", "слово дня и ночи"], "el": ["καλη μερα φιλε μου"]}
    rows = [(10 * j + i, t, lang) for j, (lang, texts) in enumerate(samples.items()) for i, t in enumerate(texts)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names = sorted(samples)
    assert model.languages == names
    logs, shares = {}, {}
    for lang, texts in samples.items():
        grams = Counter(plain_bucket(g) for t in texts for a, b in plain_words(t) for g in plain_grams(t, a, b))
        logs[lang] = {g: math.log((n + 0.5) / (grams.total() + 0.5 * 2**16)) for g, n in grams.items()} | {None: math.log(0.5 / (grams.total() + 0.5 * 2**16))}
        letters = Counter(script_of(t[a]) for t in texts for a, b in plain_words(t) for _ in range(a, b))
        shares[lang] = {k: n / letters.total() for k, n in letters.items()}
    mixed = ["the katze und the dog", "привет the друг", "μερα und слово", "zz щщ", "ა б"]

    def scores(text):
        out = []
        for a, b in plain_words(text):
            uses = [x for x in names if shares[x].get(script_of(text[a]), 0) >= language.RARE] or names
            own = {x: sum(logs[x].get(plain_bucket(g), logs[x][None]) for g in plain_grams(text, a, b)) / 3 for x in uses}
            out.append([own.get(x, min(own.values()) - language.FOREIGN) for x in names])
        return out

    text, first, last, got = language.scored(mixed, model)
    want = [row for t in mixed for row in scores(t)]
    assert [(t, a, b) for t, a, b in zip(text, first, last)] == [(k, a, b) for k, t in enumerate(mixed) for a, b in plain_words(t)]
    assert np.allclose(got, want, atol=1e-3)
    labelled = language.identify(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string"), model, 2.0).collect()
    for r in labelled:
        t = mixed[r.doc_id]
        letters = Counter()
        labels = []
        for a, b in plain_words(t):
            lang = next(s.lang for s in r.spans if s.start <= a and b <= s.end)
            letters[lang] += b - a
            labels.append(names.index(lang))
        assert abs(value(scores(t), labels, 2.0) - brute(scores(t), 2.0)) < 1e-2
        top = min(letters, key=lambda x: (-letters[x], x))
        assert r.lang_pred == top and abs(r.score - letters[top] / letters.total()) < 1e-9


def test_many_languages_and_hot_ones(spark, monkeypatch):
    rows = [(i, f"word{i} text", "hot" if i % 3 else f"l{i // 3:03d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs).languages == sorted({x for _, _, x in rows}) and len({x for _, _, x in rows}) == 301
    monkeypatch.setattr(language, "BROADCAST_LANGUAGES", 2)
    model = language.fit(docs)
    assert len(model.languages) == 301 and model.tables.dtype == np.float32
    rng = np.random.default_rng(5)
    counts, scores = np.array([4, 0, 7]), rng.normal(0, 3, (11, 301))
    labels = language.viterbi(scores, counts, 4.0)
    assert abs(value(scores[4:], labels[4:], 4.0) - brute(scores[4:], 4.0)) < 1e-9
