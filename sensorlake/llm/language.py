"""Language of spans and documents: scripts narrow the candidates, character n-grams score each word, and a Viterbi
path with a penalty for switching labels the words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import store
from .common import fold, pieces, slices
from .labelled import least_hashed

#: Documents per language that the model is fitted on, at most; chosen by the hash of their ids.
PER_LANGUAGE = 1500
BUCKET_BITS = 16
ORDERS = (2, 3, 4)
#: What a change of language costs, in nats of the words' scores.
SWITCH = 15.0
#: What a language costs whose texts have less than RARE of their letters in the word's script; such ones aren't scored.
FOREIGN, RARE = 60.0, 0.002
#: Bytes of texts in a slice (one text at least), and characters that are looked at at a time.
SLICE, PIECE = 2_000_000, 500_000
#: Languages up to which the way back takes a byte each.
BYTES = 64
#: The sample of more languages than this is joined by a shuffle, not broadcast.
BROADCAST_LANGUAGES = 256

#: First and last code points of scripts; letters elsewhere are of script 0.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, whether it is a letter, and its script."""
    n = 0x110000
    lower, letter, script = np.arange(n, dtype=np.uint32), np.zeros(n, bool), np.zeros(n, np.uint8)
    for c in range(0x33480):
        s = chr(c)
        letter[c] = s.isalpha()
        if letter[c] and len(s.lower()) == 1:
            lower[c] = ord(s.lower())
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, letter, script


class Words:
    """The words (runs of letters) of many texts, and the hash buckets of their n-grams."""

    def __init__(self, texts: list[str]):
        lower, letter, script = characters()
        lengths = np.array([len(t) for t in texts], np.int64)
        # four blanks before, between and after the texts keep n-grams apart
        raw = np.frombuffer(("    " + "    ".join(texts) + "    ").encode("utf-32-le"), "<u4")
        is_letter = letter[raw]
        change = np.diff(is_letter.astype(np.int8))
        self.start, self.end = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
        text_start = np.cumsum(np.append(4, lengths[:-1] + 4)) if len(texts) else np.zeros(0, np.int64)
        self.text = np.searchsorted(text_start, self.start, "right") - 1
        self.first, self.last = self.start - text_start[self.text], self.end - text_start[self.text]
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.script = script[raw[self.start]]
        self.codes, self.is_letter = np.where(is_letter, lower[raw], 32).astype(np.uint64), is_letter

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per order: the bucket of the n-gram that begins at each place, and whether it lies in a word with the blanks
        beside it."""
        hashed = self.codes.copy()
        inner = None
        for n in range(2, max(ORDERS) + 1):
            hashed = hashed[:-1] * np.uint64(0x9E3779B1) + self.codes[n - 1 :]
            inner = self.is_letter[1:-1] if n == 3 else inner[:-1] & self.is_letter[n - 2 : -1] if n > 3 else None
            if n in ORDERS:
                valid = inner if n > 2 else self.is_letter[:-1] | self.is_letter[1:]
                yield ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), valid

    def scores(self, model: LanguageModel) -> np.ndarray:
        """(words, languages): sums of the n-grams' log probabilities for the languages that use the word's script. The
        others' tables aren't looked at: they stand FOREIGN below the least of those."""
        out = np.zeros((len(self.start), len(model.languages)), np.float32)
        if not len(self.start) or not len(model.languages):
            return out
        grams = list(self.grams())
        for script in np.unique(self.script).tolist():
            own = np.flatnonzero(self.script == script)
            known = np.flatnonzero(model.uses[script])
            # n-grams that begin at the blank before a word or at one of its letters, word after word
            start, sizes = self.start[own] - 1, self.end[own] - self.start[own] + 1
            firsts = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) + np.repeat(start - firsts, sizes)
            found = [(bucket[np.minimum(at, len(bucket) - 1)], valid[np.minimum(at, len(bucket) - 1)] & (at < len(bucket))) for bucket, valid in grams]
            for k in known.tolist():
                table = model.tables[k]
                held = sum(np.where(valid, table[bucket], np.float32(0)) for bucket, valid in found)
                out[own, k] = np.add.reduceat(held.astype(np.float64), firsts) / len(ORDERS)
            others = np.flatnonzero(~model.uses[script])
            if len(others):
                out[np.ix_(own, others)] = out[np.ix_(own, known)].min(axis=1, keepdims=True) - FOREIGN
        return out


class LanguageModel:
    """Names, log probabilities of n-gram buckets (a row of 256 KB per language), and which languages use a script."""

    def __init__(self, languages: list[str], tables: np.ndarray, uses: np.ndarray):
        self.languages, self.tables, self.uses = languages, tables, uses


def scored(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first character, end and scores of each word of the texts. Only the scores of a long text are held whole,
    at 4 bytes a word and language; its characters are looked at PIECE at a time."""
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros((0, len(model.languages)), np.float32),)]
    for parts, of, at in pieces(texts, PIECE):
        words = Words(parts)
        of, at = np.array(of)[words.text], np.array(at)[words.text]
        found.append((of, words.first + at, words.last + at, words.scores(model)))
    return tuple(np.concatenate(x) for x in zip(*found))


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word. The words of a text follow one another; all texts take a step at a time. Of each step are kept
    whether a language's best way comes from another one (a byte per language, a bit where there are over BYTES) and the best."""
    languages = scores.shape[1]
    packed = languages > BYTES
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-counts, kind="stable")
    first, length = (np.cumsum(counts) - counts)[order], counts[order]
    steps = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(steps), "left")
    switched, best = np.zeros((len(scores), (languages + 7) // 8 if packed else languages), np.uint8), np.zeros(len(scores), np.int32)
    value = np.zeros((len(order), languages))
    for t in range(steps):
        n = running[t]
        at, v = first[:n] + t, value[:n]
        if t:
            top = v.argmax(axis=1)
            jump = v[np.arange(n), top][:, None] - penalty
            switched[at], best[at] = np.packbits(jump > v, axis=1) if packed else jump > v, top
            v = np.maximum(v, jump)
        value[:n] = v + scores[at]
    state = value.argmax(axis=1) if len(order) else None
    for t in range(steps - 1, -1, -1):
        n = running[t]
        at, s = first[:n] + t, state[:n]
        labels[at] = s
        if t:
            state[:n] = np.where(switched[at, s // 8] >> (7 - s % 8) & 1 if packed else switched[at, s], best[at], s)
    return labels


def fit(docs: DataFrame, allowed: Column | None = None, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` documents of each non-null ``lang``, out of those that ``allowed`` (a condition
    over doc_id) admits. A repeated id counts once, with its greatest text and language. All languages are learned; of
    each, one row of at most 256 KB comes to the driver. Without labelled documents the model knows no language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if allowed is None else allowed))
    ids = store(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("lang").alias("lang")), "language-ids")
    languages = sorted(r["lang"] for r in ids.select("lang").distinct().collect())
    chosen = store(least_hashed(ids, per_language, "lang"), "language-sample")
    side = F.broadcast(chosen) if len(languages) <= BROADCAST_LANGUAGES else chosen
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(side, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("lang").alias("lang"), F.max("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", SLICE):
            by: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, own in by.items():
                for parts, _, _ in pieces(own, PIECE):
                    words = Words(parts)
                    for bucket, valid in words.grams():
                        grams[lang] = grams.get(lang, 0) + np.bincount(bucket[valid], minlength=1 << BUCKET_BITS)
                    letters[lang] = letters.get(lang, 0) + np.bincount(words.script, words.end - words.start, 1 + len(SCRIPTS)).astype(np.int64)
        for kind, found in (("gram", grams), ("script", letters)):
            for lang, n in found.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "kind", "at", "n"])

    def table(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 + len(SCRIPTS), np.int64)
        for part in parts:
            gram, at, n = np.array(part.column("kind").to_pylist()) == "gram", part.column("at").to_numpy(), part.column("n").to_numpy()
            grams[at[gram]], scripts[at[~gram]] = n[gram], n[~gram]
        log = np.log((grams + 0.5) / (grams.sum() + 0.5 * (1 << BUCKET_BITS))).astype("<f4")
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "grams": [log.tobytes()], "scripts": [scripts.tolist()]})

    # summed before and behind the shuffle; a language has 65556 numbers at most
    summed = texts.mapInArrow(count, "lang string, kind string, at long, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    counted = summed.groupBy("lang").applyInArrow(table, COUNTED)
    unseen = np.full(1 << BUCKET_BITS, -np.log(1 << BUCKET_BITS), np.float32)
    tables, scripts = np.tile(unseen, (len(languages), 1)), np.zeros((len(languages), 1 + len(SCRIPTS)))
    place = {lang: k for k, lang in enumerate(languages)}
    for r in counted.toLocalIterator() if languages else ():
        tables[place[r["lang"]]] = np.frombuffer(r["grams"], "<f4")
        scripts[place[r["lang"]]] = r["scripts"]
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    uses = (share >= RARE).T
    uses[~uses.any(axis=1)] = True  # a script that no language is known to use excludes none
    return LanguageModel(languages, tables, uses)


COUNTED = "lang string, grams binary, scripts array<long>"
SPANS = "array<struct<start: long, end: long, lang: string>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans of every document, one row per input row; only the text is looked at.

    ``spans`` are runs of words of one language, in characters (end exclusive). ``lang_pred`` is the language of most
    letters (of the first name on a tie) and ``score`` its share of the letters. ``und`` with score 0 and no spans for
    null texts, texts without letters, and a model without languages. Repeated rows are labelled alike; an empty
    table gives an empty result. Texts are read whole, in slices of bounded size, without a shuffle."""
    languages = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            n, k = batch.num_rows, len(model.languages)
            text, first, last, scores = scored([t or "" for t in batch.column("text").to_pylist()], model)
            if not k or not len(text):
                empty = [pa.array(["und"] * n), pa.array([0.0] * n), pa.array([[]] * n, _ARROW)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *empty], ["doc_id", "lang_pred", "score", "spans"])
                continue
            labels = viterbi(scores, np.bincount(text, minlength=n), switch)
            letters = np.bincount(text * k + labels, last - first, n * k).reshape(n, k)
            total = letters.sum(axis=1)
            best = np.where(total > 0, letters.argmax(axis=1), k)
            score = np.where(total > 0, letters.max(axis=1) / np.maximum(1, total), 0.0)
            opens = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(labels) != 0)))
            closes = np.append(opens[1:] - 1, len(labels) - 1)
            offsets = np.searchsorted(text[opens], np.arange(n + 1))
            values = pa.StructArray.from_arrays([pa.array(first[opens]), pa.array(last[closes]), pa.array(languages[labels[opens]], pa.string())], ["start", "end", "lang"])
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages[best], pa.string()), pa.array(score), spans], ["doc_id", "lang_pred", "score", "spans"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def query(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold(F.col("doc_id"), 5) == 0
    found = identify(docs, fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
