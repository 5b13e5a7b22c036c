"""Token counts per section, attributed by character offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .tokenizing import byte_encoder, vocabulary

SCHEMA = "doc_id long, section long, start long, end long, tokens long, share double, touching long, crossing long, doc_tokens long"


def allocate(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Interval join of token spans to the sections that tile the text: per section the tokens by ``rule``, the tokens
    in proportion to characters, how many touch it, and how many of these cross its bounds.

    Rules: ``first``: to the section of the token's first character; ``most``: to the section that holds most of its
    characters, the earliest on a tie."""
    n = len(section_ends)
    a = np.searchsorted(section_ends, starts, "right")
    b = np.searchsorted(section_ends, ends - 1, "right")
    inside = a == b
    tokens = np.bincount(a[inside], minlength=n)
    share, touching, crossing = tokens.astype(float), tokens.copy(), np.zeros(n, np.int64)
    for k in np.flatnonzero(~inside).tolist():
        sections = np.arange(a[k], b[k] + 1)
        bounds = np.concatenate([[starts[k]], section_ends[a[k] : b[k]], [ends[k]]])
        chars = np.diff(bounds)
        tokens[a[k] if rule == "first" else sections[np.argmax(chars)]] += 1
        share[sections] += chars / (ends[k] - starts[k])
        held = sections[chars > 0]
        touching[held] += 1
        crossing[held] += 1
    return tokens, share, touching, crossing


def attribute_tokens(docs: DataFrame, rule: str = "most", separator: str = "\n", vocabulary_file: str | None = None, fallback_file: str | None = None) -> DataFrame:
    """One row per section of each document (SCHEMA): its character span, and its tokens when the whole document is
    encoded once.

    Sections end after each match of the regular expression ``separator`` and tile the text. A token that crosses a
    bound is allocated by ``rule`` in ``tokens`` and by its characters in ``share``; over a document's sections either
    adds up to ``doc_tokens``. A token that holds part of a character's bytes spans that character. Null and empty
    texts have one empty section without tokens; repeated rows are counted row by row; an empty table gives an empty
    result; columns other than doc_id and text are ignored. Nothing is shuffled, and tokens never become rows.
    """
    path, fallback = vocabulary_file or vocabulary("byte_bpe_50k.tiktoken"), fallback_file or vocabulary("byte_bpe_50k.json")
    if rule not in ("first", "most"):
        raise ValueError(f"unknown rule {rule!r}")
    pattern = re.compile(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, fallback)
        for batch in slices(batches, "text", 4_000_000):
            parts: list[tuple] = []
            ids: list = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                cuts = [m.end() for m in pattern.finditer(text) if m.end() > m.start()]
                if not cuts or cuts[-1] < len(text):
                    cuts.append(len(text))
                cut = np.array(cuts, np.int64)
                tokens, starts, ends = encoder.spans(text)
                got = allocate(starts, ends, cut, rule) if len(text) else (np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))
                parts.append((np.arange(len(cut)), np.concatenate([[0], cut[:-1]]), cut, *got, np.full(len(cut), len(tokens))))
                ids += [doc_id] * len(cut)
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.float64() if c.dtype == float else pa.int64()) for c in columns]], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """The tokens of every section of all ``documents``."""
    return attribute_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
