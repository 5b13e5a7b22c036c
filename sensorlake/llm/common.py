"""What several operators share: folds, and slices and pieces of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named string column holds about ``limit`` bytes at most; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


_GAP = re.compile(r"[\W_]")


def pieces(texts: list[str], limit: int) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """The texts cut between words, about ``limit`` characters at a time, with the number of each piece's text and the
    piece's first character there. Only a single word is ever longer."""
    held, of, at, n = [], [], [], 0
    for k, text in enumerate(texts):
        start = 0
        while start < len(text):
            gap = _GAP.search(text, start + limit - n) if len(text) - start > limit - n else None
            end = gap.start() if gap else len(text)
            held.append(text[start:end])
            of.append(k)
            at.append(start)
            n += end - start
            start = end
            if n >= limit:
                yield held, of, at
                held, of, at, n = [], [], [], 0
    if held:
        yield held, of, at
