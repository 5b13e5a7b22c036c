"""Packing documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices
from .tokenizing import vocabulary, word_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Tokens that one task holds at a time; they are packed together. 2 million tokens fill about 500 windows.
POOL_TOKENS = 2_000_000


class OpenWindows:
    """Open windows by remaining capacity. A segment tree counts them, so the least capacity that still takes an item
    is found in log2(capacity) steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (remaining capacity, window) of the tightest window with room for ``size``."""
        node, count = self.leaves + size, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right neighbour holds a window
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.windows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each item (1 <= size <= capacity), and the number of windows. Equal sizes keep their order."""
    window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    opened, n = OpenWindows(capacity), 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        room, at = opened.take(size) or (capacity, n)
        n += at == n
        window[item], offset[item] = at, capacity - room
        if room > size:
            opened.add(room - size, at)
    return window, offset, n


def pack_pool(doc_ids: list, ids: list[np.ndarray], capacity: int, first: int, with_ids: bool = True) -> tuple[pa.RecordBatch, int]:
    """Pieces of the documents of one pool; windows are numbered from ``first``. A pool has some document."""
    docs, starts, lengths = [], [], []
    for k, x in enumerate(ids):
        for start in range(0, len(x), capacity):
            docs.append(k)
            starts.append(start)
            lengths.append(min(capacity, len(x) - start))
    window, offset, n = best_fit_decreasing(np.array(lengths, np.int64), capacity)
    pieces = [ids[k][s : s + m] for k, s, m in zip(docs, starts, lengths)]
    columns = {
        "doc_id": pa.array([doc_ids[k] for k in docs], pa.int64()),
        "start": pa.array(starts, pa.int64()),
        "length": pa.array(lengths, pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
        "doc_tokens": pa.array([len(ids[k]) for k in docs], pa.int64()),
        "sequence_id": pa.array(first + window),
        "offset": pa.array(offset),
    }
    if with_ids:
        offsets = np.cumsum([0, *lengths]).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces).view(np.int32)))
    return pa.RecordBatch.from_pydict(columns), first + n


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 2, tokenizer: str | None = None, pool_tokens: int = POOL_TOKENS, with_ids: bool = True, special: bool = True) -> DataFrame:
    """Pack documents into windows of ``capacity`` tokens; returns one row per piece (SCHEMA, and ``ids`` if wanted).

    ``docs`` needs doc_id and text; other columns are ignored. Each document is tokenized once and ends with
    ``end_id``; names of special tokens in a text are these tokens, or plain text if ``special`` is False. A document over ``capacity`` is first cut into full windows and a rest; rests and whole documents go,
    longest first, to the tightest open window. Null and empty texts are one piece of one token; repeated rows and
    equal or null ids are packed row by row; an empty table gives an empty result.

    Nothing is shuffled: a task packs what it reads, in pools of about ``pool_tokens`` tokens, so memory is bounded
    by a pool and the longest document, and no key can be hot. Only the last windows of a pool are padded. A task that
    runs again reads the same rows in the same order and gives the same pieces.
    """
    path = tokenizer or vocabulary("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, doc_ids, ids = word_encoder(path, special), 0, [], []
        sequence = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", 4_000_000):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                x = np.frombuffer(encoder.ids(text or "") + end, "<u4")
                doc_ids.append(doc_id)
                ids.append(x)
                held += len(x)
                if held >= pool_tokens:
                    out, sequence = pack_pool(doc_ids, ids, capacity, sequence, with_ids)
                    yield out
                    held, doc_ids, ids = 0, [], []
        if ids:
            out, sequence = pack_pool(doc_ids, ids, capacity, sequence, with_ids)
            yield out

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def query(spark, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents``, each with its sequence and place."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
