"""Repair of conversations whose turns don't alternate: cheapest edits by Four-Russians block tables.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. The least cost to go from each state of that
pattern, at each place between two rows, is a vector of four numbers; one row turns the vector behind it into the one
before it. Vectors less their minimum are few, so for every block of BLOCK symbols and every such vector the result is
precomputed: a conversation is a lookup per block, from its end to its beginning. To find the edits, blocks are then
expanded backward one at a time and walked forward, always by the least edit in ASCII order among those that stay
on the cheapest way; as no two edits of equal initial lead from one state to different ones, that gives the least audit.

Conversations may be of any length. Rows are sorted in chunks by sampled ranges of (conversation, turn), so that one
conversation may lie in many chunks. One that lies within a chunk is repaired there. For the others each chunk becomes
a 4 x 4 matrix of least costs; the matrices of a conversation, at most one per chunk, give each chunk the vector behind it
and then its state of entry, and the chunks are walked side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import store

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: States: nothing yet, after the system's turn, after a user's turn, after an assistant's turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an insertion or a new role gives, by the state before it: only one of the two leads on.
GIVEN = {NONE: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLE = {"u": "user", "a": "assistant"}
#: Nothing is known to follow: only the end or another chunk.
FAR = 1 << 40
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: initial s, u, a or other, of a finished or an unfinished row; the last one has to be deleted.
INITIALS = "sua"
DELETED = 8
SYMBOLS, BLOCK = 9, 4
#: A conversation of more characters than this is treated in chunks even where it lies within one.
HELD = 32_000_000
#: Characters of role and text that order rows of equal turn before their digest does.
SHOWN = 64
BLANKS = " \t\n\x0b\x0c\r"


def symbol(initial: str, unfinished: bool, deleted: bool) -> int:
    return DELETED if deleted else 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + bool(unfinished)


def _edits(state: int, sym: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) that take the row ``sym`` in ``state``."""
    out = [("D", DELETE, state)]
    if sym != DELETED:
        initial = (*INITIALS, "")[sym // 2]
        if (state, initial) in NEXT:
            out.append(("K", KEEP + UNFINISHED * (sym % 2), NEXT[state, initial]))
        out.append(("R", REROLE + UNFINISHED * (sym % 2), NEXT[state, GIVEN[state]]))
    return out


def _with_inserts(plain: list[int]) -> tuple[int, ...]:
    after = [NEXT[q, GIVEN[q]] for q in range(4)]
    return tuple(min(plain[q], INSERT + plain[after[q]], 2 * INSERT + plain[after[after[q]]], FAR) for q in range(4))


def before_row(costs: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """The costs to go before a row, from those behind it."""
    return _with_inserts([min(c + costs[to] for _, c, to in _edits(q, sym)) for q in range(4)])


def _least(costs: Iterable[int]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(FAR if c >= FAR // 2 else c - low for c in costs), low


class Tables:
    """All vectors less their minimum that can occur, and what a symbol and a block of BLOCK symbols make of each."""

    def __init__(self):
        units = [tuple(0 if q == r else FAR for q in range(4)) for r in range(4)]
        self.vectors, self.number = [], {}
        for v in (AT_END, *units):
            self._add(v)
        to, more, k = [], [], 0
        while k < len(self.vectors):
            made = [_least(before_row(self.vectors[k], s)) for s in range(SYMBOLS)]
            to.append([self._add(v) for v, _ in made])
            more.append([c for _, c in made])
            k += 1
        self.to, self.more = np.array(to, np.int32), np.array(more, np.int64)
        self.block_to = np.arange(len(self.vectors), dtype=np.int32)[:, None]
        self.block_more = np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(BLOCK):  # the symbol in front of what is there comes first in a block's number
            reached = self.block_to
            n = len(self.vectors)
            self.block_to = self.to[reached].transpose(0, 2, 1).reshape(n, -1)
            self.block_more = (self.more[reached] + self.block_more[:, :, None]).transpose(0, 2, 1).reshape(n, -1)
        self.walks: dict[tuple[int, int, int], tuple[list[str], int]] = {}

    def _add(self, vector: tuple[int, ...]) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]


@cache
def tables() -> Tables:
    return Tables()


_POWERS = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def _blocks(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """The rows in front of the first whole block, and the whole blocks' numbers."""
    head = len(symbols) % BLOCK
    return symbols[:head].tolist(), (symbols[head:].reshape(-1, BLOCK) @ _POWERS).tolist()


def backward(symbols: np.ndarray, behind: tuple[int, ...]) -> tuple[tuple[int, ...], list[int]]:
    """The costs to go before the rows, and the number of the vector behind each of their blocks."""
    t = tables()
    head, blocks = _blocks(symbols)
    vector, cost = _least(behind)
    k, marks = t.number[vector], []
    for b in reversed(blocks):
        marks.append(k)
        cost += int(t.block_more[k, b])
        k = int(t.block_to[k, b])
    marks.append(k)
    for s in reversed(head):
        cost += int(t.more[k, s])
        k = int(t.to[k, s])
    return tuple(FAR if c >= FAR // 2 else c + cost for c in t.vectors[k]), marks[::-1]


def _walk(symbols: list[int], behind: int, state: int) -> tuple[list[str], int]:
    """The edits of each row of a block, its insertions before it, and the state in which it is left."""
    t = tables()
    to_go = [t.vectors[behind]]
    for s in reversed(symbols):
        to_go.append(before_row(to_go[-1], s))
    out = []
    for k, s in enumerate(symbols):
        here, there = to_go[len(symbols) - k], to_go[len(symbols) - k - 1]
        edits = ""
        while True:
            options = [(e, to, True) for e, c, to in _edits(state, s) if c + there[to] == here[state]]
            after = NEXT[state, GIVEN[state]]
            if INSERT + here[after] == here[state]:
                options.append(("I", after, False))
            edit, after, over = min(options)
            edits += edit + (GIVEN[state] if edit in "RI" else "-")
            state = after
            if over:
                break
        out.append(edits)
    return out, state


def forward(symbols: np.ndarray, marks: list[int], state: int) -> tuple[list[str], int]:
    """Each row's edits as pairs of initial and given role (``-`` for none), and the state behind the last row."""
    t = tables()
    head, blocks = _blocks(symbols)
    out, state = _walk(head, marks[0], state)
    start = len(head)
    for k, b in enumerate(blocks):
        found = t.walks.get((marks[k + 1], b, state))
        if found is None:
            found = t.walks[marks[k + 1], b, state] = _walk(symbols[start : start + BLOCK].tolist(), marks[k + 1], state)
        out += found[0]
        state = found[1]
        start += BLOCK
    return out, state


def last_inserts(state: int) -> str:
    out = ""
    while state in (SYSTEM, USER):
        out += "I" + GIVEN[state]
        state = NEXT[state, GIVEN[state]]
    return out


def matrix(symbols: np.ndarray) -> list[int]:
    """Least costs of the rows by state of entry and of exit, 16 numbers, FAR where there is no way."""
    columns = [backward(symbols, tuple(0 if q == r else FAR for q in range(4)))[0] for r in range(4)]
    return [columns[r][q] for q in range(4) for r in range(4)]


def in_front(costs: list[int], behind: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(FAR, *(costs[4 * q + r] + behind[r] for r in range(4))) for q in range(4))


# -- tables ------------------------------------------------------------------------------------------------------

#: What is known of an edit; an inserted row has neither turn nor earlier role nor fault.
EDIT = "edit string, turn long, was string, role string, text string, fault string"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FAULTS = ("blank", "duplicate", "truncated")
_PAIRS = {"su", "ua", "au"}


def summarised(edits: Iterable[tuple]) -> tuple:
    """The report of one conversation from its edits in order; nothing but the audit grows with them."""
    counts, pairs, cost, turns, least, most, last, initial = dict.fromkeys(FAULTS, 0), 0, 0, 0, None, None, None, None
    audit, digest, kept = [], hashlib.sha256(), 0
    for edit, turn, was, role, text, fault in edits:
        audit.append(edit)
        cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + UNFINISHED * (fault == "truncated" and edit != "D")
        if edit != "I":
            if fault:
                counts[fault] += 1
            if turn is not None:
                turns += turn != last
                least = turn if least is None else least
                last = most = turn
            first = was[:1]
            pairs += initial is not None and initial + first not in _PAIRS
            initial = first
        if edit != "D":
            digest.update(f"{chr(10) * bool(kept)}{role}:{text}".encode("utf-8", "surrogatepass"))
            kept += 1
    return (most - least + 1 - turns if turns else 0, *counts.values(), pairs, cost, "".join(audit), digest.hexdigest())


def _expanded(tokens: str, turn, role: str, text: str, fault) -> Iterator[tuple]:
    """A row's edits from their pairs, as EDIT has them; what follows the row's own edit are insertions too."""
    for k in range(0, len(tokens), 2):
        edit, given = tokens[k], ROLE.get(tokens[k + 1])
        yield ("I", None, None, given, "", None) if edit == "I" else (edit, turn, role, given or role, text, fault)


def _fault(blank: bool, again: bool, unfinished: bool) -> str | None:
    return "blank" if blank else "duplicate" if again else "truncated" if unfinished else None


def repaired(rows: list[tuple]) -> Iterator[tuple]:
    """The edits of a whole conversation; ``rows``: (turn, role, text, blank, unfinished) in order."""
    seen, faults = set(), []
    for _, role, text, blank, unfinished in rows:
        faults.append(_fault(blank, (role, text) in seen, unfinished))
        seen.add((role, text))
    symbols = np.array([symbol(r[1][:1], f == "truncated", f in ("blank", "duplicate")) for r, f in zip(rows, faults, strict=True)], np.int64)
    _, marks = backward(symbols, AT_END)
    tokens, state = forward(symbols, marks, NONE)
    for k, (turn, role, text, _, _) in enumerate(rows):
        yield from _expanded(tokens[k] + (last_inserts(state) if k == len(rows) - 1 else ""), turn, role, text, faults[k])


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of role and text as one space, and what the JVM can tell of a row by itself."""
    filled = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    return filled.withColumns({"blank": end == "", "unfinished": ~F.right(end, F.lit(1)).isin(".", "!", "?")})


def in_chunks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted by conversation, turn (null first), role and text (the first characters, then a digest) within ranges that
    are as even as their samples are, whatever a conversation's share. Equal rows may be parted too, by their number."""
    keys = {"__role": F.left("role", F.lit(SHOWN)), "__text": F.left("text", F.lit(SHOWN)), "__kind": F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256), "__nth": F.monotonically_increasing_id()}
    x = rows.withColumns(keys)
    order = ["conv_id", "turn", *keys]
    return x.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns, "__kind")


_COLUMNS = ["conv_id", "turn", "role", "text", "blank", "unfinished"]
_RAW = "turn long, role string, text string, blank boolean, unfinished boolean, kind string, again boolean, chunk int, place long"


def _chunk(batches: Iterator[pa.RecordBatch], out_schema: pa.Schema, found) -> Iterator[pa.RecordBatch]:
    """What a chunk holds: ``found`` (a list of tuples) of each conversation that lies within it, and the plain rows of the
    first and the last one, which may go on elsewhere, and of very large ones."""
    from pyspark import TaskContext

    chunk, place, size = TaskContext.get().partitionId(), 0, 0
    out: list[dict] = []

    def flushed():
        nonlocal out, size
        done, out, size = out, [], 0
        return pa.RecordBatch.from_pylist(done, out_schema)

    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def raw(conv, held, seen):
        nonlocal place, size
        for _, turn, role, text, blank, unfinished, kind in held:
            out.append({"conv_id": conv, "done": None, "raw": {"turn": turn, "role": role, "text": text, "blank": blank, "unfinished": unfinished, "kind": kind, "again": kind in seen, "chunk": chunk, "place": place}})
            seen.add(kind)
            place += 1
            size += len(text) + len(role) + 200
            if size > 4_000_000:
                yield flushed()

    first, waiting = True, None
    for conv, group in groupby(rows(), key=lambda r: r[0]):
        if waiting is not None:  # another one follows, so it ended here
            for item in found([r[1:6] for r in waiting[1]]):
                out.append({"conv_id": waiting[0], "done": item, "raw": None})
                size += sum(len(x) for x in item.values() if isinstance(x, str)) + 200
            if size > 4_000_000:
                yield flushed()
        held, waiting, n = [], None, 0
        seen = set()
        for row in group:
            held.append(row)
            n += len(row[2]) + len(row[3]) + 100
            if first or n > HELD:
                n = HELD + 1
                yield from raw(conv, held, seen)
                held = []
        waiting = (conv, held) if n <= HELD else None
        first = False
    if waiting is not None:
        yield from raw(waiting[0], waiting[1], set())
    if out:
        yield flushed()


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _within_chunks(rows: DataFrame, ddl: str, found) -> DataFrame:
    """conv_id, done (what ``found`` made, of type ``ddl``) or raw: stored, as both are read and chunks must not change."""
    kind = f"conv_id long, done struct<{_nested(ddl)}>, raw struct<{_nested(_RAW)}>"
    schema = _arrow(kind)
    chunks = in_chunks(marked(rows), _COLUMNS)
    return store(chunks.mapInArrow(lambda batches: _chunk(batches, schema, found), kind), "conversations-chunks")


def _nested(ddl: str) -> str:
    return ", ".join(": ".join(x.split(" ")) for x in ddl.split(", "))


def _across_chunks(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, place, turn, role, text, fault, tokens of the conversations that lie in several chunks. Texts take
    no part until the edits are known."""
    raw = chunks.where("raw IS NOT NULL").select("conv_id", "raw.*")
    # a row seen before in its chunk is a duplicate; the others, at most one a chunk, are compared with the other chunks'
    earlier = F.min(F.struct("chunk", "place")).over(Window.partitionBy("conv_id", "kind"))
    small = raw.select("conv_id", "chunk", "place", "kind", "again", "blank", "unfinished", F.left("role", F.lit(1)).alias("initial"))
    single = small.where(~F.col("again")).withColumn("again", F.struct("chunk", "place") > earlier)
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("unfinished"), "truncated")
    letter = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    sym = F.when(F.col("fault").isin("blank", "duplicate"), DELETED).when(F.col("fault") == "truncated", 2 * letter + 1).otherwise(2 * letter).cast("long")
    judged = store(single.unionByName(small.where("again")).withColumn("fault", fault).select("conv_id", "chunk", "place", "fault", sym.alias("sym")), "conversations-symbols")

    def costs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "chunk": [key[1]], "costs": [matrix(rows.sort_values("place")["sym"].to_numpy())]})

    def vectors(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", ascending=False)
        behind, out = AT_END, []
        for m in rows["costs"]:
            out.append(list(behind))
            behind = in_front(list(map(int, m)), behind)
        return pd.DataFrame({"conv_id": [key[0]] * len(rows), "chunk": rows["chunk"].to_numpy(), "behind": out, "last": [k == 0 for k in range(len(rows))]})

    def ways(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        symbols = rows["sym"].to_numpy()
        _, marks = backward(symbols, tuple(map(int, known["behind"].iloc[0])))
        found = [forward(symbols, marks, q) for q in range(4)]  # what is really behind a chunk can be reached from any state
        tokens = [list(x) for x in zip(*[f[0] for f in found], strict=True)]
        if known["last"].iloc[0]:
            tokens[-1] = [x + last_inserts(f[1]) for x, f in zip(tokens[-1], found, strict=True)]
        exits = [None] * (len(rows) - 1) + [[f[1] for f in found]]
        return pd.DataFrame({"conv_id": [key[0]] * len(rows), "chunk": key[1], "place": rows["place"].to_numpy(), "fault": rows["fault"].to_numpy(), "tokens": tokens, "exits": exits})

    def entries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        state, out = NONE, []
        for e in rows["exits"]:
            out.append(state)
            state = int(e[state])
        return pd.DataFrame({"conv_id": [key[0]] * len(rows), "chunk": rows["chunk"].to_numpy(), "entry": out})

    per_chunk = judged.groupBy("conv_id", "chunk")
    summed = per_chunk.applyInPandas(costs, "conv_id long, chunk int, costs array<long>")
    known = summed.groupBy("conv_id").applyInPandas(vectors, "conv_id long, chunk int, behind array<long>, last boolean")
    walked = per_chunk.cogroup(known.groupBy("conv_id", "chunk")).applyInPandas(ways, "conv_id long, chunk int, place long, fault string, tokens array<string>, exits array<int>")
    walked = store(walked, "conversations-walks")
    entered = walked.where("exits IS NOT NULL").select("conv_id", "chunk", "exits").groupBy("conv_id").applyInPandas(entries, "conv_id long, chunk int, entry int")
    e = entered.select(F.col("conv_id").alias("__c"), F.col("chunk").alias("__k"), "entry")
    chosen = walked.join(e, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("chunk") == F.col("__k"))).select("conv_id", "chunk", "place", "fault", F.get("tokens", "entry").alias("tokens"))
    return raw.select("chunk", "place", "turn", "role", "text").join(chosen, ["chunk", "place"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edits) of rows that come sorted by conversation, chunk and place; edits are read as they come."""

    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        yield conv, (e for _, _, _, turn, role, text, fault, tokens in group for e in _expanded(tokens, turn, role, text, fault))


_ORDERED = ["conv_id", "chunk", "place", "turn", "role", "text", "fault", "tokens"]


def repair(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation, one row per edit: conv_id, place (from 1), edit (K keeps a row, R gives it
    another role, D deletes it, I inserts one with an empty text), turn, was (the role before), role, text, fault.

    ``conversations``: conv_id, turn, role, text; others, of whatever name, aren't read. Rows are taken by turn, null
    first; rows of equal turn by role, then text (by their first 64 characters, then a digest). Null role or text is one
    space; a null conv_id is a conversation of its own. fault is ``blank`` (nothing but blanks), ``duplicate`` (role and text
    seen earlier) or ``truncated`` (the last character isn't one of ``.!?``), the first that holds. Blank and duplicate
    rows are deleted at 3; keeping is free, a new role or an insertion costs 2, deleting any other row 3, an unfinished
    row that stays 1. Of the cheapest the audit that is least in ASCII order is taken. An empty table gives an empty result.
    """

    def numbered(edits: Iterable[tuple]) -> list[dict]:
        return [dict(zip(("place", "edit", "turn", "was", "role", "text", "fault"), (k, *e), strict=True)) for k, e in enumerate(edits, 1)]

    ddl = "place long, " + EDIT
    chunks = _within_chunks(conversations, ddl, lambda rows: numbered(repaired(rows)))
    whole = chunks.where("done IS NOT NULL").select("conv_id", "done.*")
    schema = _arrow("conv_id long, " + ddl)

    def listed(batches):
        for conv, edits in _in_order(batches):
            held = []
            for k, e in enumerate(edits, 1):
                held.append(dict(zip(schema.names, (conv, k, *e), strict=True)))
                if len(held) == 1000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema)

    parts = _across_chunks(chunks).select(*_ORDERED).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    return whole.unionByName(parts.mapInArrow(listed, "conv_id long, " + ddl))


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: what ``repair`` does to each
    conversation that has rows, in short. The digest needs a conversation's texts in order, so one that lies in many chunks
    is read by one task, a row at a time; only its audit is held."""
    names = [x.split(" ")[0] for x in REPORT.split(", ")]
    chunks = _within_chunks(conversations, REPORT, lambda rows: [dict(zip(names, summarised(repaired(rows)), strict=True))])
    schema = _arrow("conv_id long, " + REPORT)

    def summed(batches):
        for conv, edits in _in_order(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (conv, *summarised(edits)), strict=True))], schema)

    parts = _across_chunks(chunks).select(*_ORDERED).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    return chunks.where("done IS NOT NULL").select("conv_id", "done.*").unionByName(parts.mapInArrow(summed, "conv_id long, " + REPORT))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    ``.!?`` out, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text")).withColumn("__d", F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20)
    text = F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.where(F.col("__d") != 0).select("conv_id", "turn", F.when(F.col("__d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "__d")
    return x.withColumn("__n", F.explode(F.when(F.col("__d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__d", "__n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every conversation after ``damaged``; those without a row left have zeros and an empty audit."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = report(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    counts = [x.split(" ")[0] for x in REPORT.split(", ") if x.endswith("long")]
    nothing = {c: F.lit(0).cast("long") for c in counts} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    out = found.withColumnRenamed("conv_id", "__c")
    return ids.join(out, F.col("conv_id").eqNullSafe(F.col("__c")), "left").select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in nothing.items()])


SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS codes
  FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS d FROM raw),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS n
  FROM hashed WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS k, left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM damaged),
faults AS (
  SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal,
         list({'i': i, 'x': fault IN ('blank', 'duplicate') AND fault IS NOT NULL, 't': (fault IS NOT NULL AND fault = 'truncated')::BIGINT, 'v': NULL::STRUCT(c BIGINT, a VARCHAR)[]} ORDER BY k DESC) AS rows
  FROM faults GROUP BY conv_id),
solved AS (
  SELECT * EXCLUDE (rows), list_reduce(list_prepend({'i': '', 'x': false, 't': 0::BIGINT, 'v': [{'c': 0::BIGINT, 'a': ''}, {'c': 4::BIGINT, 'a': 'II'}, {'c': 2::BIGINT, 'a': 'I'}, {'c': 0::BIGINT, 'a': ''}]}, rows), lambda p, r: {
    'i': r.i, 'x': r.x, 't': r.t,
    'v': list_transform([list_transform([1, 2, 3, 4], lambda q: list_min([
        {'c': p.v[q].c + 3, 'a': 'D' || p.v[q].a},
        CASE WHEN r.x THEN {'c': 1000000000::BIGINT, 'a': ''} ELSE {'c': p.v[[3, 3, 4, 3][q]].c + 2 + r.t, 'a': 'R' || p.v[[3, 3, 4, 3][q]].a} END,
        CASE WHEN r.x THEN {'c': 1000000000::BIGINT, 'a': ''}
             WHEN q = 1 AND r.i = 's' THEN {'c': p.v[2].c + r.t, 'a': 'K' || p.v[2].a}
             WHEN q <> 3 AND r.i = 'u' THEN {'c': p.v[3].c + r.t, 'a': 'K' || p.v[3].a}
             WHEN q = 3 AND r.i = 'a' THEN {'c': p.v[4].c + r.t, 'a': 'K' || p.v[4].a}
             ELSE {'c': 1000000000::BIGINT, 'a': ''} END]))],
      lambda b: list_transform([1, 2, 3, 4], lambda q: list_min([
        b[q], {'c': b[[3, 3, 4, 3][q]].c + 2, 'a': 'I' || b[[3, 3, 4, 3][q]].a}, {'c': b[[4, 4, 3, 4][q]].c + 4, 'a': 'II' || b[[4, 4, 3, 4][q]].a}])))[1]}).v[1] AS best FROM counted),
letters AS (
  SELECT conv_id, op, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS p, sum(CASE WHEN op <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS k,
         sum(CASE WHEN op <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS o, sum(CASE WHEN op <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS total
  FROM (SELECT conv_id, unnest(string_split(best.a, '')) AS op, generate_subscripts(string_split(best.a, ''), 1) AS p FROM solved)),
written AS (
  SELECT l.conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN f.role WHEN (o - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) FILTER (op <> 'D')) AS sha
  FROM letters l LEFT JOIN faults f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.k = f.k GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN solved s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN written w ON c.conv_id IS NOT DISTINCT FROM w.conv_id
"""
