"""What a file's segments hand on from one to the next, for files of any number of segments.

A segment's state depends on the one before it, through offsets without bound. A chunk of segments is therefore made a
function of the state it is entered with, in parallel; a file's functions, one small row per chunk, are applied one after
the other; and each chunk is then walked from the state that it is really entered with, in parallel again.

The function is short because a state says little. Whether a sensor hands anything on is known from the segment's own
numbers, unless the clocks of the segment disagree, and then no sensor does; the last reading is that of the segment, too.
So only the offsets are open. Walked with open offsets, a segment says which of them it accepts: their differences lie
within bounds. Only segments that narrow the bounds matter, each with the state in which the chunk ends if it is the
first to refuse; if none refuses, the chunk ends with the offsets moved by what was counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Segments of a chunk.
CHUNK = 4096

SENSORS = ("pps", "gnss", "imu")
NAMES = (*SENSORS, "counter")


class Rules:
    """How a segment follows from the one before it.

    A state is None (nothing is handed on) or a dict of the offsets of those sensors that hand theirs on, by name; the
    last readings are in the row of the segment before."""

    def __init__(self, share: float, max_value: int, counter_max: int, carry_from: int, deviation: int):
        self.share, self.carry_from, self.deviation = share, carry_from, deviation
        self.sizes = {s: counter_max if s == "counter" else max_value for s in NAMES}

    def hands_on(self, row: dict) -> list[str]:
        return [s for s in NAMES if row["imu" if s == "counter" else s]["n"] >= self.carry_from]

    def turned(self, alive, before: dict | None, row: dict) -> dict[str, bool]:
        """Which sensors' clocks have turned since the segment before; ``alive`` are those that it hands on."""
        last = {s: before[s]["last"] if s in alive else None for s in NAMES}
        return {s: None not in (last[s], row[s]["first"]) and last[s] - row[s]["first"] > self.share * self.sizes[s] for s in NAMES}

    def step(self, state: dict, before: dict | None, row: dict) -> tuple[dict, dict, bool, dict]:
        """(starts, turned, whether the clocks agree, the state handed on) of a segment."""
        turned = self.turned(state, before, row)
        start = {s: state.get(s, 0) + turned[s] * self.sizes[s] for s in NAMES}
        seen = [s for s in SENSORS if row[s]["low"] is not None]
        spreads = [max(at) - min(at) for at in ([row[s][end] + start[s] for s in seen] for end in ("low", "high")) if at]
        ok = max(spreads, default=0) <= self.deviation
        return start, turned, ok, {s: start[s] + row[s]["wraps"] * self.sizes[s] for s in self.hands_on(row)} if ok else {}

    def walked(self, state: dict, before: dict | None, rows: list[dict]) -> dict:
        for row in rows:
            state = self.step(state, before, row)[3]
            before = row
        return state


def _key(a: str, b: str) -> str:
    return f"{a}-{b}" if b else a


class Chunk:
    """A chunk's function from the offsets it is entered with to those it hands on."""

    def __init__(self, rules: Rules, before: dict | None, rows: list[dict]):
        self.from_nothing = rules.walked({}, before, rows)
        self.refusals: list[tuple[dict, dict]] = []  # bounds that a segment adds, and the end if it is the first to refuse
        self.end: tuple[dict, list[str]] = ({}, [])  # offsets, and which of them are added to the entered ones
        if before is None:
            return
        # A run from nothing behind segment k ends as an earlier one does from where their states meet.
        ends: dict[tuple, dict] = {}
        open_ = set(rules.hands_on(before))
        state, bounds = dict.fromkeys(open_, 0), {}
        for k, row in enumerate(rows):
            turned = rules.turned(state, before, row)
            start = {s: state.get(s, 0) + turned[s] * rules.sizes[s] for s in NAMES}
            seen = [s for s in SENSORS if row[s]["low"] is not None]
            added, agree = {}, True
            for end in ("low", "high"):
                for a, b in combinations(seen, 2):
                    apart = row[a][end] + start[a] - row[b][end] - start[b]
                    one, other = (a, b) if a in open_ else (b, a)
                    if one not in open_:
                        agree = agree and abs(apart) <= rules.deviation
                        continue
                    apart = apart if one == a else -apart
                    # |entered one - entered other (if that is open) + apart| is within the deviation
                    name = _key(one, other if other in open_ else "")
                    low, high = -rules.deviation - apart, rules.deviation - apart
                    was = added.get(name, (low, high))
                    added[name] = (max(low, was[0]), min(high, was[1]))
            narrower = {n: r for n, r in added.items() if n not in bounds or r[0] > bounds[n][0] or r[1] < bounds[n][1]}
            if narrower or not agree:
                end = self._after_nothing(rules, rows, k, ends)
                if not agree:
                    self.end = (end, [])
                    return
                self.refusals.append((narrower, end))
                for n, r in narrower.items():
                    was = bounds.get(n, r)
                    bounds[n] = (max(was[0], r[0]), min(was[1], r[1]))
            handed = rules.hands_on(row)
            state = {s: start[s] + row[s]["wraps"] * rules.sizes[s] for s in handed}
            open_ &= set(handed)
            before = row
        self.end = (state, sorted(open_))

    @staticmethod
    def _after_nothing(rules: Rules, rows: list[dict], k: int, ends: dict) -> dict:
        state, passed = {}, []
        for j in range(k + 1, len(rows)):
            at = (j, tuple(sorted(state.items())))
            if at in ends:
                state = ends[at]
                break
            passed.append(at)
            state = rules.step(state, rows[j - 1], rows[j])[3]
        ends.update(dict.fromkeys(passed, state))
        return state

    def told(self) -> str:
        return json.dumps([self.from_nothing, self.refusals, self.end])


def applied(told: str, state: dict) -> dict:
    """The state that a chunk hands on when it is entered with ``state``."""
    from_nothing, refusals, (end, added) = json.loads(told)
    if not state:
        return from_nothing
    for bounds, refused in refusals:
        for name, (low, high) in bounds.items():
            one, _, other = name.partition("-")
            if not low <= state[one] - (state[other] if other else 0) <= high:
                return refused
    return {s: at + (state[s] if s in added else 0) for s, at in end.items()}


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    return groupby((row for batch in batches for row in batch.to_pylist()), key=lambda r: tuple(r[k] for k in keys))


def carry(summary: DataFrame, rules: Rules, chunk: int = CHUNK) -> DataFrame:
    """Per segment of ``summary`` the offsets that it starts with, which clocks turned before it, and whether its clocks agree.

    No task sees all segments of a file: chunks of ``chunk`` segments are read twice, and one row per chunk, of a few
    offsets and bounds, passes one task per file in order. A chunk's function has a row per segment that narrows the
    bounds of the offsets; there are few of them unless clocks drift apart all the time."""
    key_type = summary.schema["file_id"].dataType.simpleString()
    dealt = summary.select("file_id", "segment", *NAMES).withColumn("chunk", F.floor(F.col("segment") / chunk)).withColumn("part", F.lit(1))
    last = dealt.groupBy("file_id", "chunk").agg(F.max_by(F.struct(*NAMES), "segment").alias("x"))
    in_file = Window.partitionBy("file_id").orderBy("chunk")
    before = last.withColumn("x", F.lag("x").over(in_file)).where("x IS NOT NULL").select("file_id", F.lit(None).cast("int").alias("segment"), "x.*", "chunk", F.lit(0).alias("part"))
    rows = dealt.unionByName(before)  # a chunk's first row is the last one of the chunk before
    by_chunk = lambda x: x.repartition("file_id", "chunk").sortWithinPartitions("file_id", "chunk", "part", "segment")

    functions = f"file_id {key_type}, chunk bigint, told string"
    function_schema = to_arrow_schema(StructType.fromDDL(functions))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file_id, number), own in _runs(batches, ("file_id", "chunk")):
            own = list(own)
            prior = own.pop(0) if own[0]["part"] == 0 else None
            yield pa.RecordBatch.from_pylist([{"file_id": file_id, "chunk": number, "told": Chunk(rules, prior, own).told()}], function_schema)

    entries = f"file_id {key_type}, chunk bigint, entered string"
    entry_schema = to_arrow_schema(StructType.fromDDL(entries))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file_id,), own in _runs(batches, ("file_id",)):
            state, out = {}, []
            for r in own:
                out.append({"file_id": file_id, "chunk": r["chunk"], "entered": json.dumps(state)})
                state = applied(r["told"], state)
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, entry_schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, entry_schema)

    starts = by_chunk(rows).mapInArrow(summed, functions).repartition("file_id").sortWithinPartitions("file_id", "chunk").mapInArrow(entered, entries)
    starts = starts.withColumn("part", F.lit(-1))
    started, turned_at = [f"{s}_start" for s in NAMES], [f"{s}_turned" for s in NAMES]
    result = ", ".join([f"file_id {key_type}, segment int", *[f"{c} bigint" for c in started], *[f"{c} boolean" for c in turned_at], "consistency_ok boolean"])
    result_schema = to_arrow_schema(StructType.fromDDL(result))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file_id, _), own in _runs(batches, ("file_id", "chunk")):
            state, prior, out = {}, None, []
            for r in own:
                if r["part"] == -1:
                    state = json.loads(r["entered"])
                elif r["part"] == 1:
                    start, turned, ok, state = rules.step(state, prior, r)
                    out.append((file_id, r["segment"], *start.values(), *turned.values(), ok))
                prior = r if r["part"] >= 0 else None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), result_schema, strict=True)] if out else [pa.array([], f.type) for f in result_schema], schema=result_schema)

    return by_chunk(rows.unionByName(starts, allowMissingColumns=True)).mapInArrow(walked, result)
