"""Frames of one file in several tasks: byte ranges decoded apart, and stitched where they meet.

A range is read as if nothing were known of what lies before it. Its reader also reads a little beyond its end, twice: on
from where its own frames end, and as the next range's reader does. From the first frame that both find on, or where both
stand in the same state, they agree for good: that is the place where the next range takes over, and the few frames that
the first reader has found before it replace those that the next one has guessed. A small table of a row per range tells,
file by file, which ranges take over where and where reading ends. Files in which two readers don't come together
within REACH bytes are read in order, one range after the other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import store
from .frames import AUDIT, FIELDS, JUNK, KEY_TYPES, SQL_TYPES, decoded, frame_rows, status, walk_from

#: Bytes of a range, and bytes behind it within which two readers have to come together.
SIZE, REACH = 32 * 1024 * 1024, 64 * 1024
#: Bytes before a range that its reader sees too, as a footer may begin there.
LEAD = 128
#: More ranges with guesses to be dropped than this are joined by a shuffle, not broadcast.
BROADCAST_RANGES = 200_000

COLUMNS = ["file_id", "base", "lead", "own", "content"]


def beyond(junk: int, reach: int) -> int:
    """Bytes that a range's content holds behind its own."""
    return reach + 2 * junk + 128


def cut_ranges(files: DataFrame, size: int = SIZE, junk: int = JUNK, reach: int = REACH) -> DataFrame:
    """COLUMNS of whole files (file_id, content): ranges of ``size`` bytes with what their readers see around them. A null
    or empty content gives one empty range. ``size`` must hold what a reader sees beyond a range."""
    if size < beyond(junk, reach):
        raise ValueError(f"ranges must have {beyond(junk, reach)} bytes or more")
    n = F.length("content")
    base = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.coalesce(n, F.lit(0)) - 1).cast("long"), F.lit(size).cast("long")))
    x = files.select("file_id", F.coalesce("content", F.lit(b"")).alias("content"), base.alias("base"))
    lead = F.least(F.col("base"), F.lit(LEAD))
    own = F.least(F.lit(size), F.length("content") - F.col("base"))
    content = F.substring("content", (F.col("base") - lead + 1).cast("int"), (lead + size + beyond(junk, reach)).cast("int"))
    return x.select("file_id", "base", lead.alias("lead"), own.alias("own"), content.alias("content"))


def _told(state: tuple, shift: int, raw: bytes) -> dict:
    """A state in the file's own places; of the end also whether the footer is near and the status."""
    if state[0] != "done":
        return {"mode": state[0], "at": state[1] + shift}
    footer, name = status(raw, state[1], state[2])
    return {"mode": "done", "at": state[1] + shift, "footer": footer, "status": name}


def border(raw: bytes, edge: int, exit_: tuple, junk: int, reach: int) -> tuple[np.ndarray, np.ndarray, int | None, tuple]:
    """How reading goes on behind ``edge`` from the state ``exit_``: (frames' places and kinds up to where the next range's
    own reading agrees, that place or None, the state reached)."""
    limit = edge + reach
    limit = None if limit >= len(raw) else limit
    at, kind, state = walk_from(raw, junk, exit_, limit)
    guess, _, guessed = walk_from(raw, junk, ("scan", edge), limit)
    both = np.intersect1d(at, guess)
    if len(both):
        first = int(both[0])
        return at[at < first], kind[at < first], first, state
    if state == guessed and state[0] != "done":
        return at, kind, max(edge, limit), state
    return at, kind, None, state


def decode_ranges(ranges: DataFrame, junk: int = JUNK, reach: int = REACH) -> DataFrame:
    """What ``decode_frames`` gives of the whole files, from their COLUMNS: a row per frame, and one of kind FILE per file.

    Ranges follow one another without gaps; only a file's last one may have fewer bytes than readers see beyond a range.
    Every range is decoded where it is read, into the shared folder; no file is ever gathered. What is then dropped or added
    are the frames around the borders."""
    key_sql = ranges.schema["file_id"].dataType.simpleString()
    key_type = KEY_TYPES[key_sql]
    frame_columns = ", ".join(f"{c} {SQL_TYPES[t]}" for c, t in (FIELDS | AUDIT).items())
    schema = f"file_id {key_sql}, kind string, offset long, {frame_columns}"
    stored = f"{schema}, base long, carried boolean, told string"

    def tagged(batch: pa.RecordBatch, base: int, carried: bool, told: str | None = None) -> pa.RecordBatch:
        n = batch.num_rows
        more = [pa.array([base] * n, pa.int64()), pa.array([carried] * n), pa.array([told] * n, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "base", "carried", "told"])

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, base, lead, own, raw in zip(*[c if c.type == pa.binary() else c.to_pylist() for c in batch.columns], strict=True):
                raw = raw.as_py() or b""
                edge, shift = lead + own, base - lead
                last = len(raw) <= edge
                at, kind, exit_ = walk_from(raw, junk, ("scan", lead), None if last else edge)
                told = {"bytes": own, "exit": _told(exit_, shift, raw)}
                for out in decoded("file_id", key, key_type, raw, at, kind, shift):
                    yield tagged(out, base, False)
                if exit_[0] != "done":
                    more, kinds, merged, state = border(raw, edge, exit_, junk, reach)
                    told |= {"merged": None if merged is None else merged + shift, "behind": _told(state, shift, raw)}
                    for out in decoded("file_id", key, key_type, raw, more, kinds, shift):
                        yield tagged(out, base + own, True)
                yield tagged(frame_rows("file_id", key, key_type, "RANGE", np.array([base]), {}), base, False, json.dumps(told))

    read = store(ranges.select(*COLUMNS).mapInArrow(guess, stored), "ranges")
    plan = "file_id " + key_sql + ", base long, dropped_before long, own boolean, lost boolean, file_bytes long, parsed_bytes long, footer_found boolean, status string"
    plan_schema = to_arrow_schema(StructType.fromDDL(plan))

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for key, own in groupby(rows, key=lambda r: r[0]):
            # what the range before says: from where on this range's frames hold, and whether the ones that it has carried on do
            from_, carried, end, lost, size, out = 0, False, None, False, 0, []
            for _, base, told in own:
                told = json.loads(told)
                size += told["bytes"]
                out.append({"file_id": key, "base": base, "dropped_before": 2**62 if from_ is None else from_, "own": carried, "lost": False})
                carried = False
                if from_ is None:
                    continue
                if told["exit"]["mode"] == "done":
                    end, from_ = told["exit"], None
                else:
                    carried, from_ = True, told["merged"]
                    if from_ is None:
                        lost = told["behind"]["mode"] != "done"
                        end = told["behind"]
            for r in out:
                r["lost"] = lost
            whole = {"file_id": key, "base": None, "lost": lost, "file_bytes": size, "parsed_bytes": end["at"], "footer_found": end.get("footer"), "status": end.get("status")}
            yield pa.RecordBatch.from_pylist([*out, whole], plan_schema)

    borders = read.where("kind = 'RANGE'").select("file_id", "base", "told").repartition("file_id").sortWithinPartitions("file_id", "base")
    plans = store(borders.mapInArrow(stitched, plan), "range-plans")
    frames = read.where("kind <> 'RANGE'")
    columns = schema_names = [x.split(" ")[0] for x in schema.split(", ")]
    # most ranges hold from their first frame on: only what is to be dropped is looked up
    first = read.where("kind <> 'RANGE' AND NOT carried").groupBy("file_id", "base").agg(F.min("offset").alias("first"))
    p = plans.where("base IS NOT NULL").select(F.col("file_id").alias("__f"), F.col("base").alias("__b"), "dropped_before", "own", "lost")
    same = (F.col("__f").eqNullSafe(F.col("file_id"))) & (F.col("__b") == F.col("base"))
    drops = store(p.join(first, same).where((F.col("dropped_before") > F.col("first")) | F.col("lost")).select("__f", "__b", "dropped_before", "lost"), "range-drops")
    few = F.broadcast(drops) if drops.count() <= BROADCAST_RANGES else drops
    kept = frames.where("NOT carried").join(few, same, "left").where("dropped_before IS NULL OR (NOT lost AND offset >= dropped_before)").select(*columns)
    over = frames.where("carried").join(p.where("own AND NOT lost"), same, "left_semi").select(*columns)
    whole = plans.where("base IS NULL AND NOT lost").select("file_id", F.lit("FILE").alias("kind"), F.lit(-1).cast("long").alias("offset"), *AUDIT)
    out = kept.unionByName(over).unionByName(whole, allowMissingColumns=True)
    lost = plans.where("base IS NULL AND lost").select(F.col("file_id").alias("__f"))
    if lost.limit(1).count():
        out = out.unionByName(in_order(ranges.join(lost, F.col("file_id").eqNullSafe(F.col("__f")), "left_semi"), schema, key_sql, junk))
    return out.select(*schema_names)


def in_order(ranges: DataFrame, schema: str, key_sql: str, junk: int) -> DataFrame:
    """``decode_ranges`` of files whose ranges are read one after the other; a task holds one range at a time."""
    key_type = KEY_TYPES[key_sql]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*[c if c.type == pa.binary() else c.to_pylist() for c in batch.columns], strict=True))
        for key, own_ranges in groupby(rows, key=lambda r: r[0]):
            state, size, told = ("scan", 0), 0, None
            for _, base, lead, own, raw in own_ranges:
                size += own
                if state[0] == "done":
                    continue
                raw, shift = raw.as_py() or b"", base - lead
                edge = lead + own
                at, kind, state = walk_from(raw, junk, (state[0], state[1] - shift), None if len(raw) <= edge else edge)
                yield from decoded("file_id", key, key_type, raw, at, kind, shift)
                told = _told(state, shift, raw)
                state = (state[0], state[1] + shift)
            audit = {"file_bytes": size, "parsed_bytes": told["at"], "footer_found": told.get("footer"), "status": told.get("status")}
            yield frame_rows("file_id", key, key_type, "FILE", np.array([-1]), {c: [v] for c, v in audit.items()})

    return ranges.select(*COLUMNS).repartition("file_id").sortWithinPartitions("file_id", "base").mapInArrow(run, schema)
