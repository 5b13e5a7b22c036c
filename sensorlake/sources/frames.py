"""Frames out of raw bytes, with recovery from junk.

The bytes of a file are searched once for markers and footers. Frames that follow one another without a gap are taken
as runs; only gaps are looked at one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the file format: markers, frames with their marker and padding, and the footer's text.
KINDS = ("PPS", "GNSS", "IMU")
MARKERS = {b"\nPPS": 0, b"\nGPS": 1, b"\nIMU": 2}
SIZES = np.array([8, 40, 24])
LAYOUTS = [
    [("micros_reading", "<u4")],
    [("micros_reading", "<u4"), ("latitude", "<i4"), ("longitude", "<i4"), ("posix_timestamp", "<i4"), ("microseconds", "<u4"), ("ned_vel_north", "<i4"), ("ned_vel_east", "<i4"), ("ned_vel_down", "<i4"), ("fix_type", "u1")],
    [("micros_reading", "<u4"), ("counter", "<u2"), ("acc_x", "<i2"), ("acc_y", "<i2"), ("acc_z", "<i2"), ("gyr_x", "<i2"), ("gyr_y", "<i2"), ("gyr_z", "<i2")],
]
FOOTER = b"Log stop OLA"
#: Junk bytes after a frame before the next marker is searched for, and bytes that this search covers.
JUNK = 1024

FIELDS = {"micros_reading": pa.int64(), "counter": pa.int32(), **{f"{s}_{a}": pa.int16() for s in ("acc", "gyr") for a in "xyz"}, "latitude": pa.int32(), "longitude": pa.int32(), "posix_timestamp": pa.int32(), "microseconds": pa.int64(), **{f"ned_vel_{a}": pa.int32() for a in ("north", "east", "down")}, "fix_type": pa.int16()}
AUDIT = {"file_bytes": pa.int64(), "parsed_bytes": pa.int64(), "footer_found": pa.bool_(), "status": pa.string()}
SQL_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.int16(): "short", pa.bool_(): "boolean", pa.string(): "string"}
CHUNK = 100_000


def places(content: bytes, what: bytes) -> np.ndarray:
    return np.array([m.start() for m in re.finditer(re.escape(what), content)], np.int64)


#: Where reading stands between two frames: how it looks for the next one, and from which place.
#: ``scan``: up to the next marker or footer, however far; ``after`` a frame: junk is counted; ``done``: place and reason.
State = tuple


def walk(content: bytes, junk: int = JUNK) -> tuple[np.ndarray, np.ndarray, int, str]:
    """Frames' positions and kinds, where reading stopped, and why: footer, end, truncated or corrupt."""
    at, kind, (_, stop, why) = walk_from(content, junk, ("scan", 0))
    return at, kind, stop, why


def walk_from(content: bytes, junk: int, state: State, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, State]:
    """Positions and kinds of the frames that begin before ``limit``, and the state behind them, which is done or stands at
    ``limit`` or beyond. ``content`` reaches to the end of the file, or more than 2 * junk + 64 bytes beyond ``limit``;
    without a limit it is read to its end."""
    n = len(content)
    limit, final = (n + 1, True) if limit is None else (limit, False)
    found = sorted((p, k) for m, k in MARKERS.items() for p in places(content, m).tolist())
    at, kind = np.array([p for p, _ in found], np.int64), np.array([k for _, k in found], np.int64)
    foot = places(content, FOOTER)
    end_of = at + SIZES[kind] if len(at) else at
    follower = np.searchsorted(at, end_of)
    adjoins = (follower < len(at)) & (at[np.minimum(follower, max(0, len(at) - 1))] == end_of) if len(at) else np.zeros(0, bool)
    # last of the run of neighbouring candidates that each candidate starts
    breaks = np.flatnonzero(~(adjoins & (follower == np.arange(len(at)) + 1)))
    inside = int(np.searchsorted(at, limit)) - 1  # the last candidate before the limit
    taken: list[np.ndarray] = []

    def first(places: np.ndarray, from_: int) -> int | None:
        k = np.searchsorted(places, from_)
        return int(places[k]) if k < len(places) else None

    def left(*state):
        frames = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        return at[frames], kind[frames], state

    mode, after = state
    while True:
        if after >= limit:
            return left(mode, after)
        start = after
        if mode == "after" and after < n and content[after] != 10:
            line = content.find(b"\n", after, after + junk)
            spot = first(foot, after)
            spots = [p for p in (line if line >= 0 else None, max(after, spot - 8) if spot is not None else None) if p is not None and p < after + junk]
            if spots:
                start = min(spots)
            elif n < after + junk:
                return left("done", n, "end")
            else:
                search = after + junk
                x, f = first(at, search), first(foot, search)
                spots = [p for p, size in ((x, 4), (f, len(FOOTER))) if p is not None and p + size <= search + junk]
                if not spots:
                    return left("done", search, "corrupt")
                start = min(spots)
            if start >= limit:
                return left("scan", start)
        k = int(np.searchsorted(at, start))
        x = int(at[k]) if k <= inside else None
        f = first(foot, start)
        if f is not None and (x is None or x > start) and f <= (min(n, limit) if x is None else x) - 1 + 10:
            return left("done", max(start, f - 10), "footer")
        if x is None:
            return left("done", n, "end") if final else left("scan", limit)
        if end_of[k] > n:
            return left("done", x, "truncated")
        while True:  # the run, and what adjoins it beyond markers within payloads
            last = min(inside, int(breaks[np.searchsorted(breaks, k)]))
            if end_of[last] > n:  # only the file's last frame can be cut off
                last -= 1
                taken.append(np.arange(k, last + 1))
                return left("done", int(at[last + 1]), "truncated")
            taken.append(np.arange(k, last + 1))
            if not adjoins[last] or follower[last] > inside:
                break
            k = int(follower[last])
            if end_of[k] > n:
                return left("done", int(at[k]), "truncated")
        mode, after = "after", int(end_of[last])


def status(content: bytes, stop: int, why: str) -> tuple[bool, str]:
    footer = FOOTER in content[max(0, stop - 100) : stop + 100]
    return footer, "complete" if footer else {"end": "missing footer", "footer": "complete"}.get(why, why)


def frame_rows(file_id: str, key, key_type: pa.DataType, name: str, offsets: np.ndarray, values: dict) -> pa.RecordBatch:
    n = len(offsets)
    columns = [pa.array([key] * n, key_type), pa.array([name] * n, pa.string()), pa.array(offsets)]
    columns += [pa.array(values[c], t) if c in values else pa.nulls(n, t) for c, t in (FIELDS | AUDIT).items()]
    return pa.RecordBatch.from_arrays(columns, [file_id, "kind", "offset", *FIELDS, *AUDIT])


def decoded(file_id: str, key, key_type: pa.DataType, raw: bytes, position: np.ndarray, kind: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
    """The frames at ``position`` in ``raw``, whose first byte is at ``start`` in its file."""
    view = np.frombuffer(raw, np.uint8)
    for k, name in enumerate(KINDS):
        own = position[kind == k]
        layout = np.dtype(LAYOUTS[k])
        for a in range(0, len(own), CHUNK):
            some = own[a : a + CHUNK]
            packed = view[some[:, None] + 4 + np.arange(layout.itemsize)]
            fields = np.ascontiguousarray(packed).view(layout).ravel()
            yield frame_rows(file_id, key, key_type, name, some + start, {c: fields[c].astype(np.int64) for c in layout.names})


KEY_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def decode_frames(files: DataFrame, file_id: str = "file_id", content: str = "content", junk: int = JUNK, base: str | None = None) -> DataFrame:
    """One row per frame: file_id, kind, offset (its byte in the file) and the columns of its kind, others null; and
    one row of kind FILE per file, at offset -1, with what the audit needs. Contents go no further than this step.

    A null or empty content gives the FILE row only. Batches hold few files and rows leave in chunks.

    A file may come in several rows, cut between frames: ``base`` names the column with the place of a row's first byte,
    from which offsets count, and each row gives a FILE row, one below its base."""

    def rows(key, raw: bytes, start: int) -> Iterator[pa.RecordBatch]:
        position, kind, stop, why = walk(raw, junk)
        footer, state = status(raw, stop, why)
        audit = {"file_bytes": len(raw), "parsed_bytes": stop, "footer_found": footer, "status": state}
        yield frame_rows(file_id, key, key_type, "FILE", np.array([start - 1]), {c: [v] for c, v in audit.items()})
        yield from decoded(file_id, key, key_type, raw, position, kind, start)

    kept = files.select(F.col(file_id), F.col(content).alias("content"), (F.lit(0) if base is None else F.col(base)).cast("long").alias("base"))
    key_sql = kept.schema[0].dataType.simpleString()
    key_type = KEY_TYPES[key_sql]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, raw, start in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                yield from rows(key, raw.as_py() or b"", start or 0)

    columns = ", ".join(f"{c} {SQL_TYPES[t]}" for c, t in (FIELDS | AUDIT).items())
    return kept.mapInArrow(run, f"`{file_id}` {key_sql}, kind string, offset long, {columns}")


COMMON = ["file_id", "kind", "offset"]
COLUMNS = {
    "PPS": ["micros_reading"],
    "GNSS": [n for n, _ in LAYOUTS[1]],
    "IMU": [n for n, _ in LAYOUTS[2]],
}


def of_kind(frames: DataFrame, kind: str, *more: str) -> DataFrame:
    """The frames of one kind with its own columns."""
    return frames.where(F.col("kind") == kind).select(*COMMON, *COLUMNS[kind], *more)


def audit(frames: DataFrame) -> DataFrame:
    """Per file: bytes, bytes parsed and their share, frames of each kind, bytes per frame, whether the footer was found
    near the end, and the status: complete, missing footer, truncated or corrupt. The parts of a file are summed; their
    status is that of the first that wasn't read to its end, else that of the last."""
    n = [F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS]
    own = F.when(F.col("kind") == "FILE", F.col("offset"))
    stopped = F.when(F.col("status").isin("truncated", "corrupt"), F.col("offset"))
    status = F.coalesce(F.min_by("status", stopped), F.max_by("status", own))
    known = [F.sum("file_bytes").alias("file_bytes"), F.sum("parsed_bytes").alias("parsed_bytes"), F.max("footer_found").alias("footer_found"), status.alias("status")]
    x = frames.groupBy("file_id").agg(*known, *n)
    total = F.col("n_pps") + F.col("n_gnss") + F.col("n_imu")
    return x.withColumns({"share_parsed": F.col("parsed_bytes") / F.nullif(F.col("file_bytes"), F.lit(0)), "bytes_per_frame": F.col("parsed_bytes") / F.nullif(total, F.lit(0))})
