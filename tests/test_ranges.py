"""Any cut of a file into byte ranges gives the frames of one reading."""

import random

import numpy as np
import pytest
from frames_model import FOOTER, HEADER, gnss, imu, pps
from pyspark.sql import functions as F
from sensorlake.sources import decode_frames, ranges
from sensorlake.sources.frames import walk, walk_from
from sensorlake.sources.ranges import beyond, border, cut_ranges, decode_ranges
from test_frames import CASES, PIECES


@pytest.mark.parametrize("junk", [16, 40])
def test_walking_from_any_state_goes_on_as_before(junk):
    rng = random.Random(junk)
    for _ in range(3000):
        content = b"".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        at, kind, stop, why = walk(content, junk)
        state, start, found = ("scan", 0), 0, []
        while state[0] != "done":
            limit = start + rng.randint(1, 200)
            limit = None if limit + 2 * junk + 64 >= len(content) else limit
            more, _, state = walk_from(content, junk, state, limit)
            found += more.tolist()
            start = limit
        assert found == at.tolist() and state[1:] == (stop, why), content


def some_file(rng, n):
    """Mostly frames without gaps, whose values may look like markers, with junk, stray line ends and footers."""
    out = [HEADER] if rng.random() < 0.7 else []
    for k in range(n):
        x = rng.random()
        out.append(imu(k, k % 65536) if x < 0.6 else gnss(k) if x < 0.75 else pps(k) if x < 0.9 else rng.choice(PIECES) if x < 0.97 else b"q" * rng.randint(1, 60) + b"\n" * rng.randint(0, 1))
    return b"".join([*out, *([FOOTER] if rng.random() < 0.7 else [b"\nIMU"])])


def rows_of(df):
    return sorted(map(str, df.select("file_id", "kind", "offset", "micros_reading", "counter", "latitude", "file_bytes", "parsed_bytes", "footer_found", "status").collect()))


@pytest.mark.parametrize("reach", [40, 400])
def test_ranges_equal_whole_files(spark, reach):
    rng = random.Random(reach)
    junk = 32
    files = [(f"f{k}", bytearray(some_file(rng, rng.choice([0, 3, 60, 200])))) for k in range(40)]
    files += [(name, bytearray(content)) for name, (content, _, _) in CASES.items()] + [("null", None), ("clash", bytearray(b"\nIMU" * 900)), (None, bytearray(imu(1) * 60))]
    table = spark.createDataFrame(files, "file_id string, content binary").repartition(4)
    want = rows_of(decode_frames(table, junk=junk))
    for size in (beyond(junk, reach), beyond(junk, reach) + 17, 1500):
        assert rows_of(decode_ranges(cut_ranges(table, size, junk, reach), junk, reach)) == want


def test_every_cut_of_the_cases_gives_the_same_frames(spark):
    junk, reach = 16, 30
    content = HEADER + b"".join(imu(k) for k in range(9)) + b"junk" + gnss(3) + b"J\n" + b"J" * 70 + imu(4) + pps(0x0A0A0A0A) + FOOTER
    table = spark.createDataFrame([(1, bytearray(content))], "file_id int, content binary")
    want = rows_of(decode_frames(table, junk=junk))
    parts = [(size, r) for size in range(beyond(junk, reach), 420, 7) for r in [size]]
    cut = None
    for size, _ in parts:
        own = cut_ranges(table.select(F.lit(size).alias("file_id"), "content"), size, junk, reach)
        cut = own if cut is None else cut.union(own)
    got = {}
    for r in decode_ranges(cut, junk, reach).collect():
        got.setdefault(r.file_id, []).append((r.kind, r.offset, r.micros_reading, r.status))
    one = sorted(map(str, ((r.kind, r.offset, r.micros_reading, r.status) for r in decode_frames(table, junk=junk).collect())))
    assert len(want) == 13 and len(got) == len(parts) and all(sorted(map(str, v)) == one for v in got.values())


def test_readers_that_do_not_meet_are_told(spark):
    """Markers in payloads keep a guess out of step for as long as one likes."""
    trap = b"\nIMU" + b"\0" * 8 + b"\nIMU" + b"\0" * 8
    content = imu(1) + b"\nIMU" + b"\0" * 8 + trap * 60
    at, _, state = walk_from(content, 32, ("scan", 0), 600)
    assert border(content, 600, state, 32, 40)[2] is None or len(np.intersect1d(at, [600])) == 0
    table = spark.createDataFrame([(1, bytearray(content))], "file_id int, content binary")
    for size in range(232, 260):
        assert rows_of(decode_ranges(cut_ranges(table, size, 32, 40), 32, 40)) == rows_of(decode_frames(table, junk=32))


def test_a_large_file_is_decoded_by_many_tasks(spark, monkeypatch):
    kept = {}

    def stored(df, name, store=ranges.store):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(ranges, "store", stored)
    content = HEADER + b"".join(imu(k, k % 65536) for k in range(40_000)) + FOOTER
    table = spark.createDataFrame([(1, bytearray(content))], "file_id int, content binary")
    out = decode_ranges(cut_ranges(table, 60_000, 256, 4096).repartition(12), 256, 4096)
    assert tuple(out.where("kind = 'IMU'").agg(F.count_distinct("micros_reading"), F.count(F.lit(1))).first()) == (40_000, 40_000)
    tasks = kept["ranges"].where("kind = 'IMU'").groupBy(F.input_file_name()).count().collect()
    assert len(tasks) >= 8 and max(r["count"] for r in tasks) < 12_000
    assert kept["range-drops"].count() <= 2  # most ranges hold from their first frame on
