"""Raw files by ranges and heads, chosen by name; and ingest to finished tables."""

import os
import time

import pytest
from pyspark.sql import functions as F
from sensorlake.plans import Settings, decode, decode_log_files, synchronise_files
from sensorlake.sources import read_log_files
from sensorlake.sources.datasource import LogFiles, Reader, register
from sensorlake.streaming import finished, ingest_tables
from test_ranges import rows_of
from test_runs import recording

SMALL = {"size": "2000", "junk": "64", "reach": "512"}
OWN = Settings(rows_per_segment=400, block=5000)


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "deep").mkdir()
    for boot, start, content in ((7, "20260208T140000", recording(20)), (8, "20260208T141500", recording(10, 5_000_000)), (9, "20260209T000000", b"")):
        (folder / "deep" / f"DATA_BOOT_{boot:06d}_TIME_{start}.dat").write_bytes(content)
    (folder / "OTHER.txt").write_bytes(b"no")
    (folder / "DATA_ODD.dat").write_bytes(recording(3))
    old = time.time() - 3600
    for path in folder.rglob("*.dat"):
        os.utime(path, (old, old))
    return f"file://{folder}"


def test_a_filter_on_names_opens_only_those_files(spark, lake):
    register(spark)
    read = lambda what: spark.read.format("sensor_log_files").options(what=what, **SMALL).load(lake)
    assert read("heads").count() == 4 and read("heads").where("boot_id = 8").count() == 1
    whole, one = read("ranges"), read("ranges").where("boot_id = 8")
    own = one.agg(F.sum("own"), F.max("length")).first()
    assert own[0] == own[1] and {r.boot_id for r in one.select("boot_id").distinct().collect()} == {8}
    # ranges are tasks of their own here: others than those of the file asked for aren't even planned
    assert one.rdd.getNumPartitions() == -(-own[1] // 2000) < whole.rdd.getNumPartitions()
    assert read("ranges").where("file_start >= timestamp_ntz'2026-02-09 00:00:00'").rdd.getNumPartitions() == 1
    assert read("ranges").where("boot_id = 77").count() == 0


def test_opened_files_are_counted(lake, monkeypatch):
    from pyspark.sql import datasource as api
    from sensorlake.sources import datasource

    opened = []
    plain = datasource.filesystem

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def open_input_file(self, at):
            opened.append(os.path.basename(at))
            return self.fs.open_input_file(at)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(datasource, "filesystem", lambda path: (Counting(plain(path)[0]), plain(path)[1]))
    for what, most in (("heads", 65536), ("ranges", 10**9)):
        reader = Reader({"path": lake, "what": what, **SMALL})
        left = list(reader.pushFilters([api.EqualTo(("boot_id",), 7), api.IsNotNull(("boot_id",)), api.GreaterThan(("length",), 3)]))
        assert [type(f).__name__ for f in left] == ["IsNotNull", "GreaterThan"]
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        assert all(len(c) <= most for b in batches for c in b.column("content").to_pylist())
    assert set(opened) == {"DATA_BOOT_000007_TIME_20260208T140000.dat"}
    assert LogFiles.name() == "sensor_log_files"


def test_ranges_of_files_give_what_whole_files_give(spark, lake):
    files, frames = decode_log_files(spark, path=lake, **SMALL)
    whole, want = decode(read_log_files(spark, lake))
    # the same but for ids, which hash the paths as they are written
    ids = dict(files.select("file_id", "boot_id").collect())
    other = dict(whole.select("file_id", "boot_id").collect())
    plain = lambda df, of: sorted(s.replace(str(k), f"boot {v}") for s in rows_of(df) for k, v in of.items() if f"file_id={k}," in s)
    # Spark passes over files without a byte; here they have their row
    assert plain(frames, {k: v for k, v in ids.items() if v != 9}) == plain(want, other)
    assert len(plain(frames, {k: v for k, v in ids.items() if v == 9})) == 1
    told = ["boot_id", "imu_odr", "acc_sensitivity", "header_text", "file_bytes", "parsed_bytes", "status", "n_imu"]
    assert sorted(map(str, files.where("boot_id is null or boot_id <> 9").select(*told).collect())) == sorted(map(str, whole.select(*told).collect()))
    assert decode_log_files(spark, F.col("boot_id") == 8, path=lake, **SMALL)[0].select("boot_id").collect() == [(8,)]


def ingest(spark, lake, folder, **more):
    q = ingest_tables(spark, lake, str(folder / "tables"), str(folder / "cp"), OWN, files_per_trigger=2, **SMALL, **more)
    q.awaitTermination()


def counts(spark, folder):
    found = {}
    for name in ("files", "segments", "pps", "gnss", "imu"):
        table = finished(spark, str(folder / "tables"), name)
        found[name] = None if table is None else sorted(map(str, table.drop("batch_id").select(*[c for c in ("file_id", "segment", "kind", "offset", "acc_x_stdchecked", "n_imu", "utc_timestamp_from_pps_regression") if c in table.columns]).collect()))
    return found


def test_ingest_survives_a_crash_between_sink_and_commit(spark, lake, tmp_path, monkeypatch):
    from sensorlake.streaming import ingest as module

    ingest(spark, lake, tmp_path / "plain")
    want = counts(spark, tmp_path / "plain")
    out = synchronise_files(*decode_log_files(spark, path=lake, **SMALL), OWN)
    assert len(want["imu"]) == out["imu"].where("segment_out is not null").count() > 0 and len(want["files"]) == 3  # not the empty one

    class Crash(Exception):
        pass

    calls = []

    def crashing(*args, **more):
        tables = synchronise_files(*args, **more)
        calls.append(1)
        if len(calls) == 2:  # the second batch dies when it has written some of its tables
            tables = {k: tables[k] for k in ("files", "segments", "pps")}
        return tables

    monkeypatch.setattr(module, "synchronise_files", crashing)
    with pytest.raises(Exception, match="gnss"):
        ingest(spark, lake, tmp_path / "crashed")
    half = counts(spark, tmp_path / "crashed")
    assert 0 < len(half["files"]) < 3 and set(half["pps"]) < set(want["pps"])
    monkeypatch.setattr(module, "synchronise_files", synchronise_files)
    ingest(spark, lake, tmp_path / "crashed")
    assert counts(spark, tmp_path / "crashed") == want
    ingest(spark, lake, tmp_path / "crashed")  # nothing new
    assert counts(spark, tmp_path / "crashed") == want


def test_files_that_still_grow_wait_for_the_next_batch(spark, tmp_path):
    lake = tmp_path / "lake"
    lake.mkdir()
    old = time.time() - 3600
    for boot, age in ((1, old), (2, time.time() + 5)):
        path = lake / f"DATA_BOOT_{boot:06d}_TIME_20260208T140000.dat"
        path.write_bytes(recording(5))
        os.utime(path, (age, age))
    ingest(spark, f"file://{lake}", tmp_path)
    assert len(counts(spark, tmp_path)["files"]) == 1
    os.utime(lake / "DATA_BOOT_000002_TIME_20260208T140000.dat", (old, old))
    path = lake / "DATA_BOOT_000003_TIME_20260208T140000.dat"
    path.write_bytes(recording(5))
    os.utime(path, (old, old))
    ingest(spark, f"file://{lake}", tmp_path)
    boots = sorted(r.boot_id for r in finished(spark, str(tmp_path / "tables"), "files").collect())
    assert boots == [1, 2, 3]
