import random

import pytest
from frames_model import FOOTER, HEADER, gnss, imu, model, pps
from pyspark.sql import functions as F
from sensorlake.sources import audit, decode_frames, parse_file_name, parse_header, read_log_files
from sensorlake.sources.frames import walk

PIECES = [pps(1), pps(0x0A0A0A0A), imu(3), gnss(2), imu(0x50500A0A), b"\nIMU" + b"\nPPS" * 5, b"\n", b"x", b"xyz", b"junk junk junk", b"Log stop OLA", b"\nPP", b"\nGPS", b"\0" * 20, b"q" * 40]


@pytest.mark.parametrize("junk", [16, 24, 40])
def test_walk_equals_the_bytewise_model(junk):
    rng = random.Random(junk)
    for _ in range(6000):
        content = b"".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        content = content[: rng.randint(0, len(content))] if rng.random() < 0.3 else content
        at, _, stop, why = walk(content, junk)
        frames, end, reason = model(content, junk)
        assert (at.tolist(), why) == (frames, reason), content
        if why != "end":
            assert stop == end, content


CASES = {
    "one of each": (HEADER + pps(1000) + gnss(2000, 12345678, -87654321) + imu(3000) + FOOTER, (1, 1, 1), "complete"),
    "padding": (HEADER + b"".join(imu(1_000_000 + 5000 * i, 100 + i) for i in range(5)) + FOOTER, (0, 0, 5), "complete"),
    "junk gap": (HEADER + imu(1) + imu(2) + b"this is some junk !!" + imu(3) + imu(4) + FOOTER, (0, 0, 4), "complete"),
    "truncated": (HEADER + imu(1) + imu(2) + imu(3)[:10], (0, 0, 2), "truncated"),
    "no recovery": (HEADER + imu(1) + b"X" * 3000, (0, 0, 1), "corrupt"),
    "mixed": (HEADER + pps(1) + gnss(2) + imu(3) + b"junkjunk" + pps(4) + imu(5) + FOOTER, (2, 1, 2), "complete"),
    "larger junk": (HEADER + b"".join(map(imu, range(10))) + b"J" * 350 + b"".join(map(imu, range(10, 20))) + FOOTER, (0, 0, 20), "complete"),
    "stray line end": (HEADER + imu(1) + b"J\n" + b"J" * 3000 + imu(2) + FOOTER, (0, 0, 2), "complete"),
    "payload markers": (HEADER + b"\nIMU" + b"\nIMU" * 5 + imu(9) + FOOTER, (0, 0, 2), "complete"),
    "no footer": (HEADER + imu(1) + imu(2), (0, 0, 2), "missing footer"),
    "empty": (b"", (0, 0, 0), "missing footer"),
}


def test_cases(spark):
    files = spark.createDataFrame([(k, bytearray(v[0])) for k, v in CASES.items()], "file_id string, content binary")
    got = {r.file_id: r for r in audit(decode_frames(files)).collect()}
    for name, (content, counts, status) in CASES.items():
        r = got[name]
        assert (r.n_pps, r.n_gnss, r.n_imu, r.status, r.file_bytes) == (*counts, status, len(content)), name


def test_values(spark):
    content = pps(12345) + gnss(10_000, 123456789, -987654321, 1_705_000_000, 500_000, 100, -50, 25, 3) + imu(5000, 42, (100, -200, 300), (1000, -2000, 3000))
    rows = {r.kind: r for r in decode_frames(spark.createDataFrame([(7, bytearray(content))], "file_id long, content binary")).collect()}
    assert rows["PPS"].micros_reading == 12345 and rows["PPS"].latitude is None
    g, i = rows["GNSS"], rows["IMU"]
    assert (g.latitude, g.longitude, g.posix_timestamp, g.microseconds, g.ned_vel_north, g.ned_vel_east, g.ned_vel_down, g.fix_type) == (123456789, -987654321, 1_705_000_000, 500_000, 100, -50, 25, 3)
    assert (i.micros_reading, i.counter, i.acc_x, i.acc_y, i.acc_z, i.gyr_x, i.gyr_y, i.gyr_z) == (5000, 42, 100, -200, 300, 1000, -2000, 3000)


def test_files_names_and_headers(spark, tmp_path):
    folder = tmp_path / "BOOT_000093"
    folder.mkdir()
    (folder / "DATA_BOOT_000093_TIME_20260208T141501.dat").write_bytes(HEADER + pps(1) + FOOTER)
    (tmp_path / "DATA_BOOT_0003_TIME_20260205T151500.dat").write_bytes(b"GNSS update rate (Hz): 5: no\nISM330DHCX ODR (Hz): 1\nISM330DHCX ODR (Hz): 2\nISM330DHCX Acc sensitivity: much\n\xff\xfeend" + imu(1))
    (tmp_path / "OTHER.txt").write_bytes(b"no")
    rows = {r.boot_id: r for r in parse_header(parse_file_name(read_log_files(spark, f"file://{tmp_path}"))).withColumn("file_start", F.col("file_start").cast("string")).collect()}
    assert sorted(rows) == [3, 93]
    a, b = rows[93], rows[3]
    assert (a.file_start, a.acc_sensitivity, a.gyr_sensitivity, a.imu_odr, a.gnss_rate, a.firmware_commit) == ("2026-02-08 14:15:01", 0.061, 4.375, 417.0, 10.0, "abc123")
    assert a.header_text.encode() == HEADER
    assert (b.gnss_rate, b.imu_odr, b.acc_sensitivity, b.firmware_commit) == (None, 2.0, None, None)
    assert b.header_text.endswith("end")
