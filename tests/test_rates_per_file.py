"""Files of different IMU rates in one lake."""

from frames_model import FOOTER, HEADER, imu
from sensorlake.plans import Settings, decode_and_synchronise
from sensorlake.sources import read_log_files

ODR = b"ISM330DHCX ODR (Hz): "


def test_each_file_has_segments_of_its_own_rate(spark, tmp_path):
    frames = b"".join(imu(1000 * k, k, (1, 2, 3), (4, 5, 6)) for k in range(300))
    assert ODR + b"417.00" in HEADER
    heads = {1: HEADER.replace(ODR + b"417.00", ODR + b"1.00"), 2: HEADER.replace(ODR + b"417.00", ODR + b"2.50"), 3: HEADER.replace(ODR + b"417.00", b"nothing"), 4: HEADER.replace(ODR + b"417.00", ODR + b"0.00")}
    for boot, head in heads.items():
        (tmp_path / f"DATA_BOOT_{boot:06d}_TIME_20260208T140000.dat").write_bytes(head + frames + FOOTER)
    tables = decode_and_synchronise(read_log_files(spark, f"file://{tmp_path}"), Settings())
    boots = tables["files"].select("file_id", "boot_id", "imu_odr")
    assert sorted(boots.select("boot_id", "imu_odr").collect()) == [(1, 1.0), (2, 2.5), (3, None), (4, 0.0)]
    found = tables["segments"].join(boots, "file_id").select("boot_id", "segment", "n_imu").collect()
    assert sorted(found) == [*[(1, k, 60) for k in range(5)], (2, 0, 150), (2, 1, 150), (3, 0, 300), (4, 0, 300)]
