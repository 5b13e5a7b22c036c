"""Raw log files: finding them, what their names say, and their text headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"DATA_BOOT_(\d+)_TIME_(\d{8}T\d{6})\.dat"
#: Fixed values of the file format: frames' markers, and how far a header may reach.
MARKERS = {"PPS": b"\nPPS", "GNSS": b"\nGPS", "IMU": b"\nIMU"}
HEADER_BYTES = 64 * 1024
#: Fixed values of the file format: what a header line holds, and the column that it fills.
HEADER_KEYS = {
    "acc_sensitivity": "ISM330DHCX Acc sensitivity",
    "gyr_sensitivity": "ISM330DHCX Gyr sensitivity",
    "imu_odr": "ISM330DHCX ODR",
    "gnss_rate": "GNSS update rate",
    "firmware_commit": "Firmware commit ID",
}


def read_log_files(spark: SparkSession, path: str, glob: str = "DATA_*.dat") -> DataFrame:
    """path, modificationTime, length, content of the raw files below ``path``, at any depth, one row each."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def parse_file_name(files: DataFrame) -> DataFrame:
    """boot_id and file_start (UTC) out of ``path``; null where the name is another."""
    name = lambda k: F.nullif(F.regexp_extract("path", NAME, k), F.lit(""))
    start = F.to_timestamp_ntz(name(2), F.lit("yyyyMMdd'T'HHmmss"))
    return files.withColumns({"boot_id": name(1).cast("int"), "file_start": start})


def _position(content: Column, marker: bytes) -> Column:
    """Bytes before the marker in the header's reach; null without one. The bytes are read as Latin-1, one character
    each, so that places in the text are places in the file."""
    at = F.instr(F.decode(content, "ISO-8859-1"), marker.decode())
    return F.when(at > 0, at - 1)


def parse_header(files: DataFrame) -> DataFrame:
    """header_text, the sensitivities and rates, and the firmware commit of each file.

    The header ends at the first marker within 64 KiB. A line tells a value if it holds the key and exactly one colon;
    of several such lines the last counts. Bytes that aren't UTF-8 are dropped; what isn't a number is null."""
    head = F.substring("content", 1, HEADER_BYTES)
    end = F.least(*[_position(head, m) for m in MARKERS.values()])
    raw = F.substring(head, F.lit(1), F.coalesce(end, F.length(head)))
    text = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))
    x = files.withColumn("header_text", text).withColumn("__lines", F.split("header_text", "\r\n|\n|\r"))

    def told(name: str) -> Column:
        # a line counts for the first key that it holds
        earlier = list(HEADER_KEYS.values())[: list(HEADER_KEYS).index(name)]

        def fits(line: Column) -> Column:
            own = line.contains(HEADER_KEYS[name]) & (F.size(F.split(line, ":")) == 2)
            for key in earlier:
                own = own & ~line.contains(key)
            return own

        value = F.trim(F.element_at(F.split(F.try_element_at(F.filter("__lines", fits), F.lit(-1)), ":"), 2))
        return value if name == "firmware_commit" else value.try_cast("double")

    return x.withColumns({name: told(name) for name in HEADER_KEYS}).drop("__lines")
