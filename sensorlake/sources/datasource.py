"""Raw log files as a Spark data source of byte ranges, or of heads only.

``spark.read.format("sensor_log_files").load(folder)`` gives the ranges that ``decode_ranges`` reads: a file may have any
length, each range is read where it is decoded, and no byte twice but for what readers see beyond a range. With
``option("what", "heads")`` it gives one row per file with its first 64 KiB, and nothing else is read.

What is asked of boot_id and file_start is answered from the names, so other files are never opened. (Filters reach the
source if ``spark.sql.python.filterPushdown.enabled`` is true.) Folders are listed on the driver: names, not contents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.types import StructType

from .frames import JUNK
from .log_files import HEADER_BYTES, NAME
from .ranges import LEAD, REACH, SIZE, beyond

FORMAT = "sensor_log_files"
OF_NAME = "path string, boot_id int, file_start timestamp_ntz, length bigint"
SCHEMAS = {"ranges": f"{OF_NAME}, base bigint, lead int, own int, content binary", "heads": f"{OF_NAME}, content binary"}
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "timestamp_ntz": pa.timestamp("us"), "binary": pa.binary()}
#: Bytes of small files that one task reads.
TASK = SIZE


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def named(path: str) -> tuple[int | None, datetime | None]:
    """boot_id and file_start out of a file's name; null where the name is another, as for ``parse_file_name``."""
    m = re.search(NAME, path)
    if not m:
        return None, None
    boot = int(m[1]) if int(m[1]) < 2**31 else None
    try:
        return boot, datetime.strptime(m[2], "%Y%m%dT%H%M%S")
    except ValueError:
        return boot, None


_COMPARED = {
    api.EqualTo: lambda x, v: x == v,
    api.GreaterThan: lambda x, v: x > v,
    api.GreaterThanOrEqual: lambda x, v: x >= v,
    api.LessThan: lambda x, v: x < v,
    api.LessThanOrEqual: lambda x, v: x <= v,
    api.In: lambda x, v: x in v,
}


@dataclass
class Piece(api.InputPartition):
    """(path, boot_id, file_start, length, base) of ranges that one task reads."""

    ranges: list[tuple]


class Reader(api.DataSourceReader):
    def __init__(self, options: dict):
        self.what = options.get("what", "ranges")
        self.size, self.junk, self.reach = int(options.get("size", SIZE)), int(options.get("junk", JUNK)), int(options.get("reach", REACH))
        if self.what == "ranges" and self.size < beyond(self.junk, self.reach):
            raise ValueError(f"ranges must have {beyond(self.junk, self.reach)} bytes or more")
        self.paths = json.loads(options["paths"]) if "paths" in options else None
        self.folder = options.get("path")
        self.tests: list = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("boot_id", "file_start") and type(f) in _COMPARED:
                self.tests.append((column, _COMPARED[type(f)], f.value))
            else:
                yield f

    def _files(self) -> list[tuple[str, int]]:
        if self.paths is not None:
            out = []
            for path in self.paths:
                fs, at = filesystem(path)
                out.append((path, fs.get_file_info(at).size))
            return out
        fs, at = filesystem(self.folder)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        prefix = self.folder[: len(self.folder) - len(at)] if self.folder.endswith(at) else ""
        return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and re.fullmatch(r"DATA_.*\.dat", f.base_name))

    def chosen(self) -> list[tuple]:
        """(path, boot_id, file_start, length) of the files that the filters leave."""
        out = []
        for path, length in self._files():
            own = dict(zip(("boot_id", "file_start"), named(path), strict=True))
            if all(own[column] is not None and test(own[column], value) for column, test, value in self.tests):
                out.append((path, *own.values(), length))
        return out

    def partitions(self) -> list[Piece]:
        tasks, held = [[]], 0
        for *file, length in self.chosen():
            step = self.size if self.what == "ranges" else max(1, length)
            for base in range(0, max(1, length), step):
                cost = min(step, length - base) if self.what == "ranges" else min(HEADER_BYTES, length)
                if tasks[-1] and held + cost > min(self.size, TASK):
                    tasks.append([])
                    held = 0
                tasks[-1].append((*file, length, base))
                held += cost
        return [Piece(t) for t in tasks if t] or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, ARROW[kind]) for name, kind in (c.split(" ") for c in SCHEMAS[self.what].split(", "))])
        for path, boot, start, length, base in partition.ranges:
            fs, at = filesystem(path)
            lead = min(base, LEAD)
            more = HEADER_BYTES if self.what == "heads" else lead + self.size + beyond(self.junk, self.reach)
            with fs.open_input_file(at) as file:
                content = file.read_at(max(0, min(more, length - base + lead)), base - lead)
            row = {"path": path, "boot_id": boot, "file_start": start, "length": length, "content": content}
            if self.what == "ranges":
                row |= {"base": base, "lead": lead, "own": min(self.size, length - base)}
            yield pa.RecordBatch.from_pylist([row], schema)


class LogFiles(api.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "ranges")]

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``sensor_log_files`` known to the session, and let filters reach it."""
    spark.dataSource.register(LogFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
