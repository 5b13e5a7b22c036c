"""Reading raw log files and decoded tables."""

from .datasource import register
from .frames import audit, decode_frames, of_kind
from .log_files import parse_file_name, parse_header, read_log_files
from .ranges import cut_ranges, decode_ranges
from .tables import combine_segments, read_tables, write_tables

__all__ = ["audit", "combine_segments", "cut_ranges", "decode_frames", "decode_ranges", "of_kind", "parse_file_name", "parse_header", "read_log_files", "read_tables", "register", "write_tables"]
