"""Whole runs: decode and synchronise, analyse, report."""

from .synchronise import Settings, clock_fits, decode, decode_and_synchronise, decode_log_files, segmented, synchronise, synchronise_files, with_steps

__all__ = ["Settings", "clock_fits", "decode", "decode_and_synchronise", "decode_log_files", "segmented", "synchronise", "synchronise_files", "with_steps"]
