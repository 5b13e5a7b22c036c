"""Live jobs: ingest of new files, rates and alarms."""

from .ingest import finished, ingest_tables
from .live import frequency_alarm, ingest_stream, live_rates, on_time, plausible, rows_too_late, saturation_alarm, stray_rows, streamed_alarm, streamed_saturation, windowed_rates, with_silence

__all__ = ["finished", "frequency_alarm", "ingest_stream", "ingest_tables", "live_rates", "on_time", "plausible", "rows_too_late", "saturation_alarm", "stray_rows", "streamed_alarm", "streamed_saturation", "windowed_rates", "with_silence"]
