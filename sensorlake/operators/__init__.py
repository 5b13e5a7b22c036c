"""Operators over decoded records. Records carry file_id, offset (their order in the file), kind (PPS, GNSS or IMU) and
the kind's own columns; windows are over a file or a segment of it, so a record's shuffle key is always its file."""
