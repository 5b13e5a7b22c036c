"""Raw files for tests, and a byte-by-byte model of how they are read."""

import struct

HEADER = b"Log start OLA ISM330DHCX SAM-M10Q logger\n\nFirmware commit ID: abc123\nISM330DHCX Acc sensitivity (mg/LSB): 0.061000\nISM330DHCX Gyr sensitivity (mdps/LSB): 4.375000\nISM330DHCX ODR (Hz): 417.00\nGNSS update rate (Hz): 10\n"
FOOTER = b"\n\nLog stop OLA ISM330DHCX SAM-M10Q logger\n"


def pps(micros):
    return b"\nPPS" + struct.pack("<I", micros)


def gnss(micros, lat=1, lon=2, posix=1_705_000_000, us=0, n=0, e=0, d=0, fix=3):
    return b"\nGPS" + struct.pack("<IiiiIiiiB3x", micros, lat, lon, posix, us, n, e, d, fix)


def imu(micros, counter=0, acc=(1, 2, 3), gyr=(4, 5, 6)):
    return b"\nIMU" + struct.pack("<IH6h2x", micros, counter, *acc, *gyr)


def model(content, junk):
    """One step of one byte at a time."""
    sizes = {b"\nPPS": 8, b"\nGPS": 40, b"\nIMU": 24}
    footer, n, at, frames = b"Log stop OLA", len(content), 0, []
    while at < n:
        size = sizes.get(content[at : at + 4])
        if size is None:
            if footer in content[at : at + 22]:
                return frames, at, "footer"
            at += 1
            continue
        if at + size > n:
            return frames, at, "truncated"
        frames.append(at)
        at += size
        skipped = 0
        while at < n and content[at : at + 1] != b"\n" and footer not in content[at : at + 20]:
            at += 1
            skipped += 1
            if skipped == junk:
                spots = [content.find(m, at, at + junk) for m in (*sizes, footer)]
                spots = [s for s in spots if s >= 0]
                if not spots:
                    return frames, at, "corrupt"
                at = min(spots)
                break
    return frames, n, "end"
