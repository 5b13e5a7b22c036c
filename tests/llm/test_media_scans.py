"""JPEG files with long heads, and with a scan for each component."""

import random

import numpy as np
import pytest
from sensorlake.llm import media
from test_media import Bits, photo


def test_long_heads():
    rng = random.Random(2)
    jpeg, want = photo(rng, 50, 33, (2, 1), 3)
    extra = media.segment(0xE1, b"\xff\xda\xff\xd9" + bytes(65_500)) * 12
    plain = media.encode([b"x" * 128])[0]
    long = jpeg[:2] + extra + jpeg[2:]
    found = media.thumbnails([plain, long, plain, plain + long[:400_000], long + jpeg])
    assert (found[1][0] == want).all() and found[3] is None
    assert found[0][0].tobytes() == found[2][0].tobytes() == b"x" * 128 and [i.shape for i in found[4]] == [want.shape] * 2


def scans_apart(rng, width, height, sampling, order, restart):
    """A file with a scan for each group of components in ``order``, and the luminance levels."""
    dc_lengths = {k: 4 for k in range(12)}
    dc, (end, end_bits) = media.canonical(list(dc_lengths.items())), media.canonical([(0, 1)])[0]
    parts = {1: sampling, 2: (1, 1), 3: (1, 1)}
    hm, vm = sampling
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    levels = {c: np.array([[rng.randint(-60, 60) for _ in range(across * h)] for _ in range(down * v)]) for c, (h, v) in parts.items()}
    out = b"\xff\xd8" + media.segment(0xDB, bytes([0, 16] + [1] * 63))
    out += media.segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\3" + b"".join(bytes([c, h << 4 | v, 0]) for c, (h, v) in parts.items()))
    out += media.segment(0xDD, restart.to_bytes(2, "big"))
    for scan in order:
        out += media.huffman_segment(0, dc_lengths) + media.huffman_segment(1, {0: 1})
        out += media.segment(0xDA, bytes([len(scan)]) + b"".join(bytes([c, 0]) for c in scan) + b"\0\x3f\0")
        if len(scan) > 1:
            units = [[(c, y * v + b // h, x * h + b % h) for c in scan for h, v in [parts[c]] for b in range(h * v)] for y in range(down) for x in range(across)]
        else:
            h, v = parts[scan[0]]
            units = [[(scan[0], y, x)] for y in range(-(-height * v // (8 * vm))) for x in range(-(-width * h // (8 * hm)))]
        bits, last = Bits(), dict.fromkeys(scan, 0)
        for k, unit in enumerate(units):
            if restart and k and k % restart == 0:
                out += bits.bytes() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
                bits, last = Bits(), dict.fromkeys(scan, 0)
            for c, y, x in unit:
                d = int(levels[c][y, x]) - last[c]
                n = abs(d).bit_length()
                bits.put(*dc[n])
                bits.put(d if d >= 0 else d + (1 << n) - 1, n)
                bits.put(end, end_bits)
                last[c] += d
        out += bits.bytes()
    want = np.clip(np.floor(levels[1] * 16 / 8 + 128.5), 0, 255)
    return out + b"\xff\xd9", want[: -(-height * sampling[1] // (8 * vm)), : -(-width * sampling[0] // (8 * hm))]


@pytest.mark.parametrize("order", [[(1,), (2,), (3,)], [(2,), (1,), (3,)], [(1,), (2, 3)], [(2, 3), (1,)], [(3,), (1, 2)], [(1, 2, 3)]])
@pytest.mark.parametrize("width, height, sampling, restart", [(64, 64, (1, 1), 0), (50, 33, (2, 2), 0), (17, 90, (2, 1), 3)])
def test_scan_per_component(order, width, height, sampling, restart):
    jpeg, want = scans_apart(random.Random(5), width, height, sampling, order, restart)
    images = media.thumbnails([jpeg])[0]
    assert len(images) == 1 and images[0].shape == want.shape and (images[0] == want).all()


def test_missing_scans():
    for order in ([(1,), (2,)], [(2,), (3,)], [(1,), (1,), (2,), (3,)]):
        assert media.thumbnails([scans_apart(random.Random(6), 40, 24, (2, 2), order, 0)[0]]) == [None]
