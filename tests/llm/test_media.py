import hashlib
import random
import zlib

import numpy as np
from sensorlake.llm import media


def test_round_trip_of_payloads():
    rng = random.Random(4)
    payloads = [bytes(rng.randrange(256) for _ in range(64 * rng.randint(1, 30))) for _ in range(60)]
    payloads += [b"\0" * 64, b"\xff" * 128, bytes([0, 255] * 320), b"ab" * 32 * 9000]
    files = media.encode(payloads)
    for p, images in zip(payloads, media.thumbnails(files)):
        assert b"".join(i.tobytes() for i in images) == p
    assert media.encode([payloads[3]])[0] == files[3]


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\0")


def photo(rng, width, height, sampling, restart):
    """A baseline JPEG with random AC values; returns its bytes and the luminance levels, coded one block at a time."""
    dc_lengths = {k: 4 for k in range(12)}
    ac_symbols = [0x00, 0xF0] + [r << 4 | s for r in (0, 3, 9) for s in (1, 4, 8)]
    ac_lengths = {s: 5 for s in ac_symbols}
    dc, ac = media.canonical(list(dc_lengths.items())), media.canonical(list(ac_lengths.items()))
    parts = [(1, *sampling)] + [(k, 1, 1) for k in (2, 3)] * (sampling != (0, 0))
    if sampling == (0, 0):
        parts = [(1, 1, 1)]
    h, v = parts[0][1:]
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    want = np.zeros((down * v, across * h), int)
    segments, bits, level = [], Bits(), [0, 0, 0]

    def value(x, n):
        bits.put(x if x >= 0 else x + (1 << n) - 1, n)

    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            segments.append(bits.bytes())
            bits, level = Bits(), [0, 0, 0]
        for p, (_, ph, pv) in enumerate(parts):
            for b in range(ph * pv):
                new = rng.randint(-60, 60)
                n = abs(new - level[p]).bit_length()
                bits.put(*dc[n])
                value(new - level[p], n)
                level[p] = new
                k = 1
                while k < 64 and rng.random() < 0.8:
                    s = rng.choice(ac_symbols[1:])
                    if k + (s >> 4) + 1 > 64:
                        break
                    bits.put(*ac[s])
                    value(rng.choice([-1, 1]) * (1 << (s & 15) - 1), s & 15) if s & 15 else None
                    k += (s >> 4) + 1
                if k < 64:
                    bits.put(*ac[0])
                if p == 0:
                    want[mcu // across * v + b // h, mcu % across * h + b % h] = new
    segments.append(bits.bytes())
    scan = segments[0] + b"".join(b"\xff" + bytes([0xD0 + k % 8]) + s for k, s in enumerate(segments[1:]))
    sof = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i, a << 4 | b, 0]) for i, a, b in parts)
    sos = bytes([len(parts)]) + b"".join(bytes([i, 0]) for i, _, _ in parts) + b"\0\x3f\0"
    head = b"\xff\xd8" + media.segment(0xDB, bytes([0, 16] + [1] * 63)) + media.segment(0xC0, sof) + media.huffman_segment(0, dc_lengths) + media.huffman_segment(1, ac_lengths)
    head += media.segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    levels = np.clip(np.floor(want * 16 / 8 + 128.5), 0, 255)
    return head + media.segment(0xDA, sos) + scan + b"\xff\xd9", levels[: -(-height // 8), : -(-width // 8)]


def test_photos_with_ac_values_and_subsampling():
    rng = random.Random(8)
    made = [photo(rng, w, h, s, r) for w, h, s, r in [(40, 24, (0, 0), 0), (64, 64, (2, 2), 0), (50, 33, (2, 1), 3), (17, 90, (1, 1), 5), (8, 8, (0, 0), 0), (100, 20, (2, 2), 1)]]
    for (_, want), images in zip(made, media.thumbnails([f for f, _ in made])):
        assert len(images) == 1 and (images[0] == want).all()


def test_broken_files_are_told_apart(spark):
    good = media.encode([b"x" * 128])[0]
    rng = random.Random(1)
    bad = [b"", b"\xff\xd8", good[:-2], good[:100], good.replace(b"\xff\xc0", b"\xff\xc2"), b"no jpeg at all" * 9, good[:-9] + b"\xff\xd9"]
    bad += [bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in photo(rng, 64, 64, (2, 2), 2)[0]) for _ in range(30)]
    assert media.thumbnails(bad)[:6] == [None] * 6
    rows = [(k, bytearray(b), "x") for k, b in enumerate([good, *bad[:6], good])] + [(99, None, "x")]
    out = {r.id: r for r in media.media_features(spark.createDataFrame(rows, "id int, media binary, width string").drop("width"), ["id"]).collect()}
    assert len(out) == 9 and out[0].thumbnail_sha256 == out[7].thumbnail_sha256 == hashlib.sha256(b"x" * 128).hexdigest()
    assert out[99].media_bytes is None and out[1].media_bytes == 0 and out[3].width is None


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode([payload])[0]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_cases(spark):
    rows = [(1, None), (2, ""), (None, "é" * 40), (3, "y" * 700_000), (3, "y" * 700_000)]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, media string")
    out = media.media_features(media.store_text(docs), ["doc_id", "n_bytes"]).collect()
    assert [(r.n_bytes, r.thumbnail_bytes, r.images) for r in out] == [(0, 64, 1), (0, 64, 1), (80, 128, 1), (700_000, 700_032, 2), (700_000, 700_032, 2)]
    assert out[3].feature == out[4].feature
    assert media.media_features(media.store_text(docs.limit(0)), ["doc_id"]).count() == 0
