"""Media columns: baseline JPEG files in a binary column, and features of their DC-only luminance thumbnails.

A block's DC coefficient is eight times its mean less 128, so a scan gives the thumbnail of an image at an eighth of
its size without any inverse transform. Bytes are stored in such a file by the same rule turned round: a gray image
has one flat 8x8 block per byte, with the byte as its level, 64 blocks in a row and a restart marker after each row.
Restart intervals are decoded side by side, one block of all of them at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

ROW = 64
#: Heights are 16-bit numbers; longer payloads take several images, one after another.
IMAGE_ROWS = 65_535 // 8
#: Bytes of text, or of media, that are worked on at a time.
SLICE = 1_000_000
ENCODE_ROWS = 16_384

# Code lengths of the written Huffman tables: differences of neighbouring bytes have 1 to 7 bits mostly; the only AC
# symbol is the end of a block.
DC_LENGTHS = {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 0: 4, 8: 5}
AC_LENGTHS = {0: 1}


def canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) for (symbol, length) in the order of their codes."""
    out, code, last = {}, 0, 0
    for symbol, n in lengths:
        code <<= n - last
        out[symbol] = (code, n)
        code, last = code + 1, n
    return out


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def huffman_segment(kind: int, lengths: dict[int, int]) -> bytes:
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return segment(0xC4, bytes([kind << 4]) + counts + bytes(lengths))


def header(rows: int) -> bytes:
    size = (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big")
    return b"".join([
        b"\xff\xd8",
        segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        segment(0xDB, bytes([0, 8] + [1] * 63)),
        segment(0xC0, b"\x08" + size + b"\1\1\x11\0"),
        huffman_segment(0, DC_LENGTHS),
        huffman_segment(1, AC_LENGTHS),
        segment(0xDD, ROW.to_bytes(2, "big")),
        segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


@lru_cache(maxsize=1)
def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255: DC code, value, end of block."""
    dc, (end, end_bits) = canonical(list(DC_LENGTHS.items())), canonical(list(AC_LENGTHS.items()))[0]
    codes, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, bits = dc[n]
        codes[d + 255] = ((code << n | (d if d >= 0 else d + (1 << n) - 1)) << end_bits) | end
        sizes[d + 255] = bits + n + end_bits
    return codes, sizes


def encode_rows(rows: np.ndarray, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row of 64 payload bytes, each followed by FF and its marker; and the rows' ends."""
    levels = rows.astype(np.int16)
    difference = np.diff(levels, axis=1, prepend=np.int16(128)) + 255
    codes, sizes = block_codes()
    code, bits = codes[difference], sizes[difference]
    ends = np.cumsum(bits, axis=1)
    total = ends[:, -1]
    n_bytes = (total + 7) >> 3
    base = np.cumsum(n_bytes) - n_bytes
    at = (base[:, None] << 3) + ends - bits
    value = (code << (24 - bits - (at & 7)).astype(np.uint32)).ravel()
    byte, n = (at >> 3).ravel(), int(n_bytes.sum())
    raw = sum(np.bincount(byte + k, (value >> (16 - 8 * k)) & 0xFF, n + 2) for k in range(3))[:n].astype(np.uint8)
    raw[base + n_bytes - 1] |= ((1 << (8 * n_bytes - total)) - 1).astype(np.uint8)
    full = raw == 0xFF
    row_of = np.repeat(np.arange(len(rows)), n_bytes)
    place = np.arange(n) + np.cumsum(full) - full + 2 * row_of
    stuffed = np.bincount(row_of[full], minlength=len(rows))
    row_ends = np.cumsum(n_bytes + stuffed + 2)
    out = np.zeros(row_ends[-1], np.uint8)
    out[place] = raw
    out[row_ends - 2], out[row_ends - 1] = 0xFF, markers
    return out, row_ends


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 64 bytes, as a JPEG file or several in a row."""
    heights = [len(p) // ROW for p in payloads]
    images = [(k, min(IMAGE_ROWS, h - a)) for k, h in enumerate(heights) for a in range(0, h, IMAGE_ROWS)]
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    markers = np.concatenate([np.append(0xD0 + np.arange(h - 1) % 8, 0xD9) for _, h in images]).astype(np.uint8)
    parts = [encode_rows(rows[a : a + ENCODE_ROWS], markers[a : a + ENCODE_ROWS]) for a in range(0, len(rows), ENCODE_ROWS)]
    data = np.concatenate([p[0] for p in parts]).tobytes()
    shift = np.cumsum([0, *[len(p[0]) for p in parts[:-1]]])
    ends = np.concatenate([p[1] + s for p, s in zip(parts, shift)])
    out: list[list[bytes]] = [[] for _ in payloads]
    row = start = 0
    for k, h in images:
        row += h
        out[k] += [header(h), data[start : ends[row - 1]]]
        start = ends[row - 1]
    return [b"".join(x) for x in out]


class Unsupported(ValueError):
    """Not a baseline JPEG, or a broken one."""


@lru_cache(maxsize=64)
def huffman_lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length (0: no such code) for each 16 bits that may come next."""
    counts, symbols = table[:16], table[16:]
    lengths = [(s, n) for s, n in zip(symbols, (k + 1 for k in range(16) for _ in range(counts[k])))]
    symbol, length = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    for s, (code, n) in canonical(lengths).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


@lru_cache(maxsize=64)
def flat_lookup(dc: bytes, ac: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Difference and bits of a block that is a DC value and the end of block, where both lie within 16 bits; 0 bits
    where they don't."""
    peek = np.arange(65536)
    size, n = huffman_lookup(dc)
    value = ((peek << n) & 0xFFFF) >> (16 - np.minimum(size, 16))
    difference = np.where((size > 0) & (value < 1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)
    symbol, m = huffman_lookup(ac)
    rest = (peek << np.minimum(n + size, 16)) & 0xFFFF
    bits = n + size + m[rest]
    good = (n > 0) & (m[rest] > 0) & (symbol[rest] == 0) & (bits <= 16)
    return np.where(good, difference, 0).astype(np.int32), np.where(good, bits, 0).astype(np.int64)


def block_by_symbols(words: np.ndarray, at: int, dc: bytes, ac: bytes) -> tuple[int, int]:
    """Difference of one block, and the bit after it; AC values are skipped."""

    def peek(at: int) -> int:
        return (int(words[min(at >> 3, len(words) - 1)]) >> (16 - (at & 7))) & 0xFFFF

    symbols, lengths = huffman_lookup(dc)
    p = peek(at)
    n, size = int(lengths[p]), int(symbols[p])
    if not n or size > 11:
        raise Unsupported("no such DC code")
    at += n
    value = peek(at) >> (16 - size)
    difference = value if not size or value >> (size - 1) else value - (1 << size) + 1
    at, k = at + size, 1
    symbols, lengths = huffman_lookup(ac)
    while k < 64:
        p = peek(at)
        n, s = int(lengths[p]), int(symbols[p])
        if not n:
            raise Unsupported("no such AC code")
        at += n + (s & 15)
        if not s:
            break
        k += (s >> 4) + 1
    return difference, at


def parse(data: bytes, at: int, stop: int, scan_end: Callable[[int], int]) -> dict:
    """Markers of the image that begins at ``at`` and of its file, which ends at ``stop``: size, tables and restart
    interval of the scan that holds the first component, where this scan begins (``scan``), its components, and where
    the image ends (``end``). ``scan_end`` tells the byte where a scan ends; other scans are passed over."""
    if data[at : at + 2] != b"\xff\xd8":
        raise Unsupported("no start of image")
    at += 2
    x: dict = {"quant": {}, "huffman": {}, "restart": 0}
    found: dict = {}
    pending: set = set()
    while True:
        if at + 2 > stop or data[at] != 0xFF:
            raise Unsupported("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            if not found or pending:
                raise Unsupported("no scan")
            return found | {"end": at}
        if at + 4 > stop:
            raise Unsupported("short segment")
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : min(stop, at + 2 + n)], at + 2 + n
        if len(body) != n - 2:
            raise Unsupported("short segment")
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                x["quant"][body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                m = 17 + sum(body[1:17])
                x["huffman"][body[0]] = bytes(body[1:m])
                body = body[m:]
        elif marker == 0xDD:
            x["restart"] = int.from_bytes(body, "big")
        elif marker == 0xC0:
            if body[0] != 8:
                raise Unsupported("not 8 bits")
            x["height"], x["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            x["parts"] = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            pending = {p[0] for p in x["parts"]}
        elif 0xC0 < marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Unsupported("not baseline")
        elif marker == 0xDA:
            if "parts" not in x or not x["width"] or not x["height"]:
                raise Unsupported("no frame")
            tables = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
            if not tables or not tables.keys() <= pending:
                raise Unsupported("a scan of other components")
            pending -= tables.keys()
            own = [p for p in x["parts"] if p[0] in tables]
            if own[0] == x["parts"][0]:
                try:
                    blocks = [(p, x["huffman"][tables[name] >> 4], x["huffman"][16 | tables[name] & 15]) for p, (name, h, v, _) in enumerate(own) for _ in range(h * v if len(own) > 1 else 1)]
                    found = x | {"blocks": blocks, "step": x["quant"][own[0][3]], "scan": at, "own": own}
                except KeyError as e:
                    raise Unsupported("no such table") from e
            at = scan_end(at)
            if at >= stop:
                raise Unsupported("no end of image")


class Scans:
    """The scans of many images, with the stuffing taken out: ``words`` has the 32 bits from each byte on."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        mark = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[mark + 1]
        keep = np.ones(len(raw), bool)
        keep[mark[after == 0] + 1] = False
        self.place = np.cumsum(keep) - 1
        clean = np.concatenate([raw[keep], np.full(4, 0xFF, np.uint8)]).astype(np.uint32)
        self.words = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
        self.restarts = mark[(after >= 0xD0) & (after <= 0xD7)]
        self.stops = mark[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]

    def end(self, start: int) -> int:
        """The byte where the scan at byte ``start`` ends."""
        k = np.searchsorted(self.stops, start)
        if k == len(self.stops):
            raise Unsupported("no end of image")
        return int(self.stops[k])

    def lanes(self, start: int) -> np.ndarray:
        """First bits of the restart intervals of the scan at byte ``start``."""
        end = self.end(start)
        own = self.restarts[np.searchsorted(self.restarts, start) : np.searchsorted(self.restarts, end)]
        return self.place[np.append(start, own + 2)] << 3


def decode_dc(words: np.ndarray, at: np.ndarray, counts: np.ndarray, blocks: list) -> list[np.ndarray]:
    """DC levels of the first component: per lane its MCUs' blocks. ``at``: first bits; ``counts``: MCUs of each lane,
    descending, so the lanes that still run are the first ones."""
    own = sum(b[0] == 0 for b in blocks)
    out = np.zeros((len(at), int(counts[0]), own), np.int32)
    level = np.zeros((len(at), 1 + max(b[0] for b in blocks)), np.int32)
    at, last = at.copy(), len(words) - 1
    for mcu in range(int(counts[0])):
        n = int(np.searchsorted(-counts, -mcu, "left"))
        k = 0
        for part, dc, ac in blocks:
            values, bits = flat_lookup(dc, ac)
            now = at[:n]
            peek = (words[np.minimum(now >> 3, last)] << (now & 7).astype(np.uint32)) >> np.uint32(16)
            difference, used = values[peek], bits[peek]
            if not used.all():
                for lane in np.flatnonzero(used == 0).tolist():
                    difference[lane], end = block_by_symbols(words, int(now[lane]), dc, ac)
                    used[lane] = end - now[lane]
            at[:n] += used
            level[:n, part] += difference
            if part == 0:
                out[:n, mcu, k] = level[:n, 0]
                k += 1
    return [out[k, :c] for k, c in enumerate(counts.tolist())]


def thumbnails(files: list[bytes]) -> list[list[np.ndarray] | None]:
    """Luminance thumbnails, an eighth of the size, of the images in each file; None for a file that isn't baseline."""
    data, bases = b"".join(files), np.cumsum([0, *map(len, files)]).tolist()
    scans = Scans(data)
    found: list = [[] for _ in files]
    jobs: dict[tuple, list] = {}
    for f, (start, stop) in enumerate(zip(bases, bases[1:])):
        try:
            while True:
                x = parse(data, start, stop, scans.end)
                lanes, end = scans.lanes(x["scan"]), x["end"]
                # a scan of one component has only the blocks that its samples need, one after another
                hm, vm = max(p[1] for p in x["parts"]), max(p[2] for p in x["parts"])
                _, ph, pv, _ = x["parts"][0]
                single = len(x["own"]) == 1
                h, v = (1, 1) if single else (ph, pv)
                if single:
                    across, down = -(-x["width"] * ph // (8 * hm)), -(-x["height"] * pv // (8 * vm))
                else:
                    across, down = -(-x["width"] // (8 * hm)), -(-x["height"] // (8 * vm))
                each = x["restart"] or across * down
                counts = np.minimum(each, across * down - each * np.arange(-(-across * down // each)))
                if len(counts) != len(lanes):
                    raise Unsupported("restart markers are missing")
                x |= {"across": across, "down": down, "h": h, "v": v, "rows": -(-x["height"] * pv // (8 * vm)), "columns": -(-x["width"] * ph // (8 * hm))}
                found[f].append(x)
                jobs.setdefault(tuple(x["blocks"]), []).append((x, lanes, counts))
                start = end + 2
                if start >= stop or data[start : start + 2] != b"\xff\xd8":
                    break
        except (Unsupported, IndexError):
            found[f] = None
    for blocks, own in jobs.items():
        at, counts = np.concatenate([j[1] for j in own]), np.concatenate([j[2] for j in own])
        order = np.argsort(-counts, kind="stable")
        try:
            groups = [(order, decode_dc(scans.words, at[order], counts[order], list(blocks)))]
        except Unsupported:  # one of them is broken: each by itself
            groups = []
            first = 0
            for x, lanes, n in own:
                few = np.argsort(-n, kind="stable")
                try:
                    groups.append((first + few, decode_dc(scans.words, lanes[few], n[few], list(blocks))))
                except Unsupported:
                    x["broken"] = True
                first += len(lanes)
        lanes_out: list = [None] * len(at)
        for places, levels in groups:
            for place, level in zip(places.tolist(), levels):
                lanes_out[place] = level
        first = 0
        for x, lanes, _ in own:
            x["levels"] = lanes_out[first : first + len(lanes)]
            first += len(lanes)
    return [None if images is None or any(x.get("broken") for x in images) else [thumbnail(x) for x in images] for images in found]


def thumbnail(x: dict) -> np.ndarray:
    levels = np.concatenate(x["levels"])
    pixels = np.clip(np.floor(levels * x["step"] / 8 + 128.5), 0, 255).astype(np.uint8)
    tiled = pixels.reshape(x["down"], x["across"], x["v"], x["h"]).transpose(0, 2, 1, 3).reshape(x["down"] * x["v"], -1)
    return tiled[: x["rows"], : x["columns"]]


def average_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: which cells of an 8x8 grid are brighter than the mean of the cells."""
    rows, columns = image.shape
    a, b = np.arange(8) * rows // 8, np.arange(8) * columns // 8
    c, d = np.maximum(a + 1, (np.arange(8) + 1) * rows // 8), np.maximum(b + 1, (np.arange(8) + 1) * columns // 8)
    table = np.zeros((rows + 1, columns + 1), np.int64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=table[1:, 1:])
    cells = (table[c][:, d] - table[a][:, d] - table[c][:, b] + table[a][:, b]) / ((c - a)[:, None] * (d - b))
    return np.packbits(cells > cells.mean()).tobytes().hex()


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's UTF-8 bytes, filled with 0 to a positive multiple of 64, as JPEG.

    Null counts as empty, which gives one row of zeros; equal texts give equal files; texts of any length are stored
    whole. One row per input row; an empty table gives an empty result; other columns are ignored. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = encode([t + b"\0" * (-len(t) % ROW or ROW * (not t)) for t in raw])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "media_bytes long, media_sha256 string, images int, width int, height long, thumbnail_bytes long, thumbnail_sha256 string, tail_crc32 long, feature string"


def media_features(table: DataFrame, keys: list[str], column: str = "media") -> DataFrame:
    """``keys`` and FEATURES of a column of JPEG files, read back from its bytes.

    Images that follow one another in a file count as one below the other. Null, empty, broken and non-baseline files
    keep their row; all that needs the image is null (for a null file everything)."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def of(media: bytes, images: list[np.ndarray] | None) -> tuple:
        own = (len(media), hashlib.sha256(media).hexdigest())
        if images is None or len({i.shape[1] for i in images}) != 1:
            return (*own, *[None] * 7)
        whole = np.concatenate(images) if len(images) > 1 else images[0]
        raw = whole.tobytes()
        feature = f"{whole.shape[1]}x{whole.shape[0]}:{average_hash(whole)}:{whole.mean():.2f}"
        return (*own, len(images), 8 * whole.shape[1], 8 * whole.shape[0], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, SLICE):
            media = [m or b"" for m in batch.column(column).to_pylist()]
            rows = [of(m, t) for m, t in zip(media, thumbnails(media))]
            valid = batch.column(column).is_valid().to_pylist()
            values = list(zip(*[r if ok else (None,) * len(names) for r, ok in zip(rows, valid)]))
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            arrays = [pa.array(v, kinds[f.split()[1]]) for v, f in zip(values, FEATURES.split(", "))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *arrays], [*keys, *names])

    kept = table.select(*keys, column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keys)
    return kept.mapInArrow(run, f"{schema}, {FEATURES}")


def query(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a picture, with what is read back from it."""
    stored = store_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media_features(stored, ["doc_id", "n_bytes"]).selectExpr(
        "doc_id", "n_bytes", "thumbnail_bytes as payload_bytes", "thumbnail_sha256 as payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
