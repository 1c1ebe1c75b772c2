"""Media columns: motion JPEG in AVI files, frame decoding, and shot detection.

`avi` and `parse_avi` write and read RIFF files: header lists, a comment, frames in
the movi list, and the idx1 index that locates them.  Frames are intra-coded JPEG:
baseline (8x8 DCT blocks, grey or colour) or the lossless process (SOF3, 8-bit samples
predicted from the left), which keeps samples exactly.  Rows of a lossless frame are
restart intervals of their own, so numpy codes and decodes all rows of many frames at
once, one sample of each row a step.

Shots: a frame starts a new one where its histogram differs from the one before by
more than an adaptive threshold, the mean and deviation of the differences around.

A text is stored as a film: its UTF-8 bytes, followed by bytes 0 up to a positive
multiple of 64, are the samples of frames 64 wide and at most 64 high.

`clip_rows` takes any motion-JPEG AVI files and gives a row a shot; `store_texts` and
`read_texts` are the text columns' way there and back.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks, raw

WIDTH = HEIGHT = 64
RATE = 25  # frames a second
BINS, AROUND, LEAST, DEVIATIONS = 16, 6, 0.08, 2.0
#: code lengths of the difference categories 0..8 in the frames written here (JPEG's canonical order)
LENGTHS = {6: 2, 3: 3, 4: 3, 5: 3, 7: 3, 0: 4, 2: 4, 1: 5, 8: 5}
#: fixed values: zigzag order is made by rule below; marker bytes
SOI, EOI, SOF0, SOF3, DHT, DQT, DRI, SOS = 0xD8, 0xD9, 0xC0, 0xC3, 0xC4, 0xDB, 0xDD, 0xDA


def _zigzag() -> np.ndarray:
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([r * 8 + c for r, c in order])


ZIGZAG = _zigzag()
#: rows: DCT basis functions
DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


# --- Huffman codes -----------------------------------------------------------------


@dataclass(frozen=True)
class Huffman:
    """A JPEG table: values by rising code length, and how many there are of each length 1..16."""

    counts: tuple[int, ...]
    values: tuple[int, ...]

    @staticmethod
    def of(lengths: dict[int, int]) -> Huffman:
        values = sorted(lengths, key=lambda v: (lengths[v], v))
        return Huffman(tuple(sum(1 for v in values if lengths[v] == n) for n in range(1, 17)), tuple(values))

    def codes(self) -> dict[int, tuple[int, int]]:
        """value: (code, length)"""
        out, code, k = {}, 0, 0
        for n, count in enumerate(self.counts, 1):
            for v in self.values[k : k + count]:
                out[v] = (code, n)
                code += 1
            k += count
            code <<= 1
        return out

    @functools.cache  # noqa: B019  tables are few
    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Value and length of the code that starts each 16-bit number; length 0: none."""
        value, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for v, (code, n) in self.codes().items():
            value[code << (16 - n) : (code + 1) << (16 - n)] = v
            length[code << (16 - n) : (code + 1) << (16 - n)] = n
        return value, length

    def segment(self, place: int) -> bytes:
        return bytes([place, *self.counts, *self.values])


TABLE = Huffman.of(LENGTHS)


def _windows(data: np.ndarray) -> np.ndarray:
    """The 64 bits that start at each byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data) + 1]
    return out


def _peek(windows: np.ndarray, at: np.ndarray, skip: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """n bits (0..16) from bit place `at` + `skip`."""
    w = windows[np.minimum(at >> 3, len(windows) - 1)] << ((at & 7) + skip).astype(np.uint64)
    n = np.asarray(n)
    return np.where(n > 0, (w >> np.uint64(32)) >> (np.maximum(32 - n, 0)).astype(np.uint64), 0).astype(np.int64)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size, 1) - 1), bits - (1 << size) + 1, bits) * (size > 0)


def unstuffed(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers, and the offsets of the intervals."""
    after = np.concatenate([scan[1:], np.zeros(1, np.uint8)])
    marker = (scan == 0xFF) & (after >= 0xD0) & (after <= 0xD7)
    drop = np.zeros(len(scan) + 1, bool)
    drop[1:] = (scan == 0xFF) & ((after == 0) | marker)  # the byte after
    drop[:-1] |= marker
    kept = np.concatenate([[0], np.cumsum(~drop[:-1])])
    return scan[~drop[:-1]], np.concatenate([[0], kept[np.flatnonzero(marker)], kept[-1:]])


# --- lossless frames ---------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def lossless_head(height: int, width: int, table: Huffman = TABLE) -> bytes:
    return (
        bytes([0xFF, SOI]) + _segment(DHT, table.segment(0)) + _segment(SOF3, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + _segment(DRI, struct.pack(">H", width)) + _segment(SOS, bytes([1, 1, 0, 1, 0, 0]))
    )


def encode_lossless(rows: np.ndarray, heights: list[int]) -> list[bytes]:
    """JPEG files of frames: `rows` of samples (uint8), frame k having heights[k] of them."""
    n, width = rows.shape
    diff = np.diff(rows.astype(np.int64), axis=1, prepend=128).ravel()
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int64)
    codes = TABLE.codes()
    code, length = (np.array([codes[v][k] for v in range(9)]) for k in (0, 1))
    bits = (code[size] << size) | np.where(diff > 0, diff, diff + (1 << size) - 1)
    total = length[size] + size
    within = np.cumsum(total.reshape(n, width), axis=1)
    row_bits = within[:, -1]
    row_bytes = (row_bits + 7) >> 3
    first = np.cumsum(row_bytes) - row_bytes
    at = (first[:, None] * 8 + within).ravel() - total
    many = int(row_bytes.sum())
    word = bits << (24 - total - (at & 7))
    out = np.zeros(many + 3)
    for k in range(3):
        out += np.bincount((at >> 3) + k, (word >> (16 - 8 * k)) & 0xFF, many + 3)
    out = out[:many].astype(np.uint8)
    out[first + row_bytes - 1] |= ((1 << (row_bytes * 8 - row_bits)) - 1).astype(np.uint8)  # ones fill the last byte
    # stuffing, and markers between the rows of a frame
    starts = np.cumsum(heights) - heights
    index = np.arange(n) - np.repeat(starts, heights)
    extra = np.zeros(many + 1, np.int64)
    extra[1:] = out == 0xFF
    extra[first[index > 0]] += 2
    place = np.arange(many) + np.cumsum(extra[:-1])
    end = int(place[-1]) + 1 + int(extra[-1]) if many else 0
    coded = np.zeros(end, np.uint8)
    coded[place] = out
    later = first[index > 0]
    coded[place[later] - 2] = 0xFF
    coded[place[later] - 1] = (0xD0 + (index[index > 0] - 1) % 8).astype(np.uint8)
    bounds = np.append(place[first[starts]], end)
    data = coded.tobytes()
    return [lossless_head(h, width) + data[a:b] + bytes([0xFF, EOI]) for h, a, b in zip(heights, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


# --- parsing and decoding ----------------------------------------------------------


@dataclass
class Frame:
    process: int
    height: int
    width: int
    parts: list[tuple[int, int, int, int]]  # component: id, horizontal and vertical sampling, quantiser
    tables: dict[int, Huffman]
    quantisers: dict[int, np.ndarray]
    uses: dict[int, int]  # component: its tables (DC << 4 | AC)
    restart: int
    scan: tuple[int, int]  # place of the entropy-coded bytes


def parse_jpeg(data: bytes) -> Frame:
    """The segments of a JPEG file with one scan."""
    if data[:2] != bytes([0xFF, SOI]):
        raise ValueError("not a JPEG file")
    at, restart, tables, quantisers = 2, 0, {}, {}
    head = None
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DHT:
            while body:
                counts = tuple(body[1:17])
                n = sum(counts)
                tables[body[0]] = Huffman(counts, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == DQT:
            while body:
                wide = body[0] >> 4
                q = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                quantisers[body[0] & 15] = q
                body = body[65 + 64 * wide :]
        elif marker in (SOF0, 0xC1, SOF3):
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            head = (marker, height, width, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
        elif marker == DRI:
            restart = int.from_bytes(body[:2], "big")
        elif marker == SOS:
            uses = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            end = data.rfind(bytes([0xFF, EOI]))
            if head is None or end < at:
                raise ValueError("a JPEG file without frame or end")
            return Frame(*head, tables, quantisers, uses, restart, (at, end))


def decode_lossless(files: list[bytes]) -> list[np.ndarray]:
    """Samples of lossless frames whose rows are restart intervals; all rows are decoded side by side."""
    frames = [parse_jpeg(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for k, f in enumerate(frames):
        if f.process != SOF3 or f.restart != f.width or len(f.parts) != 1:
            raise ValueError("not a lossless frame with a restart interval a row")
        groups.setdefault((f.width, f.tables[f.uses[f.parts[0][0]] >> 4]), []).append(k)
    out: list = [None] * len(files)
    for (width, table), members in groups.items():
        data, starts, base = [], [], 0
        for k in members:
            a, b = frames[k].scan
            plain, offsets = unstuffed(np.frombuffer(files[k], np.uint8)[a:b])
            if len(offsets) - 1 != frames[k].height:
                raise ValueError("a row is missing")
            data.append(plain)
            starts.append(offsets[:-1] + base)
            base += len(plain)
        windows = _windows(np.concatenate(data))
        at = np.concatenate(starts).astype(np.int64) * 8
        value, length = table.lookup()
        diff = np.empty((width, len(at)), np.int64)
        for x in range(width):
            w = windows[at >> 3] << (at & 7).astype(np.uint64)
            top = (w >> np.uint64(48)).astype(np.int64)
            size, n = value[top], length[top]
            bits = np.where(size > 0, ((w << n.astype(np.uint64)) >> np.uint64(32)) >> np.maximum(32 - size, 0).astype(np.uint64), 0).astype(np.int64)
            diff[x] = _signed(bits, size)
            at += n + size
        samples = ((128 + np.cumsum(diff, axis=0)) & 0xFF).astype(np.uint8).T
        row = 0
        for k in members:
            out[k] = samples[row : row + frames[k].height]
            row += frames[k].height
    return out


def _blocks_of(frame: Frame, data: bytes) -> dict[int, np.ndarray]:
    """Dequantised coefficients of each component's blocks, in rows and columns of blocks."""
    scan, starts = unstuffed(np.frombuffer(data, np.uint8)[slice(*frame.scan)])
    windows = _windows(scan)
    hmax, vmax = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    wide, high = -(-frame.width // (8 * hmax)), -(-frame.height // (8 * vmax))
    out = {p[0]: np.zeros((high * p[2], wide * p[1], 64), np.int64) for p in frame.parts}
    each = frame.restart or wide * high
    at = np.array(starts[:-1], np.int64) * 8  # intervals side by side
    before = {p[0]: np.zeros(len(at), np.int64) for p in frame.parts}
    for step in range(each):
        unit = np.arange(len(at)) * each + step
        for name, h, v, _ in frame.parts:
            dc, ac = frame.tables[frame.uses[name] >> 4], frame.tables[0x10 | (frame.uses[name] & 15)]
            for sub in range(h * v):
                live = np.flatnonzero(unit < wide * high)
                block = np.zeros((len(live), 64), np.int64)
                place = at[live]
                value, length = (x[_peek(windows, place, 0, 16)] for x in dc.lookup())
                block[:, 0] = before[name][live] + _signed(_peek(windows, place, length, value), value)
                before[name][live] = block[:, 0]
                place = place + length + value
                k = np.ones(len(live), np.int64)
                while len(on := np.flatnonzero(k < 64)):
                    value, length = (x[_peek(windows, place[on], 0, 16)] for x in ac.lookup())
                    if not length.all():
                        raise ValueError("no such code")
                    run, size = value >> 4, value & 15
                    to = k[on] + run
                    ok = (size > 0) & (to < 64)
                    block[on[ok], to[ok]] = _signed(_peek(windows, place[on], length, size), size)[ok]
                    place[on] += length + size
                    k[on] = np.where(size > 0, to + 1, np.where(run == 15, k[on] + 16, 64))
                at[live] = place
                y = unit[live] // wide * v + sub // h
                x = unit[live] % wide * h + sub % h
                out[name][y, x] = block
    return {p[0]: out[p[0]] * frame.quantisers[p[3]] for p in frame.parts}


def decode_baseline(data: bytes) -> np.ndarray:
    """Samples (height, width) of a grey or (height, width, 3) RGB of a YCbCr baseline frame."""
    frame = parse_jpeg(data)
    if frame.process == SOF3:
        return decode_lossless([data])[0]
    hmax, vmax = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    planes = []
    for (name, h, v, _), blocks in zip(frame.parts, _blocks_of(frame, data).values(), strict=True):
        grid = np.zeros_like(blocks)
        grid[..., ZIGZAG] = blocks
        pixels = DCT.T @ grid.reshape(*grid.shape[:2], 8, 8) @ DCT + 128
        plane = pixels.transpose(0, 2, 1, 3).reshape(grid.shape[0] * 8, -1)
        planes.append(plane.repeat(vmax // v, 0).repeat(hmax // h, 1)[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# --- AVI ---------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], height: int, width: int, comment: str = "", rate: int = RATE) -> bytes:
    """A RIFF AVI file of motion-JPEG frames with an idx1 index; under 4 GB, the format's limit."""
    n, most = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    info = b"INFO" + _chunk(b"ICMT", comment.encode() + b"\0")
    index, at, movi = [], 4, [b"movi"]
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        c = _chunk(b"00dc", f)
        movi.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Film:
    rate: float
    height: int
    width: int
    comment: str
    frames: list[bytes]


def parse_avi(data: bytes) -> Film:
    """Header, comment and indexed frames of an AVI file; without an index the movi list is walked."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, height, width, comment, movi, index = float(RATE), 0, 0, "", None, None

    def walk(at: int, end: int) -> None:
        nonlocal rate, height, width, comment, movi, index
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, body + size)
                else:
                    walk(body + 4, body + size)
            elif name == b"avih":
                width, height = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, per = struct.unpack_from("<II", data, body + 20)
                rate = per / max(1, scale)
            elif name == b"ICMT":
                comment = data[body : body + size].rstrip(b"\0").decode(errors="replace")
            elif name == b"idx1":
                index = (body, body + size)
            at = body + size + (size & 1)

    walk(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))
    frames = []
    if movi is None:
        return Film(rate, height, width, comment, frames)
    if index is not None:
        entries = [struct.unpack_from("<4sIII", data, a) for a in range(*index, 16)]
        # offsets count from the list's name, in some files from the file's start
        base = movi[0] if not entries or entries[0][2] < movi[0] else 0
        places = [(base + at + 8, size) for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
    else:
        places, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                places.append((at + 8, size))
            at += 8 + size + (size & 1)
    return Film(rate, height, width, comment, [data[a : a + size] for a, size in places])


# --- shots -------------------------------------------------------------------------


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of BINS brightness levels in each frame (frames, samples)."""
    n = len(frames)
    level = frames.reshape(n, -1).astype(np.int64) * BINS // 256
    flat = np.bincount((level + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS)
    return flat.reshape(n, BINS) / max(1, level.shape[1])


def shots(shares: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frames of the shots, given the frames' histograms."""
    n = len(shares)
    if not n:
        return []
    d = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    cuts = []
    for t in range(len(d)):
        near = np.concatenate([d[max(0, t - AROUND) : t], d[t + 1 : t + 1 + AROUND]])
        if d[t] > max(LEAST, near.mean() + DEVIATIONS * near.std() if len(near) else LEAST):
            cuts.append(t + 1)
    edges = [0, *cuts, n]
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


# --- columns -----------------------------------------------------------------------


def films_of(column: pa.Array) -> list[bytes]:
    """AVI files that hold the texts of a column."""
    data, at = raw(column)
    size = np.diff(at)
    rows = np.maximum(1, -(-size // WIDTH))
    high = np.minimum(rows, HEIGHT)
    frames = -(-rows // high)
    samples = np.zeros(int((frames * high).sum()) * WIDTH, np.uint8)
    start = (np.cumsum(frames * high) - frames * high) * WIDTH
    samples[np.repeat(start - at[:-1], size) + np.arange(len(data))] = data
    files = encode_lossless(samples.reshape(-1, WIDTH), np.repeat(high, frames).tolist())
    first = np.cumsum(frames) - frames
    return [
        avi(files[a : a + n], h, WIDTH, f"text_bytes={s};payload_bytes={r * WIDTH}")
        for a, n, h, s, r in zip(first.tolist(), frames.tolist(), high.tolist(), size.tolist(), rows.tolist(), strict=True)
    ]


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as an AVI file; a null text is an empty one, one row of zeros.  Rows repeat as they do in docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(films_of(batch.column("text")), pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


def _clips(film: Film, shares: np.ndarray) -> list[dict]:
    return [{"first_frame": a, "last_frame": b, "start_s": a / film.rate, "end_s": (b + 1) / film.rate} for a, b in shots(shares)]


#: what a damaged file may raise on its way through the parsers
DAMAGE = (ValueError, IndexError, KeyError, struct.error)


def grey(frame: bytes) -> np.ndarray:
    """A frame's samples; of a colour frame the mean of its channels."""
    samples = decode_baseline(frame)
    return samples if samples.ndim == 2 else samples.mean(2).astype(np.uint8)


def clip_rows(films: DataFrame) -> DataFrame:
    """A row for each shot of each film: film_id, clip, first_frame, last_frame, start_s, end_s, error.

    films: film_id (any type), media (a whole AVI file of baseline or lossless JPEG
    frames); other columns are ignored.  Frames are decoded one at a time, so a task holds
    a file and its frames' histograms.  A film without frames has no rows; a null or
    damaged one has a single row that names the error, other fields null.  Repeated films
    have their rows each time; an empty table gives none.
    """
    kind = films.schema["film_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for k, data in enumerate(batch.column("media")):
                try:
                    if not data.is_valid:
                        raise ValueError("no file")
                    film = parse_avi(data.as_py())
                    shares = np.concatenate([np.zeros((0, BINS)), *(histograms(grey(f)[None]) for f in film.frames)])
                    found = [(n, *clip.values(), None) for n, clip in enumerate(_clips(film, shares))]
                except DAMAGE as e:
                    found = [(None, None, None, None, None, f"{type(e).__name__}: {e}")]
                rows += found
                owner += [k] * len(found)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("film_id").take(pa.array(owner, pa.int32())), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))],
                names=["film_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "error"],
            )

    return films.select("film_id", "media").mapInArrow(
        run, f"film_id {kind}, clip int, first_frame int, last_frame int, start_s double, end_s double, error string"
    )


def _read(data: bytes, film: Film, decoded: list[np.ndarray]) -> tuple:
    frames = np.stack(decoded)
    n, size = (int(x) for x in re.findall(r"\d+", film.comment))
    payload = frames.tobytes()[:size]
    if not n <= len(payload) == size:
        raise ValueError("the film is shorter than its text")
    clips = _clips(film, histograms(frames))
    return (
        n, size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(),
        f"frames={len(frames)};shots=" + ",".join(f"{c['first_frame']}-{c['last_frame']}" for c in clips), clips, None,
    )


def _read_all(files: list[bytes | None]) -> list[tuple]:
    """The fields of each film; frames of all are decoded together, and one film at a time if any is damaged."""
    try:
        films = [parse_avi(f or b"") for f in files]
        decoded = decode_lossless([f for film in films for f in film.frames])
        at = np.cumsum([0, *(len(film.frames) for film in films)]).tolist()
        return [_read(data, film, decoded[a:b]) for data, film, a, b in zip(files, films, at[:-1], at[1:], strict=True)]
    except DAMAGE as e:
        if len(files) > 1:
            return [_read_all([f])[0] for f in files]
        return [(*[None] * 8, f"{type(e).__name__}: {e}" if files[0] is not None else "no file")]


def read_texts(films: DataFrame) -> DataFrame:
    """What films of `store_texts` hold, decoded from their bytes.

    films: doc_id, media.  Result: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (frames and shots), clips, the shots with their times, and
    error.  A null or damaged film has its error and nulls elsewhere.  Repeated rows are
    read each; an empty table gives no rows.
    """
    kind = films.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            columns = zip(*_read_all([x.as_py() for x in batch.column("media")]), strict=True)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), CLIPS, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"],
            )

    return films.select("doc_id", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, clips array<struct<first_frame: int, last_frame: int, start_s: double, end_s: double>>, error string",
    )


CLIPS = pa.list_(pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
