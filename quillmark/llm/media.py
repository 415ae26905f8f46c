"""Media columns as AVI with motion-JPEG frames.

A payload is stored in baseline JPEG frames as quantised DCT coefficients, the unit that JPEG keeps without loss: a byte is the
extra bits of a coefficient of size 8. Reading parses the RIFF chunks and the idx1 index, decodes each intra frame by its own
quantiser, Huffman, frame and scan segments, and measures shots by the differences of the components' histograms against a
threshold that adapts to the clip.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: A frame holds one 8 x 8 block for each of three components.
FRAME, SIDE = 192, 8
#: Frames each second, bins of a histogram, frames whose differences set the threshold, deviations above their mean.
RATE, BINS, NEAR, DEVIATIONS = 25, 16, 24, 2
#: Frames decoded to samples at once.
TOGETHER = 4096


def _kernel() -> np.ndarray:
    """Inverse DCT of 64 coefficients in zigzag order to 64 samples, in 1/4096ths; whole numbers make all sums of this writer exact."""
    order = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    x = np.arange(8)
    basis = lambda u: np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if u == 0 else 1) / 2
    return np.rint(np.array([np.outer(basis(u), basis(v)).ravel() for u, v in order]) * 4096).astype(np.float32)


KERNEL = _kernel()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


#: One quantiser step, three components of one 8 x 8 block, and Huffman tables whose only symbol (size 8, no zeros before it) has
#: an 8-bit code. So each coefficient takes the byte 0 and a byte of extra bits.
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3)))
    + _segment(0xC4, b"\0" + bytes([0] * 7 + [1] + [0] * 8) + b"\x08")
    + _segment(0xC4, b"\x10" + bytes([0] * 7 + [1] + [0] * 8) + b"\x08")
    + _segment(0xDA, b"\3" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + b"\0\x3f\0")
)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def padded(data: bytes) -> bytes:
    """Spaces are appended up to a positive multiple of a frame's bytes."""
    return data + b" " * (FRAME - len(data) % FRAME if len(data) % FRAME or not data else 0)


def write_avi(payload: bytes) -> bytes:
    """An AVI of payload, a positive multiple of 192 bytes; every 192 are a frame."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload is no positive multiple of 192 bytes")
    n = len(payload) // FRAME
    if b"\xff" in payload:  # stuffed, so frames differ in length
        frames = []
        for at in range(0, len(payload), FRAME):
            coded = bytearray(2 * FRAME)
            coded[1::2] = payload[at : at + FRAME]
            frames.append(HEADER + bytes(coded).replace(b"\xff", b"\xff\0") + b"\xff\xd9")
        chunks = [_chunk(b"00dc", f) for f in frames]
        sizes = np.array([len(f) for f in frames], "<u4")
        offsets = 4 + np.concatenate([[0], np.cumsum([len(c) for c in chunks])[:-1]])
        movi = b"".join(chunks)
    else:
        head, tail = struct.pack("<4sI", b"00dc", len(HEADER) + 2 * FRAME + 2) + HEADER, b"\xff\xd9" + b"\0" * (len(HEADER) % 2)
        rows = np.zeros((n, len(head) + 2 * FRAME + len(tail)), np.uint8)
        rows[:, : len(head)] = np.frombuffer(head, np.uint8)
        rows[:, len(head) + 1 : len(head) + 2 * FRAME : 2] = np.frombuffer(payload, np.uint8).reshape(n, FRAME)
        rows[:, len(head) + 2 * FRAME :] = np.frombuffer(tail, np.uint8)
        movi = rows.tobytes()
        sizes = np.full(n, len(HEADER) + 2 * FRAME + 2, "<u4")
        offsets = 4 + np.arange(n) * rows.shape[1]
    index = np.zeros(n, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 16, offsets, sizes
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 16, n, 0, 1, int(sizes.max()), SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, int(sizes.max()), 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    return _chunk(b"RIFF", b"AVI " + headers + _chunk(b"LIST", b"movi" + movi) + _chunk(b"idx1", index.tobytes()))


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the RIFF chunks in data[at:end]; a cut-off chunk is an error."""
    if end > len(data):
        raise ValueError("the file is cut off")
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError("a chunk ends beyond its list")
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def index_of(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Microseconds a frame, and (offset, size) of each video frame as idx1 has them, counted from the list of frames or the file."""
    view = memoryview(data)
    if len(data) < 12 or bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"AVI ":
        raise ValueError("no AVI")
    micros, movi, entries = 0, 0, np.zeros((0, 4), "<u4")
    for name, a, b in _chunks(view, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if name == b"LIST" and bytes(view[a : a + 4]) == b"hdrl":
            micros = next((struct.unpack_from("<I", data, x)[0] for c, x, _ in _chunks(view, a + 4, b) if c == b"avih"), 0)
        elif name == b"LIST" and bytes(view[a : a + 4]) == b"movi":
            movi = a
        elif name == b"idx1":
            entries = np.frombuffer(data, "<u4", (b - a) // 16 * 4, a).reshape(-1, 4)
    own = entries[entries[:, 0] == struct.unpack("<I", b"00dc")[0]]
    if len(own) and view[movi + int(own[0, 2]) :][:4] != b"00dc":
        movi = 0
    return micros, [(movi + at + 8, size) for at, size in own[:, 2:].tolist()]


@dataclass
class Component:
    """One component of a frame: its sampling and its tables."""

    name: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Layout:
    """What the segments before the entropy-coded data say."""

    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    #: by (class, number): the 16 counts of code lengths, and the symbols in order of their codes
    codes: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    components: list[Component] = field(default_factory=list)
    height: int = 0
    width: int = 0
    restart: int = 0
    begin: int = 0

    def steps(self) -> np.ndarray:
        """Quantiser steps of each component (components x 64, in zigzag order)."""
        return np.stack([self.quantisers[c.quantiser] for c in self.components])

    def plain(self) -> bool:
        """Whether each component has one block, whose coefficients all take an 8-bit code of zeros and 8 extra bits, so that they
        lie at fixed places."""
        one = [self.codes.get(x) for c in self.components for x in ((0, c.dc), (1, c.ac))]
        return self.width <= 8 and self.height <= 8 and not self.restart and all(c.across == c.down == 1 for c in self.components) and all(x == (bytes([0] * 7 + [1] + [0] * 8), b"\x08") for x in one)


def layout(frame: bytes) -> Layout:
    """The segments of a baseline frame; another kind of frame, or a damaged one, is an error."""
    out, at = Layout(), 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while at + 4 <= len(frame):
        if frame[at] != 255:
            raise ValueError("a marker is missing")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out.codes[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            precision, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("samples of 8 bits are read only")
            out.components = [Component(name, x >> 4, x & 15, q) for name, x, q in zip(*(body[6 + i : 6 + 3 * n : 3] for i in range(3)), strict=True)]
        elif marker == 0xDD:
            out.restart = struct.unpack_from(">H", body)[0]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("baseline frames are read only")
        elif marker == 0xDA:
            tables = dict(zip(body[1 : 1 + 2 * body[0] : 2], body[2 : 2 + 2 * body[0] : 2], strict=True))
            if not out.components or tables.keys() != {c.name for c in out.components}:
                raise ValueError("a frame has one scan of all its components")
            for c in out.components:
                c.dc, c.ac = tables[c.name] >> 4, tables[c.name] & 15
            out.begin = at
            return out
    raise ValueError("a frame has no scan")


def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Length (0: no code) and symbol for every 16 bits that may come next."""
    lengths, values = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for length in range(1, 17):
        for symbol in symbols[at : at + counts[length - 1]]:
            lengths[code << 16 - length : code + 1 << 16 - length] = length
            values[code << 16 - length : code + 1 << 16 - length] = symbol
            code += 1
        at += counts[length - 1]
        code <<= 1
    return lengths.tolist(), values.tolist()


class _Bits:
    """Bits of entropy-coded data whose stuffing is gone; beyond the end come ones, of which no code may need any."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        out = self.peek() >> 16 - n if n else 0
        self.n -= n
        self.held &= (1 << self.n) - 1
        if 8 * (self.at - len(self.data)) > self.n:
            raise ValueError("the frame's data end early")
        return out

    def peek(self) -> int:
        while self.n < 16:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 255)
            self.at, self.n = self.at + 1, self.n + 8
        return self.held >> self.n - 16

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        bits = self.peek()
        if not table[0][bits]:
            raise ValueError("the frame's data are damaged")
        self.take(table[0][bits])
        return table[1][bits]

    def number(self, size: int) -> int:
        """Extra bits: negative where the first bit is 0."""
        x = self.take(size)
        return x - (1 << size) + 1 if size and not x >> size - 1 else x


def decode_frame(frame: bytes, own: Layout | None = None) -> list[np.ndarray]:
    """The quantised coefficients of each component (blocks x 64, in zigzag order), blocks in order of the scan."""
    own = own or layout(frame)
    if frame[-2:] != b"\xff\xd9":
        raise ValueError("the frame has no end")
    tables = {k: _lookup(*v) for k, v in own.codes.items()}
    one = len(own.components) == 1
    most = max(c.across for c in own.components), max(c.down for c in own.components)
    units = -(-own.width // (8 if one else 8 * most[0])) * -(-own.height // (8 if one else 8 * most[1]))
    out: list[list[np.ndarray]] = [[] for _ in own.components]
    parts, done = [frame[own.begin : -2]], 0
    if own.restart:
        parts, at = [], own.begin
        for i in range(own.begin, len(frame) - 2):
            if frame[i] == 255 and 0xD0 <= frame[i + 1] <= 0xD7:
                parts.append(frame[at:i])
                at = i + 2
        parts.append(frame[at:-2])
    for part in parts:
        bits, before = _Bits(part.replace(b"\xff\0", b"\xff")), [0] * len(own.components)
        for _ in range(min(own.restart or units, units - done)):
            for i, c in enumerate(own.components):
                for _ in range(1 if one else c.across * c.down):
                    block = np.zeros(64, np.int32)
                    before[i] += bits.number(bits.symbol(tables[0, c.dc]))
                    block[0], k = before[i], 1
                    while k < 64:
                        run, size = divmod(bits.symbol(tables[1, c.ac]), 16)
                        if not size and run != 15:
                            break
                        k += run
                        if k > 63:
                            raise ValueError("a block has too many coefficients")
                        block[k] = bits.number(size)
                        k += 1
                    out[i].append(block)
            done += 1
    if done < units:
        raise ValueError("the frame's data end early")
    return [np.array(x) for x in out]


def decoded(data: bytes, entries: list[tuple[int, int]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The frames at entries, some at a time: each component's coefficients (frames x blocks x 64) and the quantiser steps.

    Frames whose segments are the same, of fixed places and of equal size and distance are decoded together.
    """
    at = 0
    while at < len(entries):
        first, size = entries[at]
        frame = data[first : first + size]
        own = layout(frame)
        header, n = frame[: own.begin], 64 * len(own.components)
        if not own.plain():
            yield [x[None] for x in decode_frame(frame, own)], own.steps()
            at += 1
            continue
        step = entries[at + 1][0] - first if at + 1 < len(entries) else size
        end = at + 1
        if size == own.begin + 2 * n + 2 and step >= size:
            while end < len(entries) and end - at < TOGETHER and entries[end] == (first + step * (end - at), size):
                end += 1
            rows = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8, offset=first), (end - at, size), (step, 1))
            same = (rows[:, : own.begin] == np.frombuffer(header, np.uint8)).all(axis=1)
            end = at + max(1, len(same) if same.all() else int(np.argmin(same)))
            coded, ends = rows[: end - at, own.begin : -2], rows[: end - at, -2:]
        else:
            coded = np.frombuffer(frame[own.begin : -2].replace(b"\xff\0", b"\xff"), np.uint8)[None]
            ends = np.frombuffer(frame[-2:], np.uint8)[None]
        if coded.shape[1] != 2 * n or coded[:, ::2].any() or (ends != np.array([255, 217], np.uint8)).any():
            raise ValueError("the frame's data are damaged")
        extra = coded[:, 1::2].astype(np.int16)
        values = np.where(extra < 128, extra - 255, extra).reshape(len(extra), -1, 1, 64)
        yield [values[:, i] for i in range(values.shape[1])], own.steps()
        at = end


def payload_of(components: list[np.ndarray]) -> bytes:
    """The bytes that write_avi() put into coefficients: the extra bits of size 8."""
    values = np.concatenate([c.reshape(len(c), -1) for c in components], axis=1)
    if (abs(values) > 255).any() or (abs(values) < 128).any():
        raise ValueError("the coefficients are no payload")
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


def histograms(components: list[np.ndarray], steps: np.ndarray) -> np.ndarray:
    """Histograms (frames x 16 for each component) of the samples: dequantised, inverse DCT, cut to 0..255."""
    out = []
    for values, step in zip(components, steps, strict=True):
        n = len(values)
        samples = (values.reshape(-1, 64).astype(np.float32) * step) @ KERNEL
        samples *= np.float32(1 / 4096)
        samples += 128
        bins = (np.clip(samples, 0, 255, out=samples) * np.float32(BINS / 256)).astype(np.int32).reshape(n, -1)
        bins += np.arange(n, dtype=np.int32)[:, None] * BINS
        out.append(np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS))
    return np.concatenate(out, axis=1)


def read_avi(data: bytes) -> tuple[int, bytes, np.ndarray]:
    """Microseconds a frame, the payload and the frames' histograms, read by the index."""
    micros, entries = index_of(data)
    payload, hist = [], []
    for components, steps in decoded(data, entries):
        payload.append(payload_of(components))
        hist.append(histograms(components, steps))
    return micros, b"".join(payload), np.concatenate(hist) if hist else np.zeros((0, BINS), np.int64)


def shots(hist: np.ndarray) -> list[int]:
    """First frames of the shots. A cut is where a frame's histogram differs from the one before by more than the mean and some
    deviations of the differences in the frames before it."""
    if not len(hist):
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(diff)])
    squares = np.concatenate([[0], np.cumsum(diff * diff)])
    at = np.arange(len(diff))
    lo = np.maximum(0, at - NEAR)
    n = np.maximum(1, at - lo)
    s, q = sums[at] - sums[lo], squares[at] - squares[lo]
    # diff > mean + DEVIATIONS * deviation, in whole numbers; the first frames have no such past
    over = n * diff - s
    cut = (at - lo >= 4) & (over > 0) & (over * over > DEVIATIONS**2 * (n * q - s * s))
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary AVI) of every whole text, null as empty; null ids stay null, repeated rows give equal rows.

    An empty table gives none; other columns are not carried on.
    """

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, data in rows:
            yield key, len(data or b""), write_avi(padded(data or b""))

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")), "doc_id long, n_bytes long, media binary", step)


def read_media(media: DataFrame) -> DataFrame:
    """For each row of store_media(): the payload read back and its clips as arrays (first frames, start and end in ms).

    Null media give nulls, and no frames and no clips; media of another writer, whose coefficients hold no payload, are an error.
    """

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, n_bytes, data in rows:
            if data is None:
                yield key, n_bytes, None, None, None, 0, [], [], []
                continue
            micros, payload, hist = read_avi(data)
            first = shots(hist)
            ends = [*first[1:], len(hist)]
            yield key, n_bytes, payload, len(data), hashlib.sha256(data).hexdigest(), len(hist), first, [f * micros // 1000 for f in first], [f * micros // 1000 for f in ends]

    return map_rows(media.select("doc_id", "n_bytes", "media"), "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, n_frames long, first array<long>, start_ms array<long>, end_ms array<long>", step)


def clips(read: DataFrame) -> DataFrame:
    """Timed clip rows of read_media(): doc_id, clip (from 0), start_ms, end_ms. Null media have none."""
    return read.select("doc_id", F.posexplode(F.arrays_zip("start_ms", "end_ms")).alias("clip", "at")).select("doc_id", "clip", "at.start_ms", "at.end_ms")
