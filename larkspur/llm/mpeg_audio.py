"""MPEG audio as a binary column: write payloads into frames, scan streams.

The scanner reads ID3v2 and ID3v1 tags, resynchronises on frame headers (a
header counts only if the stream ends or goes on with a compatible header
where its frame ends), reads Xing/Info and VBRI tables, verifies the 16-bit
checksums of Layer III frames, and gives the exact duration as samples over
the sample rate and the byte offset of every frame. Free-format streams
(bitrate index 0) hold no frames for it. Checksums of Layers I and II cover
other bits and are counted as not checked.

Payloads are stored without loss as one byte for each of a frame's 576
samples: MPEG-2 Layer III, mono, 16 kHz, 144 kbit/s. Such a frame is a header,
a checksum, side information that declares no audio bits (so that a player
plays silence), and 576 payload bytes as ancillary data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
UNIT = 576


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_parsed: dict[int, Header | None] = {}


def header(data, at: int) -> Header | None:
    """The frame header at a place, or None."""
    if at + 4 > len(data):
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    if word not in _parsed:
        if len(_parsed) > 4096:
            _parsed.clear()
        _parsed[word] = _parse(word)
    return _parsed[word]


def _parse(word: int) -> Header | None:
    if word >> 21 != 0x7FF:
        return None
    version = {0: 25, 2: 2, 3: 1}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    index, rate_index, padding = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3 or word & 3 == 2:
        return None
    family = 1 if version == 1 else 2
    bitrate, rate, samples = BITRATES[family, layer][index - 1], RATES[version][rate_index], SAMPLES[family, layer]
    if layer == 1:
        size = (12_000 * bitrate // rate + padding) * 4
    else:
        size = samples // 8 * 1000 * bitrate // rate + padding
    return Header(version, layer, not word >> 16 & 1, bitrate, rate, word >> 6 & 3 == 3, size, samples)


def _crc_table() -> np.ndarray:
    v = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        v = np.where(v & 0x8000, v << 1 ^ 0x8005, v << 1) & 0xFFFF
    return v.astype(np.uint16)


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksums of rows of bytes."""
    crc = np.full(len(rows), 0xFFFF, dtype=np.uint16)
    for i in range(rows.shape[1]):
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ rows[:, i]]
    return crc


# -- writing

_HEAD = bytes([0xFF, 0xF2, 0xD8, 0xC0])  # MPEG-2, Layer III, checksum, 144 kbit/s, 16 kHz, mono
_TABLE_HEAD = bytes([0xFF, 0xF3, 0x48, 0xC0])  # 32 kbit/s, no checksum: the frame of the Xing table
_FRAME, _TABLE_FRAME = _parse(int.from_bytes(_HEAD, "big")), _parse(int.from_bytes(_TABLE_HEAD, "big"))
_BEFORE = np.frombuffer(_HEAD + int(crc16(np.frombuffer(_HEAD[2:] + bytes(9), dtype=np.uint8)[None])[0]).to_bytes(2, "big") + bytes(9), dtype=np.uint8)


def padded(text: bytes) -> bytes:
    """A text's bytes with bytes 255 up to a positive multiple of 576."""
    return bytes(text) + b"\xff" * (-len(text) % UNIT or (0 if len(text) else UNIT))


def _safe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _id3(n_bytes: int) -> bytes:
    body = b"\x00n_bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body
    return b"ID3\x03\x00\x00" + _safe(len(frame)) + frame


def write(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds a payload; its length is a positive multiple of 576."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 576 bytes")
    n = len(payload) // UNIT
    frames = np.zeros((n, _FRAME.size), dtype=np.uint8)
    frames[:, : len(_BEFORE)] = _BEFORE
    frames[:, len(_BEFORE) : len(_BEFORE) + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    total = _TABLE_FRAME.size + frames.size
    first = _TABLE_FRAME.size / total
    toc = bytes(min(255, int(256 * (first + (1 - first) * i / 100))) for i in range(100))
    table = _TABLE_HEAD + bytes(9) + b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return b"".join((_id3(n_bytes), table.ljust(_TABLE_FRAME.size, b"\x00"), frames.tobytes()))


# -- reading


@dataclass
class Stream:
    offsets: np.ndarray  # of audio frames; a frame that holds a table is none
    samples: int = 0
    rate: int = 0
    checked: int = 0  # checksums
    wrong: int = 0
    skipped: int = 0  # bytes that belong to no frame or tag
    table: dict = field(default_factory=dict)  # kind, frames, bytes, toc
    tags: dict = field(default_factory=dict)
    payload: bytes = b""  # 576 ancillary bytes of each frame that can hold them

    @property
    def seconds(self) -> tuple[int, int]:
        """The exact duration as a fraction in lowest terms."""
        g = int(np.gcd(self.samples, self.rate)) or 1
        return self.samples // g, max(1, self.rate // g)


def _read_id3(data: bytes) -> tuple[int, dict]:
    """Length of an ID3v2 tag at the start, and its TXXX frames."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0, {}
    unsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, tags = 10 + unsafe(data[6:10]), 10, {}
    while at + 10 <= min(end, len(data)) and data[at]:
        size = unsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if size <= 0 or at + 10 + size > end:
            break
        if data[at : at + 4] == b"TXXX" and data[at + 10] in (0, 3):
            name, _, value = data[at + 11 : at + 10 + size].partition(b"\x00")
            tags[name.decode("latin-1")] = value.rstrip(b"\x00").decode("utf-8" if data[at + 10] == 3 else "latin-1", "replace")
        at += 10 + size
    return min(end + 10 * bool(data[5] & 16), len(data)), tags


def _read_table(frame: bytes, h: Header) -> dict:
    at = 4 + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, where, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
            if flags & bit:
                part, where = frame[where : where + size], where + size
                out[name] = list(part) if name == "toc" else int.from_bytes(part, "big")
        return out
    if frame[36:40] == b"VBRI":
        number = lambda i, n: int.from_bytes(frame[36 + i : 36 + i + n], "big")
        entries, scale, width = number(18, 2), number(20, 2), number(22, 2)
        return {"kind": "VBRI", "bytes": number(10, 4), "frames": number(14, 4), "toc": [number(26 + i * width, width) * scale for i in range(entries) if 62 + (i + 1) * width <= len(frame)]}
    return {}


def _alike(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _next_sync(data: bytes, view: np.ndarray, at: int, end: int) -> int:
    """The next place with a header that the stream confirms, or end."""
    while at < end - 3:
        found = data.find(b"\xff", at, end - 3)
        if found < 0:
            return end
        h = header(data, found)
        if h and found + h.size <= end and (found + h.size == end or _alike(h, header(data, found + h.size))):
            return found
        at = found + 1
        if not h and data[at : at + 64] == b"\xff" * 64:  # a long run of bytes 255 holds no header
            other = np.flatnonzero(view[at:end] != 255)
            at = max(at, (at + int(other[0]) if len(other) else end) - 1)
    return end


def _runs(data: bytes, view: np.ndarray, start: int, end: int, out: Stream) -> list[tuple[int, int, Header]]:
    """First place, frames and header of each run of equal headers; the table and the skipped bytes go to out."""
    runs: list[tuple[int, int, Header]] = []
    at = start
    while at < end:
        h = header(data, at)
        if not (h and at + h.size <= end):
            found = _next_sync(data, view, at + 1, end)
            out.skipped += found - at
            at = found
            continue
        if not runs and not out.table and (table := _read_table(data[at : at + h.size], h)):
            out.table, at = table, at + h.size
            continue
        k, most = 1, (end - at) // h.size
        if most > 1:  # a run of equal headers, at once
            words = view[at : at + most * h.size].reshape(most, h.size)[:, :4]
            same = (words == words[0]).all(axis=1)
            k = most if same.all() else int(np.argmin(same))
        runs.append((at, k, h))
        at += k * h.size
    return runs


def _covered(data: bytes, runs: list[tuple[int, int, Header]], place: int) -> bool:
    """Whether a frame lies over a place, and the stream ends or goes on with a compatible header after it."""
    for at, k, h in runs:
        if at <= place < at + k * h.size:
            after = at + ((place - at) // h.size + 1) * h.size
            return after == len(data) or _alike(h, header(data, after))
    return False


def scan(data: bytes) -> Stream:
    """All of a stream's frames. Bytes without a frame give a stream of no samples."""
    view = np.frombuffer(data, dtype=np.uint8)
    start, tags = _read_id3(data)
    end = len(data)
    out = Stream(np.empty(0, dtype=np.int64), tags=tags)
    runs = _runs(data, view, start, end, out)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG" and not _covered(data, runs, end - 128):
        end -= 128
        tags["id3v1_title"] = data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
        out = Stream(np.empty(0, dtype=np.int64), tags=tags)
        runs = _runs(data, view, start, end, out)
    offsets, payload = [], []
    for at, k, h in runs:
        frames = view[at : at + k * h.size].reshape(k, h.size)
        offsets.append(at + np.arange(k, dtype=np.int64) * h.size)
        out.samples += k * h.samples
        out.rate = out.rate or h.rate
        head = 4 + 2 * h.protected + h.side
        if h.layer == 3 and h.protected and h.size >= head:
            told = frames[:, 4].astype(np.uint16) << np.uint16(8) | frames[:, 5]
            out.checked += k
            out.wrong += int((crc16(np.concatenate((frames[:, 2:4], frames[:, 6:head]), axis=1)) != told).sum())
        if h.layer == 3 and h.size >= head + UNIT:
            payload.append(frames[:, head : head + UNIT].tobytes())
    out.offsets = np.concatenate(offsets) if offsets else out.offsets
    out.payload = b"".join(payload)
    return out


def seek(stream: Stream, sample: int) -> int:
    """The byte offset of the frame that holds a sample."""
    each = stream.samples // max(1, len(stream.offsets))
    if not len(stream.offsets) or not 0 <= sample < stream.samples:
        raise IndexError("no such sample")
    return int(stream.offsets[sample // each])
