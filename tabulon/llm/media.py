"""MPEG audio columns: multiplex payloads into Layer III streams, and parse such streams back.

``store_audio`` writes a payload as a standard stream: an ID3v2.4 tag, a ``Xing`` frame with the table of the variable
bit rate, silent MPEG-1 Layer III frames with CRC protection that carry the payload as ancillary data, an ID3v1 tag.
``read_audio`` takes any MPEG audio: it skips or parses tags, resynchronises on frame headers, reads the table of the
variable bit rate, verifies the frames' checksums and the table's own two, and gives exact durations, every frame's offset
and a short table of ``SEEK_POINTS`` of them.

Null or empty input: a null or empty payload is stored as 64 zero bytes; null or empty audio parses to a result with no
frames. Bytes between frames are skipped and counted in ``skipped_bytes``; a cut last frame counts as skipped too.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.bytesops import crc32, documents_of, small_batches, utf8

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 64
RATE = 48000
SIDE_INFO = 17
OVERHEAD = 4 + 2 + SIDE_INFO
OWNER = b"tabulon.payload\0"
SEEK_POINTS = 16


# ---- checksums ----


@lru_cache(4096)
def _crc_frame(protected: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005, most significant bit first, start 0xFFFF: the frames' own checksum, over the first ``bits``."""
    crc = 0xFFFF
    for k in range(8 * len(protected) if bits is None else bits):
        one = crc >> 15 ^ protected[k >> 3] >> (7 - (k & 7)) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if one else 0)
    return crc


# Fixed values of ISO/IEC 11172-3 and 13818-3: (subbands, bits of an allocation) by Layer II table.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


def _protected_bits(head: bytes, body: bytes) -> int:
    """How many bits after the checksum it covers in Layers I and II: the bit allocation and, in Layer II, what selects scale factors."""
    version, layer, mode = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[3] >> 6
    channels = 1 if mode == 3 else 2
    shared = 4 * ((head[3] >> 4 & 3) + 1) if mode == 1 else 32  # from this subband on, joint stereo has one allocation for both
    if layer == 1:
        return 4 * sum(1 if channels == 1 or sb >= shared else 2 for sb in range(32))
    hertz, kbps = SAMPLE_RATES[version][head[2] >> 2 & 3], BITRATES[version == 3, 2][head[2] >> 4] // channels
    low, high = ("d" if hertz == 32000 else "c"), ("a" if hertz == 48000 else "b")
    name = "lsf" if version != 3 else low if kbps <= 48 else "a" if kbps <= 80 else high
    value, at, chosen = int.from_bytes(body[:128].ljust(128, b"\0"), "big"), 0, 0
    widths = [w for n, w in ALLOCATIONS[name] for _ in range(n)]
    for sb, width in enumerate(widths):
        for _ in range(1 if channels == 1 or sb >= shared else 2):
            used = value >> (1024 - at - width) & (1 << width) - 1
            chosen += bool(used) * (channels if sb >= shared else 1)
            at += width
    return at + 2 * chosen


ROW = 256


@cache
def _crc_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """For the reflected CRC-16 from 0: each byte value's share by its place in a row, and the maps over 256 * 2**k more bytes."""
    step = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ 0xA001, step >> 1).astype(np.uint16)
    shares = np.empty((ROW, 256), np.uint16)
    shares[ROW - 1] = step
    for place in range(ROW - 2, -1, -1):
        below = shares[place + 1]
        shares[place] = below >> 8 ^ step[below & 0xFF]
    every = np.arange(1 << 16, dtype=np.uint16)
    one = (every >> 8 ^ step[every & 0xFF]).astype(np.uint16)
    for _ in range(8):
        one = one[one]
    maps = [one]
    while len(maps) < 32:
        maps.append(maps[-1][maps[-1]])
    return shares, maps


def crc16(data: bytes) -> int:
    """CRC-16 with the reflected polynomial 0xA001 from 0: the checksum of the table frame and of all audio."""
    if not data:
        return 0
    shares, maps = _crc_tables()
    raw = np.frombuffer(data, np.uint8)
    rows = -(-len(raw) // ROW)
    padded = np.zeros(rows * ROW, np.uint8)
    padded[len(padded) - len(raw):] = raw  # zeros in front don't change a CRC from 0
    rows_of = padded.reshape(rows, ROW)
    crcs = np.zeros(rows, np.uint16)
    for at in range(0, rows, 1024):
        block = rows_of[at:at + 1024]
        crcs[at:at + 1024] = np.bitwise_xor.reduce(shares[np.arange(ROW), block], axis=1)
    level = 0
    while len(crcs) > 1:
        if len(crcs) % 2:
            crcs = np.concatenate([np.zeros(1, np.uint16), crcs])
        crcs = maps[level][crcs[0::2]] ^ crcs[1::2]
        level += 1
    return int(crcs[0])


# ---- writing ----


@cache
def _header(kbps: int, protected: bool) -> bytes:
    index = BITRATES[True, 3].index(kbps)
    return bytes([0xFF, 0xFB - protected, index << 4 | 1 << 2, 0xC0])


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _id3v2(payload_len: int) -> bytes:
    private = OWNER + struct.pack(">Q", payload_len)
    encoder = b"\x03tabulon"
    frames = b"".join(name + _synchsafe(len(body)) + b"\0\0" + body for name, body in ((b"TSSE", encoder), (b"PRIV", private)))
    return b"ID3\x04\0\0" + _synchsafe(len(frames)) + frames


def mux(payload: bytes) -> bytes:
    """A stream of MPEG-1 Layer III frames (mono, 48 kHz) that carries ``payload``."""
    body, frame_bytes = [], 0
    room = 3 * 320 - OVERHEAD
    sizes = []
    for at in range(0, len(payload), room):
        part = payload[at:at + room]
        kbps = 320 if len(part) == room else next(k for k in BITRATES[True, 3][1:] if 3 * k - OVERHEAD >= len(part))
        head = _header(kbps, True)
        side = bytes(SIDE_INFO)
        crc = _crc_frame(head[2:] + side)
        frame = head + crc.to_bytes(2, "big") + side + part
        body.append(frame.ljust(3 * kbps, b"\0"))
        sizes.append(3 * kbps)
    audio = b"".join(body)
    first = 192  # bytes of the table's frame, at 64 kbit/s
    frame_bytes = first + len(audio)
    starts = first + np.concatenate([[0], np.cumsum(sizes)])
    toc = bytes(min(255, int(256 * starts[min(len(sizes), i * len(sizes) // 100)] / frame_bytes)) for i in range(100))
    info = _header(64, False) + bytes(SIDE_INFO) + b"Xing" + struct.pack(">III", 0xF, len(sizes), frame_bytes) + toc + struct.pack(">I", 0)
    lame = b"tabulon00" + bytes([0x01, 0]) + bytes(4 + 2 + 2) + bytes([0, 0]) + bytes(3) + bytes([0, 0]) + bytes(2)
    lame += struct.pack(">I", frame_bytes) + struct.pack(">H", crc16(audio))
    info = (info + lame).ljust(190, b"\0")
    info += struct.pack(">H", crc16(info))
    id3v1 = b"TAG" + b"payload".ljust(30, b"\0") + bytes(30 + 30 + 4 + 30) + b"\xff"
    return _id3v2(len(payload)) + info + audio + id3v1


# ---- reading ----


@dataclass
class Parsed:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    skipped: int = 0
    vbr: str | None = None
    vbr_frames: int = -1
    vbr_bytes: int = -1
    table_crc_ok: bool | None = None
    music_crc_ok: bool | None = None
    tags: dict[str, str] = field(default_factory=dict)
    payload_len: int = -1
    offsets: list[int] = field(default_factory=list)
    kbit: float = 0.0
    parts: list[bytes] = field(default_factory=list)


@lru_cache(65536)
def _decode(head: bytes) -> tuple[int, int, int, int, bool] | None:
    """(frame bytes, samples, Hz, side-info bytes, protected) of a four-byte header, None if it is none."""
    if head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or head[3] & 3 == 2:
        return None
    kbps, hertz, pad = BITRATES[version == 3, layer][index], SAMPLE_RATES[version][rate], head[2] >> 1 & 1
    if layer == 1:
        size, samples = (12000 * kbps // hertz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        size = samples // 8 * 1000 * kbps // hertz + pad
    mono = head[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return size, samples, hertz, side, not head[1] & 1


def _tags(data: bytes, out: Parsed) -> tuple[int, int]:
    """Parse ID3v2 in front, ID3v1 and APEv2 at the end; where audio begins and ends."""
    at, end = 0, len(data)
    while data[at:at + 3] == b"ID3" and at + 10 <= end:
        major, flags = data[at + 3], data[at + 5]
        size = sum((b & 0x7F) << s for b, s in zip(data[at + 6:at + 10], (21, 14, 7, 0), strict=False))
        stop, p = min(end, at + 10 + size), at + 10
        if flags & 0x40 and p + 4 <= stop:
            ext = sum((b & 0x7F) << s for b, s in zip(data[p:p + 4], (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(data[p:p + 4], "big") + 4
            p += max(4, ext)
        while major in (3, 4) and p + 10 <= stop and data[p] != 0:
            name, raw = data[p:p + 4], data[p + 4:p + 8]
            n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
            body = data[p + 10:min(stop, p + 10 + n)]
            if name == b"PRIV" and body.startswith(OWNER) and len(body) == len(OWNER) + 8:
                out.payload_len = struct.unpack(">Q", body[len(OWNER):])[0]
            elif name[:1] == b"T" and body:
                codec = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)]
                out.tags[name.decode("latin-1")] = body[1:].decode(codec, "replace").rstrip("\0")
            p += 10 + n
        at = stop + (10 if flags & 0x10 else 0)
    if end - at >= 128 and data[end - 128:end - 125] == b"TAG":
        end -= 128
        if title := data[end + 3:end + 33].rstrip(b"\0 ").decode("latin-1"):
            out.tags.setdefault("TIT2", title)
    if end - at >= 32 and data[end - 32:end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20:end - 16], "little")
        out.tags.setdefault("APE", str(int.from_bytes(data[end - 16:end - 12], "little")))
        end -= size + (32 if data[end - 9] & 0x80 else 0) if size + 32 <= end - at else 32
    at = min(at, len(data))
    return at, max(end, at)


def _vbr(data: bytes, at: int, size: int, side: int, protected: bool, out: Parsed) -> bool:
    """Whether the frame at ``at`` is a table of a variable bit rate; its figures go to ``out``."""
    for skip in dict.fromkeys((4 + side, 4 + side + 2 * protected)):
        mark = data[at + skip:at + skip + 4]
        if mark in (b"Xing", b"Info"):
            out.vbr, p = mark.decode(), at + skip + 8
            flags = int.from_bytes(data[p - 4:p], "big")
            if flags & 1:
                out.vbr_frames, p = int.from_bytes(data[p:p + 4], "big"), p + 4
            if flags & 2:
                out.vbr_bytes, p = int.from_bytes(data[p:p + 4], "big"), p + 4
            p += (100 if flags & 4 else 0) + (4 if flags & 8 else 0)
            if p + 36 <= at + size and any(data[p:p + 9]):
                length, music, own = struct.unpack(">IHH", data[p + 28:p + 36])
                held = data[at + 190:at + 192] if size >= 192 else b""
                own = int.from_bytes(held, "big") if p + 36 > at + 190 or own == 0 and len(held) == 2 else own
                out.table_crc_ok = crc16(data[at:at + 190]) == own
                out.music_crc_ok = crc16(data[at + size:at + length]) == music if length >= size else None
            return True
    mark = data[at + 36:at + 40]
    if mark == b"VBRI" and at + 54 <= len(data):
        out.vbr = "VBRI"
        out.vbr_bytes, out.vbr_frames = struct.unpack(">II", data[at + 46:at + 54])
        return True
    return False


def parse(data: bytes | None, payload: bool = False) -> Parsed:
    """Walk a stream frame by frame; with ``payload``, also gather what frames hold after their side information."""
    out = Parsed()
    data = data or b""
    at, end = _tags(data, out)
    locked = False
    while at + 4 <= end:
        found = _decode(data[at:at + 4])
        size = found[0] if found else 0
        ok = found is not None and at + size <= end
        if ok and not locked:  # the next header must confirm the first one after a gap
            ok = at + size == end or _decode(data[at + size:at + size + 4].ljust(4, b"\0")) is not None
        if not ok:
            locked = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        locked = True
        _, samples, hertz, side, protected = found
        if out.frames == 0 and out.vbr is None and _vbr(data, at, size, side, protected, out):
            at += size
            continue
        if protected:
            out.crc_checked += 1
            head = data[at:at + 4]
            if side:
                own = _crc_frame(head[2:] + data[at + 6:at + 6 + side])
            else:
                bits = _protected_bits(head, data[at + 6:at + size])
                own = _crc_frame(head[2:] + data[at + 6:at + size][: -(-bits // 8)].ljust(-(-bits // 8), b"\0"), 16 + bits)
            out.crc_bad += own != int.from_bytes(data[at + 4:at + 6], "big")
        if payload:
            out.parts.append(data[at + 4 + 2 * protected + side:at + size])
        out.offsets.append(at)
        out.frames += 1
        out.samples += samples
        out.rate = hertz
        out.kbit += 8 * size / 1000
        at += size
    out.skipped += max(0, end - at)
    return out


AUDIO = (
    "frames long, samples long, sample_rate int, duration_s double, mean_kbps double, crc_checked long, crc_bad long, skipped_bytes long, "
    "vbr_table string, vbr_frames long, table_crc_ok boolean, music_crc_ok boolean, tags map<string,string>, seek_offsets array<long>, frame_offsets array<long>, payload binary"
)


def _row(data: bytes | None, payload: bool) -> tuple:
    p = parse(data, payload)
    seconds = p.samples / p.rate if p.rate else 0.0
    points = sorted({p.offsets[i * p.frames // SEEK_POINTS] for i in range(SEEK_POINTS)}) if p.frames else []
    held = b"".join(p.parts)[: p.payload_len if p.payload_len >= 0 else None] if payload else None
    return (
        p.frames, p.samples, p.rate, seconds, p.kbit / seconds if seconds else 0.0, p.crc_checked, p.crc_bad, p.skipped,
        p.vbr, p.vbr_frames, p.table_crc_ok, p.music_crc_ok, p.tags, points, p.offsets, held,
    )


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of ``text`` and zeros up to a positive multiple of 64."""
    raw = utf8(text)
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def store_audio(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each whole text as an MPEG stream; other columns are dropped, a null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [padded(t) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "n_bytes": [n for n, _ in rows], "media": [mux(p) for _, p in rows]})

    source = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return source.mapInPandas(run, "k long, n_bytes long, media binary").withColumnRenamed("k", key)


def read_audio(df: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """``df`` and the struct column ``audio``: what parsing each value of ``media`` gives (see ``AUDIO``)."""

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in AUDIO.split(', '))}>".replace("map<string:string>", "map<string,string>"))
    def parsed(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(v, payload) for v in values], columns=[x.split(" ")[0] for x in AUDIO.split(", ")])

    return df.withColumn("audio", parsed(F.col(media)))


def op1_media(docs: DataFrame) -> DataFrame:
    """The digest of every text's stored stream: see ``store_audio`` and ``read_audio``.

    A null or empty text gives 64 zero bytes of payload; repeated rows give repeated results; extra columns and rows without doc_id are ignored.
    """
    small_batches(docs.sparkSession)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for media in b["media"]:
                p = parse(media, payload=True)
                data = b"".join(p.parts)[: p.payload_len]
                sha = hashlib.sha256(data).hexdigest()
                ok = p.crc_bad == 0 and p.skipped == 0 and bool(p.table_crc_ok) and bool(p.music_crc_ok) and p.vbr_frames == p.frames
                seek = crc32(np.asarray(p.offsets, "<u8").tobytes())
                feature = f"frames={p.frames};samples={p.samples};rate={p.rate};kbit={p.kbit:.3f};ok={int(ok)};seek={seek:08x}"
                rows.append((len(data), sha, crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, p.frames, p.samples / p.rate, p.offsets))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "duration_s", "frame_offsets"]
            yield pd.concat([b[["doc_id", "n_bytes"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, duration_s double, frame_offsets array<long>"
    return store_audio(documents_of(docs)).mapInPandas(digest, schema)
