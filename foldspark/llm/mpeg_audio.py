"""Media columns: MPEG audio.

``parse`` walks a stream of MPEG-1, 2 or 2.5 frames of the layers I, II and III: it
reads and skips ID3v2 and APE tags, resynchronises on frame headers (a header counts
only if another of the same kind, the end or a tag follows it), finds the length of
free-format frames, reads a Xing/Info or VBRI table with the encoder's delay and
padding, verifies checksums, and gives the exact duration and the byte offset of every
frame.  What looks like a tag at the end but lies inside a frame that ends where the
stream ends is no tag.  Protected frames whose bitrate no layer II table has are
counted as ``unchecked``.

``wrap`` stores any bytes losslessly as such a stream: silent frames (their side
information is zero) that carry the payload as ancillary data, protected by
checksums, behind an ID3v2 tag with the payload's length and a Xing table.  A last
frame without payload keeps payloads from looking like a tag at the end.

``store`` makes a column of such media, ``describe`` parses one, ``restore`` gives the
bytes back.  Columns named like what they make are replaced.  Empty media give no
frames and a duration of 0; null media count as empty.  Damaged bytes are skipped and
counted, never raised on; where the length of the payload can't be read, ``restore``
gives all that the frames carry.  Equal rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.bpe import slices
from foldspark.llm.common import materialised, ready, with_computed

# Fixed values of the format: kbit/s by index for MPEG-1 layers I, II, III and for MPEG-2 layer I and layers II and III, sampling rates, side information bytes.
_KBIT_1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
_LOW = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_KBIT_2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: _LOW, 3: _LOW}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SIDE = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}
# Layer II: bits of a subband's allocation as (bits, subbands) of the tables for 27, 30, 8 and 12 subbands of MPEG-1 and the one of MPEG-2.
_ALLOCATIONS = (((4, 11), (3, 12), (2, 4)), ((4, 11), (3, 12), (2, 7)), ((4, 2), (3, 6)), ((4, 2), (3, 10)), ((4, 4), (3, 7), (2, 19)))
# Text encodings of ID3v2 by their number.
_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")

BLOCK = 64
#: Bytes within which the next header of a free-format stream must follow.
FREE = 8192


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes, bits: int | None = None) -> int:
    """The frames' checksum, of the first ``bits`` or all: polynomial 0x8005, first value 0xFFFF."""
    c, whole = 0xFFFF, len(data) if bits is None else bits >> 3
    for b in data[:whole]:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    for k in range(0 if bits is None else bits & 7):
        out = c >> 15 ^ data[whole] >> (7 - k) & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if out else 0)
    return c


@dataclass(frozen=True)
class Header:
    mpeg1: bool
    layer: int
    rate: int
    kbit: int
    mono: bool
    protected: bool
    length: int
    samples: int
    pad: int = 0
    #: Bytes that the checksum covers behind the header; None for layer II, where the frame tells.
    covered: int | None = None
    #: First subband whose allocation both channels share.
    bound: int = 32

    @property
    def body(self) -> int:
        """Where what follows the header and its checksum begins."""
        return 6 if self.protected else 4

    @property
    def side(self) -> int:
        return _SIDE[self.mpeg1, self.mono] if self.layer == 3 else 0


def _layer2_bits(data: bytes, at: int, h: Header) -> int | None:
    """Bits behind the checksum of a layer II frame that it covers: the allocations, and 2 for each
    channel's subband that has one. None where the frame's bitrate has no table or it is too short."""
    each, channels = h.kbit // (1 if h.mono else 2), 1 if h.mono else 2
    if not h.kbit:
        return None
    if not h.mpeg1:
        which = 4
    elif each >= 56 and (h.rate == 48000 or each <= 80):
        which = 0
    elif each >= 96:
        which = 1
    else:
        which = 3 if h.rate == 32000 else 2
    bits = int.from_bytes(data[at + 6 : at + 38], "big")
    place = used = band = 0
    for width, n in _ALLOCATIONS[which]:
        for _ in range(n):
            shared = band >= h.bound
            for _ in range(1 if shared else channels):
                place += width
                if bits >> 256 - place & (1 << width) - 1:
                    used += channels if shared else 1
            band += 1
    return place + 2 * used if at + 6 + (place + 2 * used + 7 >> 3) <= len(data) and 6 + (place + 2 * used + 7 >> 3) <= h.length else None


_headers: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The header in four bytes, or None. A free-format frame has length 0."""
    if four in _headers:
        return _headers[four]
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    found = None
    if version != 1 and layer < 4 and index < 15 and rate < 3:
        one, mode = version == 3, four[3] >> 6
        kbit, hz, extra = (_KBIT_1 if one else _KBIT_2)[layer][index], _RATES[version][rate], four[2] >> 1 & 1
        samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
        if layer == 1:
            length, pad = (12 * kbit * 1000 // hz + extra) * 4, 4 * extra
        else:
            length, pad = samples // 8 * kbit * 1000 // hz + extra, extra
        bound = 4 + 4 * (four[3] >> 4 & 3) if mode == 1 else 32
        covered = _SIDE[one, mode == 3] if layer == 3 else None if layer == 2 else 16 if mode == 3 else 16 + bound // 2
        found = Header(one, layer, hz, kbit, mode == 3, not four[1] & 1, length if index else 0, samples, pad, covered, bound)
        if index and length < found.body + (covered or 0):
            found = None
    if len(_headers) < 4096:
        _headers[four] = found
    return found


def _alike(a: bytes, b: bytes) -> bool:
    """Whether two headers can be of one stream: same version, layer and rate, and both or neither of free format."""
    return len(a) == len(b) == 4 and (a[1] ^ b[1]) & 0xFE == 0 and (a[2] ^ b[2]) & 0x0C == 0 and (a[2] < 16) == (b[2] < 16) and header(b) is not None


@dataclass
class Audio:
    """What a stream holds. ``offsets`` are the frames' seek points, without a table frame."""

    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    heads: list[Header] = field(default_factory=list)
    rate: int = 0
    decoded: int = 0
    delay: int = 0
    padding: int = 0
    checked: int = 0
    broken: int = 0
    unchecked: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    table_seek: list[int] = field(default_factory=list)

    @property
    def samples(self) -> int:
        """Samples of sound: what frames decode to, less what the encoder added before and after."""
        return max(self.decoded - self.delay - self.padding, 0)

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, audio: Audio) -> int:
    """Reads text frames of a leading tag (versions 2.2 to 2.4); where audio begins."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0
    version, flags, size = data[3], data[5], _synchsafe(data[6:10])
    end = min(len(data), 10 + size + (10 if version >= 4 and flags & 0x10 else 0))
    tag = data[10 : min(len(data), 10 + size)]
    if flags & 0x80 and version < 4:
        tag = tag.replace(b"\xff\x00", b"\xff")
    at, wide = 0, version > 2
    if flags & 0x40 and wide and len(tag) >= 4:  # an extended header
        at = _synchsafe(tag[:4]) if version >= 4 else 4 + int.from_bytes(tag[:4], "big")
    head = 10 if wide else 6
    while at + head <= len(tag) and tag[at] != 0:
        if wide:
            kind, raw = tag[at : at + 4].decode("latin-1"), tag[at + 4 : at + 8]
            n, how = _synchsafe(raw) if version >= 4 else int.from_bytes(raw, "big"), tag[at + 9]
        else:
            kind, n, how = tag[at : at + 3].decode("latin-1"), int.from_bytes(tag[at + 3 : at + 6], "big"), 0
        body = tag[at + head : at + head + n]
        if version >= 4 and how & 1:  # its length comes first
            body = body[4:]
        if version >= 4 and (how & 2 or flags & 0x80):
            body = body.replace(b"\xff\x00", b"\xff")
        if kind[0] == "T" and len(body) > 1 and body[0] < 4 and not how & 0x0C:
            text = body[1:].decode(_ENCODINGS[body[0]], "replace")
            name, _, value = text.partition("\0") if kind in ("TXXX", "TXX") else (kind, "", text)
            audio.tags[name] = value.lstrip("\ufeff").rstrip("\0")
        at += head + n
    return end


def _tail_tags(data: bytes, start: int, audio: Audio) -> int:
    """Reads an ID3v1 tag and an APE tag before it; where audio ends."""
    end = len(data)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        audio.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        _, size, items, flags = struct.unpack_from("<IIII", data, end - 24)
        first = end - size
        if start <= first <= end - 32:
            at = first
            for _ in range(items):
                n, kind = struct.unpack_from("<II", data, at) if at + 8 <= end - 32 else (0, 2)
                stop = data.find(b"\0", at + 8, end - 32)
                if stop < 0 or stop + 1 + n > end - 32:
                    break
                if not kind & 6:
                    audio.tags.setdefault(data[at + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + n].decode("utf-8", "replace"))
                at = stop + 1 + n
            end = first - (32 if flags >> 31 and data[first - 32 : first - 24] == b"APETAGEX" else 0)
    return end


def _table(data: bytes, at: int, h: Header, audio: Audio) -> bool:
    """Reads the table of a variable-bitrate stream in its first frame."""
    mark = at + h.body + h.side
    if data[mark : mark + 4] in (b"Xing", b"Info"):
        audio.table, flags, p = data[mark : mark + 4].decode(), int.from_bytes(data[mark + 4 : mark + 8], "big"), mark + 8
        if flags & 1:
            audio.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            audio.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            audio.table_seek, p = list(data[p : p + 100]), p + 100
        p += 4 if flags & 8 else 0
        if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc", b"L3.9") and p + 24 <= at + h.length:
            both = int.from_bytes(data[p + 21 : p + 24], "big")
            audio.delay, audio.padding = both >> 12, both & 0xFFF
        return True
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        _, delay, _, audio.table_bytes, audio.table_frames, n, scale, width, _ = struct.unpack_from(">HHHIIHHHH", data, at + 40)
        audio.table, audio.delay = "VBRI", delay
        entries = data[at + 62 : at + 62 + n * width]
        audio.table_seek = [scale * int.from_bytes(entries[i : i + width], "big") for i in range(0, len(entries) - width + 1, width)] if width else []
        return True
    return False


def _distance(data: bytes, at: int, h: Header, end: int) -> int:
    """Length without padding of a free-format frame: to the next header that another, or the end, follows as far away; 0 if there is none."""
    four, low = data[at : at + 4], at + h.body + max(h.side, h.covered or 0) + 1
    while (after := data.find(b"\xff", low, min(end, at + FREE))) >= 0:
        n = after - at - h.pad
        if _alike(four, data[after : after + 4]):
            third = after + n + (header(data[after : after + 4]).pad)
            if third == end or _alike(four, data[third : third + 4]):
                return n
        low = after + 1
    return 0


def parse(data: bytes | None) -> Audio:
    audio = Audio()
    data = data or b""
    at = _id3v2(data, audio)
    leading = dict(audio.tags)
    end, synced = _tail_tags(data, at, audio), False
    first, free = True, 0
    while at < end:
        four = data[at : at + 4]
        h = header(four)
        length = h.length if h else 0
        if h and not length:
            # Free format: all frames have the distance to the next header, but for padding.
            if not free:
                free = _distance(data, at, h, end)
            length = free + h.pad if free else 0
        if length and synced and end < at + length == len(data):
            # The stream ends with this frame, so what looked like a tag is inside it.
            end, audio.tags = len(data), leading
        if not length or at + length > end or not (synced or at + length == end or _alike(four, data[at + length : at + length + 4])):
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            audio.skipped += following - at
            at, synced, free = following, False, 0
            continue
        synced = True
        if h.protected:
            bits = _layer2_bits(data, at, h) if h.covered is None else 8 * h.covered
            if bits is None:
                audio.unchecked += 1
            else:
                good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 7 + (bits >> 3)], 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")
                audio.checked += good
                audio.broken += not good
        if not (first and h.layer == 3 and _table(data, at, h, audio)):
            audio.offsets.append(at)
            audio.sizes.append(length)
            audio.heads.append(h)
            audio.decoded += h.samples
        audio.rate, first = audio.rate or h.rate, False
        at += length
    return audio


def _frame(index: int, body: bytes, length: int) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))  # MPEG-1 Layer III, protected, 32 kHz, mono
    side = bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side + body.ljust(length - 23, b"\0")


_LENGTHS = {i: 144 * k * 1000 // 32000 for i, k in enumerate(_KBIT_1[3]) if i}
_WIDE = max(_LENGTHS)


def wrap(payload: bytes) -> bytes:
    """The payload as a stream: whole frames at 320 kbit/s, one at the smallest bitrate that holds the rest, and an empty one."""
    room = _LENGTHS[_WIDE] - 23
    frames, at = [], 0
    while at < len(payload):
        rest = len(payload) - at
        index = _WIDE if rest >= room else next(i for i, n in _LENGTHS.items() if n - 23 >= rest)
        frames.append(_frame(index, payload[at : at + _LENGTHS[index] - 23], _LENGTHS[index]))
        at += _LENGTHS[index] - 23
    frames.append(_frame(1, b"", _LENGTHS[1]))
    sizes = [len(f) for f in frames]
    table_len, total = _LENGTHS[5], 0
    total = table_len + sum(sizes)
    seek = bytearray()
    for k in range(100):
        i = k * len(frames) // 100
        seek.append(min(255, 256 * (table_len + sum(sizes[:i]) if len(sizes) < 200 else table_len + i * _LENGTHS[_WIDE]) // total))
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(seek)
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text  # under 128 bytes: synchsafe as it is
    return b"ID3\x04\0\0" + len(tag).to_bytes(4, "big") + tag + _frame(5, table, table_len) + b"".join(frames)


def unwrap(media: bytes, audio: Audio | None = None) -> bytes:
    """The payload that :func:`wrap` stored, from the parsed frames."""
    audio = audio or parse(media)
    parts = [media[o + h.body + h.side : o + n] for o, n, h in zip(audio.offsets, audio.sizes, audio.heads)]
    told = audio.tags.get("payload_bytes", "0")
    carried = b"".join(parts)
    return carried[: int(told)] if re.fullmatch("[0-9]{1,18}", told) else carried


def padded(text: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


_FIELDS = "seconds double, samples long, sample_rate int, layer int, n_frames long, checked long, broken long, unchecked long, skipped_bytes long, table string, table_frames long, delay int, padding int, offsets array<long>, tags map<string,string>"


def _told(a: Audio) -> tuple:
    layer = a.heads[0].layer if a.heads else None
    return a.seconds, a.samples, a.rate, layer, len(a.offsets), a.checked, a.broken, a.unchecked, a.skipped, a.table, a.table_frames, a.delay, a.padding, a.offsets, list(a.tags.items())


def _kinds(fields: str) -> list[pa.DataType]:
    of = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return [of[f.split(" ", 1)[1]] for f in fields.split(", ")]


def _mapped(df: DataFrame, column: str, fields: str, make) -> DataFrame:
    """Adds what ``make`` gives (a tuple of the fields) for the bytes or text in ``column``."""
    ready(df.sparkSession)

    def start():
        import pyarrow.compute as pc

        kinds = _kinds(fields)

        def apply(values: pa.Array) -> Iterator[list[pa.Array]]:
            for i, j in slices([x or 0 for x in pc.binary_length(values).to_pylist()], 1 << 22):
                yield [pa.array(c, k) for c, k in zip(zip(*map(make, values.slice(i, j - i).to_pylist())), kinds)]

        return apply

    return with_computed(df, column, fields, start)


def describe(df: DataFrame, media: str = "media", out: str = "audio") -> DataFrame:
    """Adds the struct ``out`` with what each MPEG audio stream in the binary column holds."""
    names = [f"_{out}_{f.split()[0]}" for f in _FIELDS.split(", ")]
    made = _mapped(df.drop(out), media, ", ".join(f"_{out}_{f}" for f in _FIELDS.split(", ")), lambda data: _told(parse(data)))
    return made.select(*(F.col(f"`{c}`") for c in df.drop(out).columns), F.struct(*(F.col(f"`{n}`").alias(n[len(out) + 2 :]) for n in names)).alias(out))


def store(df: DataFrame, content: str = "content", out: str = "media") -> DataFrame:
    """Adds the binary column ``out``: the bytes in ``content`` (null: none) as an MPEG audio stream."""
    return _mapped(df, content, f"{out} binary", lambda b: (wrap(b or b""),))


def restore(df: DataFrame, media: str = "media", out: str = "content") -> DataFrame:
    """Adds the binary column ``out``: the bytes that :func:`store` put into ``media``."""
    return _mapped(df, media, f"{out} binary", lambda b: (unwrap(b or b""),))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document: each text is stored in a column of media, written to
    files in the shared folder, and everything that is returned comes from the files read back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = rows.select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("content"))
    sized = raw.withColumn("n_bytes", F.length("content").cast("long"))
    padded_ = F.when(F.col("n_bytes") == 0, F.lit(bytes(BLOCK))).otherwise(F.concat("content", F.substring(F.lit(bytes(BLOCK)), 1, F.pmod(-F.col("n_bytes"), F.lit(BLOCK)).cast("int"))))
    media = materialised(store(sized.withColumn("content", padded_)).drop("content"))
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, n_frames long, skipped_bytes long, seek_offsets array<long>"

    def read(stored: bytes) -> tuple:
        a = parse(stored)
        back = unwrap(stored, a)
        feature = f"MPEG-1 Layer III {a.rate} Hz mono;frames={len(a.offsets)};table={a.table_frames};seconds={a.seconds:.3f};crc_ok={a.checked};crc_bad={a.broken};last_seek={a.offsets[-1] if a.offsets else None}"
        return len(back), sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), sha256(stored).hexdigest(), feature, a.seconds, len(a.offsets), a.skipped, a.offsets

    return _mapped(media, "media", fields, read).drop("media")
