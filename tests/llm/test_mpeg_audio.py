import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foldspark.llm import mpeg_audio as m


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1417, 1418, 5000, 200_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = m.wrap(payload)
    a = m.parse(media)
    assert m.unwrap(media) == payload
    assert a.broken == 0 and a.skipped == 0 and a.checked == len(a.offsets) + 1 and a.table_frames == len(a.offsets)
    tag = 10 + int.from_bytes(media[6:10], "big")
    assert a.table_bytes == len(media) - tag and len(a.table_seek) == 100 and a.tags["payload_bytes"] == str(n)
    assert a.seconds == pytest.approx(len(a.offsets) * 1152 / 32000)


@pytest.mark.parametrize("mark", [b"TAG", b"APETAGEX", b"APETAGEX" + (2000).to_bytes(4, "little") + (160).to_bytes(4, "little") + bytes(16)])
def test_payloads_that_look_like_tags(mark):
    for n in range(64, 2049, 64):
        for at in range(0, n - len(mark) + 1, 1 if n < 400 else 7):
            payload = bytes(at) + mark + bytes(n - at - len(mark))
            assert m.unwrap(m.wrap(payload)) == payload, (n, at)
    # Other encoders have no empty frame at the end: frames that reach the end hold no tag.
    for at in range(30, 417 - len(mark)):
        last = (bytes((0xFF, 0xFB, 0x90, 0xC0)) + bytes(at - 4) + mark).ljust(417, b"\0")
        a = m.parse(b"".join(frames(0xFB, 0x90, 3, 417)) + last)
        assert len(a.offsets) == 4 and not a.tags and not a.skipped


def test_damaged_media_never_raise():
    rng = random.Random(8)
    whole = m.wrap(rng.randbytes(3000))
    tagged = b"".join(frames(0xFC, 0xA4, 4, 576, 0)) + b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16) + b"TAG".ljust(128, b"x")
    for k in range(10_000):
        hurt = bytearray(whole if k % 3 else tagged)
        for _ in range(rng.randrange(1, 6)):
            hurt[rng.randrange(len(hurt) if k % 2 else 200)] = rng.randrange(256)
        cut = bytes(hurt[: rng.randrange(len(hurt))]) if k % 5 == 0 else bytes(hurt)
        m._told(m.parse(cut))
        m.unwrap(cut)
    lost = whole.replace(b"payload_bytes\x003000", b"payload_bytes\x003s00")
    assert m.unwrap(lost)[:3000] == m.unwrap(whole) and set(m.unwrap(lost)[3000:]) == {0}


def _slow_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 ^ (0x8005 if c >> 15 ^ b else 0)) & 0xFFFF
    return c


@pytest.mark.parametrize("second, third, fourth, widths", [
    (0xFC, 0xA4, 0x00, [4] * 11 + [3] * 12 + [2] * 4), (0xFC, 0xE0, 0x00, [4] * 11 + [3] * 12 + [2] * 7), (0xFC, 0x24, 0xC0, [4] * 2 + [3] * 6),
    (0xFC, 0x18, 0xC0, [4] * 2 + [3] * 10), (0xF4, 0x84, 0x40, [4] * 4 + [3] * 7 + [2] * 19), (0xFC, 0xA4, 0x50, [4] * 11 + [3] * 12 + [2] * 4),
])
def test_layer_two_checksums(second, third, fourth, widths):
    rng = random.Random(third)
    head = bytes((0xFF, second, third, fourth))
    h = m.header(head)
    bound = 4 + 4 * (fourth >> 4 & 3) if fourth >> 6 == 1 else 32
    stream = []
    for _ in range(20):
        allocation, scfsi = [], []
        for band, w in enumerate(widths):
            told = [rng.choice((0, rng.randrange(1 << w))) for _ in range(1 if h.mono or band >= bound else 2)]
            allocation += [b for v in told for b in map(int, f"{v:0{w}b}")]
            used = told * (2 if band >= bound and not h.mono else 1)
            scfsi += [rng.randrange(2) for v in used if v for _ in range(2)]
        covered = [int(b) for x in head[2:] for b in f"{x:08b}"] + allocation + scfsi
        rest = allocation + scfsi + [rng.randrange(2) for _ in range(-len(allocation + scfsi) % 8)]
        body = bytes(int("".join(map(str, rest[i : i + 8])), 2) for i in range(0, len(rest), 8))
        stream.append((head + _slow_crc(covered).to_bytes(2, "big") + body).ljust(h.length, b"\x5a"))
    a = m.parse(b"".join(stream))
    assert (a.checked, a.broken, a.unchecked) == (20, 0, 0)
    hurt = bytearray(b"".join(stream))
    hurt[h.length + 6] ^= 0x80
    b = m.parse(bytes(hurt))
    assert b.broken == 1 and len(b.offsets) == 20


def test_resynchronises_and_counts_damage():
    media = m.wrap(bytes(range(256)) * 40)
    a = m.parse(media)
    junk = b"\xff\xfb\x00junk\xff\xff" * 5
    b = m.parse(junk + media + b"TAG" + b"A title".ljust(125, b"\0"))
    assert len(b.offsets) == len(a.offsets) and b.tags["TIT2"] == "A title" and b.skipped >= len(junk)
    hurt = bytearray(media)
    hurt[a.offsets[2] + 8] ^= 0x10
    c = m.parse(bytes(hurt))
    assert c.broken == 1 and len(c.offsets) == len(a.offsets)
    cut = m.parse(media[: a.offsets[3] + 10])
    assert len(cut.offsets) == 3 and cut.skipped > 0
    assert m.parse(None).seconds == 0 and m.parse(b"\xff" * 50).offsets == []


def test_headers():
    h = m.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (h.kbit, h.rate, h.length, h.samples, h.mono, h.protected) == (128, 44100, 417, 1152, False, False)
    assert m.header(bytes((0xFF, 0xF3, 0x80, 0xC0))).samples == 576
    one = m.header(bytes((0xFF, 0xFF, 0x94, 0x00)))  # layer I, 288 kbit/s, 48 kHz
    assert (one.layer, one.kbit, one.rate, one.length, one.samples) == (1, 288, 48000, 288, 384)
    two = m.header(bytes((0xFF, 0xFD, 0xA4, 0x00)))
    assert (two.layer, two.kbit, two.length, two.samples) == (2, 192, 576, 1152)
    assert m.header(bytes((0xFF, 0xF5, 0xA4, 0x00))).samples == 1152
    for bad in (b"", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xe9\x90\x00", b"abcd"):
        assert m.header(bad) is None


def frames(second, third, n, length, fourth=0xC0, body=b""):
    return [(bytes((0xFF, second, third, fourth)) + (body if i == 0 else b"")).ljust(length, b"\0") for i in range(n)]


def test_layers_and_free_format():
    one = m.parse(b"".join(frames(0xFF, 0x94, 5, 288, 0)))
    assert one.offsets == [0, 288, 576, 864, 1152] and one.seconds == pytest.approx(5 * 384 / 48000)
    checked = bytes((0xFF, 0xFE, 0x94, 0xC0))
    frame = checked + m.crc16(checked[2:] + bytes(16)).to_bytes(2, "big") + bytes(282)
    assert m.parse(frame * 3).checked == 3
    two = m.parse(b"".join(frames(0xFC, 0xA4, 4, 576, 0)))
    assert len(two.offsets) == 4 and (two.unchecked, two.checked, two.broken) == (0, 0, 4) and two.decoded == 4 * 1152
    free = m.parse(b"".join(frames(0xFB, 0x04, 4, 700)))
    assert free.offsets == [0, 700, 1400, 2100] and free.sizes == [700] * 4


def test_tags():
    def tag(version, flags, *parts):
        body = b"".join(k + (len(v).to_bytes(4, "big")) + bytes((0, f)) + v for k, v, f in parts)
        return b"ID3" + bytes((version, 0, flags)) + bytes((len(body) >> 7 * i & 127) for i in (3, 2, 1, 0)) + body

    sound = b"".join(frames(0xFB, 0x90, 4, 417))
    wide = b"\x01" + "Äb".encode("utf-16")
    a = m.parse(tag(3, 0, (b"TIT2", wide, 0), (b"TPE1", b"\x02" + "Ünö".encode("utf-16-be"), 0), (b"TXXX", b"\x03key\0w\xc3\xa9rt", 0)) + sound)
    assert a.tags == {"TIT2": "Äb", "TPE1": "Ünö", "key": "wért"} and len(a.offsets) == 4
    loose = tag(4, 0, (b"TIT2", b"\x00a\xff\x00b", 2)) + sound
    assert m.parse(loose).tags == {"TIT2": "a\xffb"}
    item = (3).to_bytes(4, "little") + bytes(4) + b"Artist\0abc"
    foot = b"APETAGEX" + (2000).to_bytes(4, "little") + (len(item) + 32).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    b = m.parse(sound + item + foot + b"TAG" + b"Old".ljust(125, b"\0"))
    assert b.tags == {"TIT2": "Old", "Artist": "abc"} and len(b.offsets) == 4 and b.skipped == 0
    old = b"ID3\x02\0\0\0\0\0\x0b" + b"TT2\0\0\x05\x00name" + sound
    assert m.parse(old).tags == {"TT2": "name"}


def test_tables_of_variable_bitrate():
    lame = b"Info" + (15).to_bytes(4, "big") + (3).to_bytes(4, "big") + (1668).to_bytes(4, "big") + bytes(100) + bytes(4) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    a = m.parse(b"".join(frames(0xFB, 0x90, 4, 417, 0xC0, bytes(17) + lame)))
    assert (a.table, a.table_frames, a.delay, a.padding, len(a.offsets)) == ("Info", 3, 576, 1000, 3)
    assert a.samples == 3 * 1152 - 1576 and a.seconds == pytest.approx(a.samples / 44100)
    vbri = b"VBRI" + b"".join(x.to_bytes(n, "big") for x, n in ((1, 2), (528, 2), (75, 2), (1251, 4), (3, 4), (3, 2), (1, 2), (2, 2), (1, 2), (417, 2), (417, 2), (417, 2)))
    b = m.parse(b"".join(frames(0xFB, 0x90, 4, 417, 0x00, bytes(32) + vbri)))
    assert (b.table, b.table_frames, b.table_bytes, b.table_seek, b.delay, len(b.offsets)) == ("VBRI", 3, 1251, [417] * 3, 528, 3)


def test_query_and_columns(spark, edge, empty):
    for df in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), edge):
        got = {}
        for r in m.digests(df).collect():
            got.setdefault(r["doc_id"], []).append(r)
        assert sum(map(len, got.values())) == df.count()
        for r in df.collect():
            raw = (r["text"] or "").encode()
            pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            for g in got[r["doc_id"]]:
                assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
                assert g["media_sha256"] == hashlib.sha256(m.wrap(pay)).hexdigest() and g["skipped_bytes"] == 0
    assert m.digests(empty).count() == 0
    rows = spark.createDataFrame([(b"hello",), (None,)], "content binary")
    clash = rows.withColumns({c: F.lit("x") for c in ("media", "audio", "seconds", "tags")})
    for made in (m.restore(m.describe(m.store(clash))), m.describe(m.store(rows.limit(0)))):
        got = made.collect()
        assert {bytes(r["content"]) for r in got} == ({b"hello", b""} if got else set())
    assert m.describe(m.store(clash)).columns == ["content", "seconds", "tags", "media", "audio"]
    out = m.describe(m.store(rows)).collect()
    assert [m.unwrap(bytes(r["media"])) for r in out] == [b"hello", b""] and all(r["audio"]["broken"] == 0 for r in out)
