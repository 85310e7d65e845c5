import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from foldspark.llm import bpe, repair_shards
from foldspark.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(open(PATH, "rb").read())


def test_every_code_point(library, ours):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == text


def test_random_texts(library, ours):
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "'s", "'", "'re", "'ll", "<|endoftext|>", "<|endo", "é", "日本", "1", "23", "!!", "\t", " ", "\x1c", "x" * 700, "aaaa", "😀", "́", "Łódź"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for text, ids in zip(texts, ours.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_speculation_is_checked_pair_by_pair(library, ours):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)]
    flat, count = ours.encode_many(words)
    ends = np.cumsum(count)
    for w, a, b in zip(words, ends - count, ends):
        assert flat[a:b].tolist() == ours.merge_exactly(w) == library.encode(w.decode(), add_special_tokens=False).ids


def test_pieces_of_long_texts(library, ours, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    text = "Some words, it's 12 of them.\n\n And  more! " * 30 + "z" * 300
    assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_full_cache_starts_anew(library, ours, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    texts = [f"some text number {i} and words{i}" for i in range(40)]
    for _ in range(2):
        for t, ids in zip(texts, [ours.encode([t])[0] for t in texts]):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def thue_morse(n):
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_on_which_polynomial_hashes_agree(library, ours, n):
    x, y = thue_morse(n)
    texts = [f"{x}\n{y}", f"{y} {x}", x, y]
    for text, ids in zip(texts, ours.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == text


def test_words_that_share_a_hash_are_told_apart(library, monkeypatch):
    from foldspark.llm import textvec

    def bad(by, starts, ends):  # long words share 16 hashes
        h = textvec.hash_blocks(by, starts, ends)
        return np.where(ends - starts > 7, h & np.uint64(0xF << 60) | np.uint64(1), h)

    monkeypatch.setattr(bpe, "hash_blocks", bad)
    weak = bpe.Bpe(open(PATH, "rb").read())
    texts = ["the quick brown fox jumps over it", "quick foxes are not the brown dogs", "it's overwhelmingly over wonderful", "the quick brown fox"]
    for _ in range(2):
        for t in [*texts, " ".join(texts)]:
            assert np.frombuffer(weak.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_long_words_with_the_same_ends_are_told_apart(library, monkeypatch):
    from foldspark.llm import textvec

    def bad(by, starts, ends):  # all words of more than 16 bytes share a hash
        return np.where(ends - starts > 16, np.uint64(1 << 60 | 1), textvec.hash_blocks(by, starts, ends))

    monkeypatch.setattr(bpe, "hash_blocks", bad)
    weak = bpe.Bpe(open(PATH, "rb").read())
    texts = [f"{a} unrecognis{m}ablenesses it{m}" for a in ("one", "incomprehensibilities") for m in ("", "e", "z", "été")]
    for _ in range(2):
        for t in [*texts, " ".join(texts)]:
            assert np.frombuffer(weak.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_new_words_take_few_lookups(library, monkeypatch):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(3000))
    fresh, find, keys = bpe.Bpe(open(PATH, "rb").read()), bpe._Table.find, []
    monkeypatch.setattr(bpe._Table, "find", lambda table, some: keys.append(len(some)) or find(table, some))
    ids = np.frombuffer(fresh.encode([text])[0], "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert sum(keys) < 9 * len(ids)
    told = sum(keys)
    assert fresh.encode([text, text])[1] == np.array(ids, "<u4").tobytes() and sum(keys) == told  # known words take none


def check(df, rows, library):
    got = sorted(tuple(r) for r in df.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").fillna(-1, ["doc_id"]).collect())
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)


def test_query(spark, library, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(bpe.digests(docs, PATH), docs.collect(), library)
    check(bpe.digests(edge, PATH), edge.collect(), library)
    assert bpe.digests(empty, PATH).count() == 0
    wide = bpe.encode(edge, PATH)
    assert wide.columns == [*(c for c in edge.columns if c != "ids"), "ids"]


def test_shards(spark, library, edge, empty):
    import zlib

    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), edge):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
        start, want = 0, []
        for r in rows:
            ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted((tuple(r) for r in repair_shards.round_trip(docs, PATH).collect()), key=lambda r: r[1])
        assert got == want
    assert repair_shards.round_trip(empty, PATH).count() == 0


def test_blocks_decode_whole_and_one_by_one():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 500, 1, 3000, 40, 1])
    ids = rng.choice([5, 6, 7, 7, 7, 900], lengths.sum())
    data = repair_shards.compress(ids, lengths, 1000)
    block = repair_shards.Block(data)
    whole, begins = block.documents()
    assert (whole == ids).all() and len(data) < 4 * len(ids)
    for i, (a, n) in enumerate(zip(begins, lengths)):
        assert (block.document(i) == ids[a : a + n]).all()
    with pytest.raises(ValueError):
        repair_shards.Block(b"x" * 64)


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 900, 64)
    docs = [np.concatenate((rng.integers(0, 900, rng.integers(1, 30)), passage, passage[:40] if i % 3 else rng.integers(0, 900, 5), [900])) for i in range(60)]
    block = repair_shards.Block(repair_shards.compress(np.concatenate(docs), np.array([len(d) for d in docs]), 1000))
    assert (block.documents()[0] == np.concatenate(docs)).all()
    seq = repair_shards._unbits(block.packed, block.n_symbols, block.width)
    inside = np.ones(len(seq), bool)
    inside[block.begins[1:] - 1] = False  # ends
    both = inside[:-1] & inside[1:]
    assert np.unique(np.stack((seq[:-1], seq[1:]))[:, both], axis=1, return_counts=True)[1].max() < repair_shards.LEAST == 2
    assert block.size.max() >= 32 and len(seq) < 60 * 30


def test_keys_without_room_for_their_places_sort_alike():
    keys = np.random.default_rng(6).integers(0, 1 << 20, 3000)
    for width in (20, 51, 52, 60):
        ordered, order = repair_shards._ranked(keys, width)
        assert (ordered == np.sort(keys)).all() and (keys[order] == ordered).all() and (np.sort(order) == np.arange(3000)).all()


@pytest.mark.parametrize("width", range(1, 33))
def test_packed_values_read_back(width):
    for n in (0, 1, 7, 8, 9, 64, 100):
        values = np.random.default_rng(n).integers(0, 1 << width, n)
        values[:1] = (1 << width) - 1
        got, data = repair_shards._bits(values)
        assert got == (width if n else 1) and len(data) == (n * got + 7) // 8
        assert (repair_shards._unbits(np.frombuffer(data, np.uint8), n, got) == values).all()
