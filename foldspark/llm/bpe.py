"""BPE encoding and decoding by speculation and verification.

A chunk of texts is split into words by the rules of the tokenizer's pattern, all
characters at once.  Equal words are found by 64-bit hashes and compared byte by byte where
words of different bytes could share one; a word that differs from the one that has its hash is encoded by itself.
Words not seen yet are tokenised greedily by longest match (the speculation).  A sequence is the exact
BPE result if and only if each adjacent pair of it is what BPE makes of the two
joined, so all adjacent pairs of all new words are tested at once; words with a
failing pair are merged exactly.  Results are remembered in a bounded cache.

Nulls are encoded as empty texts, empty texts give no ids.  Ids travel as binary
columns of little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import ready, with_computed
from foldspark.llm.textvec import blocks, hash_blocks, mix

#: Words kept per Python worker (up to about 170 bytes each); when full the cache starts anew.
CACHE_WORDS = 1_000_000
#: Characters that are split at a time; longer texts are cut between words.
PIECE_CHARS = 1 << 19
_NONE = np.int64(1 << 40)
#: Bytes 0 to n - 1 of a little-endian block; bits 0 to n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_UP_TO = np.array([(2 << n) - 1 for n in range(64)], np.uint64)
_loaded: dict[int, "Bpe"] = {}


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand
    for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Table:
    """Values by 64-bit hash, in a table of four to eight times as many places: absent keys are soon told."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for k, v in zip(keys.tolist(), values.tolist()):
            i = k >> (64 - bits)
            while self._values[i] >= 0:
                i = (i + 1) & self._mask
            self._keys[i], self._values[i] = k, v

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where absent."""
        at = (keys >> self._shift).astype(np.int64)
        out = self._values[at].astype(np.int64)
        off = np.flatnonzero((self._keys[at] != keys) & (out >= 0))
        at = at[off]
        while len(off):
            at = (at + 1) & self._mask
            value = self._values[at]
            same = (self._keys[at] == keys[off]) | (value < 0)
            out[off[same]] = value[same]
            off, at = off[~same], at[~same]
        return out


def _put(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``held``, of which the first ``n`` count, with ``more`` after those; room grows by doubling."""
    if n + len(more) > len(held):
        held = np.concatenate((held[:n], np.empty(max(n, len(more)), held.dtype)))
    held[n : n + len(more)] = more
    return held


def _slot(start: np.ndarray) -> np.ndarray:
    """16 bits from the first four bytes of blocks."""
    return (((start & _FIRST[4]) * np.uint64(0x9E3779B1) & _FIRST[4]) >> np.uint64(16)).astype(np.int64)


class _Cache:
    """Ids and bytes of words by 64-bit hash (0 stands for an empty place), at most half full."""

    def __init__(self):
        self._bits, self._n, self._ids, self._bytes = 12, 0, 0, 0
        self._keys, self._entry = np.zeros(1 << self._bits, np.uint64), np.zeros(1 << self._bits, np.int32)
        self._name = np.zeros(0, np.uint64)
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16)
        self._word, self._size, self._raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self._head, self._tail = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return self._n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries, -1 where absent."""
        at = (keys >> np.uint64(64 - self._bits)).astype(np.int64)
        out = self._entry[at].astype(np.int64)
        left = np.flatnonzero(self._keys[at] != keys)
        at = at[left]
        while len(left):
            there = self._keys[at]
            same = there == keys[left]
            out[left[same]] = self._entry[at[same]]
            out[left[there == 0]] = -1
            on = ~same & (there != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self._bits) - 1)
        return out

    def add(self, keys: np.ndarray, raw: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Adds words with different keys that are not there yet; ``begin`` is where they lie in ``raw``."""
        by, letters = blocks(raw), raw[_spread(begin, size)]
        for name, more in (
            ("_name", keys),
            ("start", self._ids + np.cumsum(count) - count),
            ("count", count),
            ("_word", self._bytes + np.cumsum(size) - size),
            ("_size", size),
            ("_head", by[begin]),
            ("_tail", by[np.maximum(begin + size - 8, 0)]),
        ):
            setattr(self, name, _put(getattr(self, name), self._n, more))
        if self.pool.dtype == np.uint16 and ids.max(initial=0) >= 1 << 16:
            self.pool = self.pool.astype(np.uint32)
        self.pool, self._raw = _put(self.pool, self._ids, ids), _put(self._raw, self._bytes, letters)
        old, self._n, self._ids, self._bytes = self._n, self._n + len(keys), self._ids + len(ids), self._bytes + len(letters)
        if 2 * self._n > len(self._keys):
            self._bits, old = (4 * self._n).bit_length(), 0
            self._keys, self._entry = np.zeros(1 << self._bits, np.uint64), np.zeros(1 << self._bits, np.int32)
        entry = np.arange(old, self._n, dtype=np.int32)
        keys = self._name[old : self._n]
        at, left = (keys >> np.uint64(64 - self._bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self._keys[at] == 0
            self._keys[at[free]] = keys[left[free]]  # of several keys for one place, one stays
            won = self._keys[at] == keys[left]
            self._entry[at[won]] = entry[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self._bits) - 1)

    def differ(self, raw: np.ndarray, by: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether words of 8 bytes or more (in ``raw``, of which ``by`` are the blocks) are not those of these entries."""
        out = (size != self._size[entry]) | (by[begin] != self._head[entry]) | (by[begin + size - 8] != self._tail[entry])
        more = np.flatnonzero(~out & (size > 16))
        out[more] = _differ(raw, begin[more], size[more], self._raw, self._word[entry[more]])
        return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all elements of stretches, one stretch after the other."""
    end = np.cumsum(size)
    out = np.repeat(start - end + size, size)
    out += np.arange(len(out))
    return out


def _differ(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether stretches of ``a`` (from ``at`` on, ``n`` elements) differ from as long ones of ``b``."""
    out = np.zeros(len(n), bool)
    out[np.searchsorted(np.cumsum(n), np.flatnonzero(a[_spread(at, n)] != b[_spread(bt, n)]), "right")] = True
    return out


_LETTER, _SPACE = 1, 3
_kind_table: list[np.ndarray] = []
#: Bytes of a character, its first byte's lowest and highest value, and the bits that count in it.
_WIDE = ((2, 0xC0, 0xDF, 0x1F), (3, 0xE0, 0xEF, 0x0F), (4, 0xF0, 0xFF, 0x07))


def _kinds() -> np.ndarray:
    """The kind of each code point: other, letter, number, white space."""
    if not _kind_table:
        import regex

        table = np.zeros(0x110000, np.uint8)
        points = np.arange(0x110000, dtype="<u4")
        points[0xD800:0xE000] = ord("?")  # no characters
        every = points.tobytes().decode("utf-32-le")
        for k, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = k
        _kind_table.append(table)
    return _kind_table[0]


class Bpe:
    """A byte-level BPE vocabulary (the JSON of a ``tokenizers`` file)."""

    def __init__(self, data: bytes):
        import regex

        spec = json.loads(data)
        letter = _byte_letters()
        model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = {i: bytes(letter[c] for c in s) for s, i in model["vocab"].items()}
        n = max([*as_bytes, *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for i, b in as_bytes.items():
            self.bytes_of[i] = b
        for s, i in added.items():
            self.bytes_of[i] = s.encode()
        self.id_of = {b: i for i, b in as_bytes.items()}
        self.longest = max(map(len, self.id_of))
        # How each id is made: the rank of its merge (-1: a byte) and its two parts.
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        vocab = model["vocab"]
        split = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self._made = np.array([vocab[a + b] for a, b in split] or [0], np.int64)
        self._first = np.array([vocab[a] for a, _ in split], np.int64)
        self._second = np.array([vocab[b] for _, b in split], np.int64)
        _, once = np.unique(self._first << 32 | self._second, return_index=True)
        self._pairs = _Table(mix((self._first << 32 | self._second)[once].astype(np.uint64)), once)
        for r in once[np.argsort(-once)].tolist():  # the earliest merge that makes an id stays
            c = self._made[r]
            self.rank[c], self.left[c], self.right[c] = r, self._first[r], self._second[r]
        self._size = np.array([len(b) for b in self.bytes_of], np.int64)
        self._byte_id = np.array([self.id_of[bytes([i])] for i in range(256)], np.int64)
        names = [b for b in self.id_of if b]
        size = np.array([len(b) for b in names], np.int64)
        at, by = np.cumsum(size) - size, blocks(np.frombuffer(b"".join(names), np.uint8))
        self._tokens = _Table(hash_blocks(by, at, at + size), np.array([self.id_of[b] for b in names], np.int64))
        # Bits tell which lengths there are (63: that or more) after the first four bytes, by
        # a hash of these; of 2 and 3 bytes, after the first two. One byte is always there.
        bit, start, some = np.uint64(1) << np.minimum(size, 63).astype(np.uint64), by[at], size >= 4
        self._after_two, self._after_four = np.full(1 << 16, 2, np.uint64), np.zeros(1 << 16, np.uint64)
        np.bitwise_or.at(self._after_four, _slot(start[some]), bit[some])
        some = (size == 2) | (size == 3)
        np.bitwise_or.at(self._after_two, (start[some] & _FIRST[2]).astype(np.int64), bit[some])
        self._after_two = self._after_two.astype(np.uint8)
        self._far = sorted({n for n in size.tolist() if n >= 63}, reverse=True)
        self._letters = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._letters_at = np.cumsum(self._size) - self._size
        self.added = added
        self._special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._seam = regex.compile(r"\p{L}(?= \p{L})")
        self._merges: dict[tuple[int, int], tuple[int, int]] | None = None
        self._forget()

    # -- new words ---------------------------------------------------------

    def _greedy(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, word of each): longest matches from the left, for all words at once."""
        by = blocks(buf)
        at, word, ids, owner = begin.copy(), np.arange(len(begin)), [], []
        while len(at):
            room, start = end[word] - at, by[at]
            may = self._after_four[_slot(start)] | self._after_two[(start & _FIRST[2]).astype(np.int64)]
            may &= _UP_TO[np.minimum(room, 63)]
            found = np.full(len(at), -1, np.int64)
            far = np.flatnonzero(may >> np.uint64(63))
            for n in self._far if len(far) else ():
                some = far[(room[far] >= n) & (found[far] < 0)]
                found[some] = self._match(by, at[some], np.full(len(some), n))
            may &= _UP_TO[62]
            # The longest that may be there is looked up, then the next where it is not.
            left = np.flatnonzero(found < 0)
            while len(left):
                some = may[left]
                n = np.frexp((some & ~(some >> np.uint64(1))).astype(np.float64))[1].astype(np.int64) - 1
                found[left] = got = self._match(by, at[left], n)
                off = got < 0
                left = left[off]
                may[left] ^= np.uint64(1) << n[off].astype(np.uint64)
            ids.append(found)
            owner.append(word)
            at = at + self._size[found]
            going = at < end[word]
            at, word = at[going], word[going]
        flat, own = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        return flat[order], own[order]

    def _match(self, by: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of ``n`` bytes from ``at`` on, -1 where there is none."""
        got = self._tokens.find(hash_blocks(by, at, at + n))
        return np.where(self._size[got] == n, got, -1)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self._pairs.find(mix((a << 32 | b).astype(np.uint64)))
        return np.where(found >= 0, found, _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between the ids ``a`` and ``b`` alone.

        The merges at the border are undone from the latest to the first.  If
        the ids then at the border would merge before the merge just undone,
        BPE would have joined them: earlier ranks first, of equal ones the left.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NONE)
        while len(live):
            bad = self._pair_rank(a, b) < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            going = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[going], a[going], b[going], ra[going], rb[going]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def merge_exactly(self, word: bytes) -> list[int]:
        """BPE by its definition, with a heap of (rank, place)."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        if self._merges is None:
            self._merges = {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(zip(self._first.tolist(), self._second.tolist(), self._made.tolist()))))}
        merges = self._merges
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            nxt[i] = k = nxt[j]
            if k < len(ids):
                prv[k] = i
                if (p := (ids[i], ids[k])) in merges:
                    heapq.heappush(heap, (merges[p][0], i, p))
            if (h := prv[i]) >= 0 and (p := (ids[h], ids[i])) in merges:
                heapq.heappush(heap, (merges[p][0], h, p))
        return [x for x in ids if x >= 0]

    def _merge_many(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of many words at once: in each round each word merges all its pairs of the
        lowest rank, of overlapping ones every other from the left."""
        out, owner = [], []
        rank = np.full(len(ids), _NONE)
        stale = np.ones(len(ids), bool)
        while len(ids) > 1:
            # Only pairs with an id of the round before have another rank.
            rank[stale] = _NONE
            inner = np.flatnonzero(stale[:-1] & (word[1:] == word[:-1]))
            rank[inner] = self._pair_rank(ids[inner], ids[inner + 1])
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(begin, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, begin), size)
            done = least == _NONE
            out.append(ids[done])
            owner.append(word[done])
            hit = np.flatnonzero((rank == least) & ~done)
            run = np.concatenate(([True], np.diff(hit) > 1)) if len(hit) else np.zeros(0, bool)
            take = hit[(hit - np.maximum.accumulate(np.where(run, hit, 0))) % 2 == 0] if len(hit) else hit
            ids = ids.copy()
            ids[take] = self._made[rank[take]]
            keep = ~done
            keep[take + 1] = False
            stale = np.zeros(len(ids), bool)
            stale[take] = stale[np.maximum(take - 1, 0)] = True
            ids, word, rank, stale = ids[keep], word[keep], rank[keep], stale[keep]
        flat, own = np.concatenate([*out, ids]), np.concatenate([*owner, word])
        order = np.argsort(own, kind="stable")
        return flat[order], own[order]

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word); words are not empty."""
        buf = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        flat, own = self._greedy(buf, end - size, end)
        inner = np.flatnonzero(own[1:] == own[:-1])
        # An id whose bytes are not those of its place was found by a hash that two strings share.
        bad = np.zeros(len(words), bool)
        bad[np.searchsorted(end, np.flatnonzero(self._letters[_spread(self._letters_at[flat], self._size[flat])] != buf), "right")] = True
        bad[own[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        # Very long words are merged one by one with a heap, which takes fewer rounds.
        for w in np.flatnonzero(bad & (size > 512)).tolist():
            exact = self.merge_exactly(words[w])
            keep = own != w
            flat, own = np.concatenate((flat[keep], exact)), np.concatenate((own[keep], np.full(len(exact), w)))
            bad[w] = False
        if bad.any():
            word = np.repeat(np.arange(len(words)), size)
            of = bad[word]
            exact, owner = self._merge_many(self._byte_id[buf[of]], word[of])
            keep = ~bad[own]
            flat, own = np.concatenate((flat[keep], exact)), np.concatenate((own[keep], owner))
        order = np.argsort(own, kind="stable")
        return flat[order], np.bincount(own, minlength=len(words))

    # -- texts -------------------------------------------------------------

    def _pieces(self, text: str) -> Iterator[str | int]:
        """Stretches of text between added tokens, and the ids of those."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield text[at : m.start()]
            yield self.added[m[0]]
            at = m.end()
        yield text[at:] if at else text

    def _short(self, piece: str) -> Iterator[str]:
        """Cuts where the pattern ends a word whatever comes before or after."""
        at = 0
        while len(piece) - at > PIECE_CHARS and (m := self._seam.search(piece, at + PIECE_CHARS)):
            yield piece[at : m.end()]
            at = m.end()
        yield piece[at:] if at else piece

    def split(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where words begin in the UTF-8 of texts that begin at ``off``.

        Runs of letters, of numbers and of other characters are words, with a space
        right before them.  White space up to the last before a word is one, and so
        is that last one unless it is the word's space; at a text's end all of it is
        one.  An apostrophe alone that begins one of a few endings takes it along.
        """
        n = len(raw)
        kinds = _kinds()
        # Every byte has its character's kind.
        kind = np.frombuffer(bytearray(raw.tobytes().translate(kinds[:256].tobytes())), np.uint8)
        wide = np.flatnonzero(raw >= 0xC0)
        lead = raw[wide]
        for size, low, high, bits in _WIDE if len(wide) else ():
            at = wide[(lead >= low) & (lead <= high)]
            point = raw[at].astype(np.int64) & bits
            for i in range(1, size):
                point = point << 6 | raw[at + i] & 0x3F
            for i in range(size):
                kind[at + i] = kinds[point]
        first = np.zeros(n + 3, bool)
        first[off[:-1][off[:-1] < n]] = True
        cut = np.ones(n, bool)
        cut[1:] = (kind[1:] != kind[:-1]) | first[1:n]
        space = kind == _SPACE
        after = np.flatnonzero(cut[1:] & space[:-1] & ~space[1:] & ~first[1:n]) + 1
        quote = np.flatnonzero(raw[:-1] == 39)
        quote = quote[cut[quote] & (kind[quote + 1] == _LETTER) & ~first[quote + 1]]
        last = after - 1
        inner = np.flatnonzero(raw[last] >= 0x80)
        while len(inner := inner[raw[last[inner]] & 0xC0 == 0x80]):
            last[inner] -= 1
        cut[last] = True
        cut[after[raw[after - 1] == 32]] = False
        quote = quote[first[quote] | (quote == 0) | (raw[quote - 1] != 32)]
        if len(quote):
            one = raw[quote + 1]
            two = np.where((quote + 2 < n) & ~first[quote + 2], raw[np.minimum(quote + 2, n - 1)], 0)
            # S t m d and re ve ll follow the apostrophe.
            short = np.isin(one, [115, 116, 109, 100])
            long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            quote, size = quote[short | long], np.where(short, 1, 2)[short | long]
            cut[quote + 1] = False
            end = quote + 1 + size
            inside = (end < n) & ~first[end]
            cut[end[inside & (kind[np.minimum(end, n - 1)] == _LETTER)]] = True
        return np.flatnonzero(cut)

    @staticmethod
    def _words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        data = raw.tobytes()
        return [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]

    def _forget(self) -> None:
        self._cache = _Cache()

    def _chunk(self, pieces: list[str]) -> list[bytes]:
        """Ids of some pieces of text without added tokens."""
        parts = [p.encode("utf-8", "surrogatepass") for p in pieces]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        if not len(raw):
            return [b""] * len(pieces)
        off = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        begin = self.split(raw, off)
        end = np.append(begin[1:], len(raw))
        size, by = end - begin, blocks(raw)
        h = hash_blocks(by, begin, end)
        known = self._cache
        entry = known.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            names, sample, which = np.unique(h[missing], return_index=True, return_inverse=True)
            if len(known) and len(known) + len(names) > CACHE_WORDS:
                self._forget()
                missing = np.arange(len(h))
                names, sample, which = np.unique(h, return_index=True, return_inverse=True)
            known = self._cache if len(names) <= CACHE_WORDS else _Cache()  # one piece may hold more words than are kept
            some = missing[sample]
            entry[missing] = len(known) + which
            known.add(names, raw, begin[some], size[some], *self.encode_many(self._words(raw, begin[some], end[some])))
        # Words that differ from the one that stands for their hash are encoded by themselves.
        long = np.flatnonzero(size > 7)
        own = long[known.differ(raw, by, begin[long], size[long], entry[long])]
        start, number, pool = known.start, known.count, known.pool
        if len(own):
            flat, n = self.encode_many(self._words(raw, begin[own], end[own]))
            entry[own] = len(start) + np.arange(len(own))
            start, number, pool = np.concatenate((start, len(pool) + np.cumsum(n) - n)), np.concatenate((number, n)), np.concatenate((pool.astype(np.int64), flat))
        count = number[entry]
        ids = pool[_spread(start[entry], count)]
        total = np.concatenate(([0], np.cumsum(count)))
        cuts = total[np.searchsorted(begin, off)].tolist()
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, little-endian unsigned 32-bit integers."""
        plan: list[list[int | bytes]] = []
        pieces: list[str] = []
        for t in texts:
            own: list[int | bytes] = []
            special = any(a in t for a in self.added)
            for p in self._pieces(t) if special else (t,):
                if isinstance(p, int):
                    own.append(p.to_bytes(4, "little"))
                else:
                    for q in self._short(p):
                        own.append(len(pieces))
                        pieces.append(q)
            plan.append(own)
        done: list[bytes] = []
        for i, j in slices([len(p) for p in pieces], PIECE_CHARS):
            done += self._chunk(pieces[i:j])
        return [done[own[0]] if len(own) == 1 and isinstance(own[0], int) else b"".join(done[x] if isinstance(x, int) else x for x in own) for own in plan]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def load(data: bytes) -> Bpe:
    """The vocabulary, once per Python worker."""
    key = hash(data)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(data)
    return _loaded[key]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``most``."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _mapped(df: DataFrame, column: str, tokenizer: str, field: str, kind: pa.DataType, what: Callable[[Bpe, list], list]) -> DataFrame:
    shared = ready(df.sparkSession).sparkContext.broadcast(open(tokenizer, "rb").read())  # one vocabulary file: a few MB

    def start():
        import pyarrow.compute as pc

        bpe = load(shared.value)

        def apply(values: pa.Array) -> Iterator[list[pa.Array]]:
            sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
            for i, j in slices(sizes, 1 << 20):
                yield [pa.array(what(bpe, values.slice(i, j - i).to_pylist()), kind)]

        return apply

    return with_computed(df, column, field, start)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the binary column ``ids``: every whole text as the vocabulary file
    ``tokenizer`` encodes it (its added tokens are recognised in texts, none is
    appended).  Rows, other columns, ties and repeats stay as they are."""
    return _mapped(df, text, tokenizer, f"{ids} binary", pa.binary(), lambda bpe, texts: bpe.encode([t or "" for t in texts]))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the column ``text`` that the binary column ``ids`` stands for; null ids give null."""
    return _mapped(df, ids, tokenizer, f"{text} string", pa.string(), lambda bpe, rows: [None if x is None else bpe.decode(x) for x in rows])


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """Adds both columns, as :func:`encode` and :func:`decode` one after the other do, in one pass with one worker a task."""
    shared = ready(df.sparkSession).sparkContext.broadcast(open(tokenizer, "rb").read())  # one vocabulary file: a few MB

    def start():
        import pyarrow.compute as pc

        bpe = load(shared.value)

        def apply(values: pa.Array) -> Iterator[list[pa.Array]]:
            for i, j in slices(pc.fill_null(pc.binary_length(values), 0).to_pylist(), 1 << 20):
                made = bpe.encode([t or "" for t in values.slice(i, j - i).to_pylist()])
                yield [pa.array(made, pa.binary()), pa.array([bpe.decode(x) for x in made], pa.string())]

        return apply

    return with_computed(df, text, f"{ids} binary, {back} string", start)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's row per document, from the ids and the texts decoded from them."""
    done = round_trip(docs.select("doc_id", "text"), tokenizer)
    return done.select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
