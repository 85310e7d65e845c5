"""LM scoring: an interpolated modified Kneser-Ney model of order 2 or 3.

Counting runs in Spark: tasks count the words and pairs of words of their texts and
deal sorted, packed counts to shards; shards are summed and written to the shared
folder as hash arrays in sorted order, which scoring tasks map into memory and
search with sorted queries.

    P(w | u) = max(c(uw) - D(c(uw)), 0) / c(u) + gamma(u) P(w)
    P(w)     = max(N(.w) - D'(N(.w)), 0) / N(..) + gamma' / (V + 1)

N(.w) is the number of words seen before w, N(..) that of all pairs, D and D' the
three modified discounts from counts of counts, gamma the mass they leave.  The
first word's context is a start mark; a context never seen leaves P(w).

With order 3, P(w | tu) = max(c(tuw) - D''(c(tuw)), 0) / c(tu.) + gamma(tu) P(w | u)
from the second token on, where t may be the start mark, and P(w | u) is of
N(.uw), the number of tokens seen before uw, in place of c(uw); pairs with the start
mark, before which nothing stands, keep their counts.

Words are runs of bytes other than space and U+0009 to U+000D, A-Z in lower case;
each text has one end after its words, which counts as a token.  Null texts are
empty: one end.  Repeated rows count as often as they occur.  With no training row
each probability is 1 / (V + 1) = 1.  An empty table gives no rows.

Words are counted first and get dense ids, small for frequent ones, so that no two words
share one (words are told apart by hashes of 64 bits, grams of ids by hashes of 64 bits).
Triples are counted next; their shards send each shard of pairs the numbers N(.uw)
and what its pairs need as contexts.  A triple belongs to the shard of its first two
words, or is dealt by itself if both are frequent.

A pair belongs to the shard of its first word; the start mark and words so frequent that
their pairs would fill a share of a shard are dealt by pair.  Which words these are
follows from their ids and a number for each shard of words.  Counts have no cap.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import shared_files
from foldspark.llm.common import materialised, ready, release, remainder, shared_uri
from foldspark.llm.textvec import doc_chunks, hash_spans, mix, raw_utf8, word_spans

#: Training tokens of a shard of pairs, tokens that a task counts at a time, bytes scored at a time.
SHARD_TOKENS, COUNT_TOKENS, SCORE_BYTES = 1_500_000, 2_000_000, 1 << 20
#: A word is frequent if it has this share of a shard's tokens.
FREQUENT = 8
END = mix(np.array([0xE4D], np.uint64))[0]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A pair as the context of triples: its words, how often it was followed, followers seen once, twice, more often.
_CONTEXT = ("cu", "cw", "total", "n1", "n2", "n3")


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens with each row's end, where each row's tokens begin)."""
    buf, off = raw_utf8(column)
    for i, j in doc_chunks(off, SCORE_BYTES):
        part, rel = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = word_spans(part, rel)
        words = hash_spans(part, starts, ends, True)
        begins = first + np.arange(j - i + 1)
        out = np.empty(len(words) + j - i, np.uint64)
        is_end = np.zeros(len(out), bool)
        is_end[begins[1:] - 1] = True
        out[is_end] = END
        out[~is_end] = words
        yield i, j, out, begins


def before(ids: np.ndarray, begins: np.ndarray, first: int) -> np.ndarray:
    """What stands before each token; ``first`` before a text's first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[begins[:-1]] = first
    return out


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, values summed."""
    order = np.argsort(keys)
    keys = keys[order]
    at = _runs(keys)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    """The shard of a hash; shards are ranges of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte of their width, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<BI", width, len(values)) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(rows: pa.ChunkedArray) -> np.ndarray:
    out = []
    for data in rows.to_pylist():
        width, n = struct.unpack_from("<BI", data)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(pa.decompress(data[5:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T if n else 0
        out.append(wide.view("<u8")[:, 0].astype(np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _counts(rows: pa.ChunkedArray) -> np.ndarray:
    return _unpack(rows).astype(np.int64)


def _coded(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts side by side as a byte: (frequent rows, where others are, their values, codes); 255 stands for the others."""
    wide = np.stack(columns, 1).astype(np.int64)
    bits = 32 if len(columns) == 1 else 8
    small = np.flatnonzero((wide < 1 << bits).all(1))
    packed = np.zeros(len(small), np.uint64)
    for k in range(len(columns)):
        packed |= wide[small, k].astype(np.uint64) << np.uint64(bits * k)
    values, where, many = np.unique(packed, return_inverse=True, return_counts=True)
    often = np.argsort(-many, kind="stable")[:255]
    code_of = np.full(len(values), 255, np.uint8)
    code_of[often] = np.arange(len(often))
    codes = np.full(len(wide), 255, np.uint8)
    codes[small] = code_of[where]
    rows = np.stack([(values[often] >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1) for k in range(len(columns))], 1).astype(np.int64)
    rest = np.flatnonzero(codes == 255)
    return rows, rest.astype(np.int64), wide[rest], codes


def _write_table(uri: str, name: str, keys: np.ndarray, *groups: tuple[np.ndarray, ...]) -> None:
    """Sorted keys (or none) and groups of counts, each a code in a list of its frequent rows.

    Of many keys only the lower 48 bits are kept, with where each value of the upper 16 begins.
    """
    made = [_coded(g) for g in groups]
    split = len(keys) >= 1 << 16
    if split:
        begin = np.searchsorted(keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.int64)
        held = (begin, (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16))
    else:
        held = (keys,)
    head = [len(keys), len(groups[0][0]), int(split), *(x for rows, rest, _, _ in made for x in (*rows.shape, len(rest)))]
    lists = [x.ravel() for rows, rest, other, _ in made for x in (rows, rest, other)]
    shared_files.write(uri, name, np.array(head, np.int64), *lists, *held, *(codes for *_, codes in made))


class _Table:
    """Reads such a file from mapped memory."""

    def __init__(self, data: memoryview, groups: int):
        n, rows, self.split, *shapes = np.frombuffer(data, np.int64, 3 + 3 * groups).tolist()
        at = 8 * (3 + 3 * groups)

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.n, self.groups = n, []
        for k in range(groups):
            m, width, others = shapes[3 * k : 3 * k + 3]
            self.groups.append((take(np.int64, m * width).reshape(m, width), take(np.int64, others), take(np.int64, others * width).reshape(others, width)))
        if self.split:
            self.begin, self.low, self.mid = take(np.int64, (1 << 16) + 1), take(np.uint32, n), take(np.uint16, n)
        else:
            self.keys = take(np.uint64, n)
        self.codes = [take(np.uint8, rows) for _ in range(groups)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and whether they are there."""
        if not self.split:
            at = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
            return at, self.keys[at] == keys
        top = (keys >> np.uint64(48)).astype(np.int64)
        lo, hi, own = self.begin[top], self.begin[top + 1], keys & np.uint64((1 << 48) - 1)
        end = hi
        held = lambda at: self.mid[at].astype(np.uint64) << np.uint64(32) | self.low[at]
        while (open_ := lo < hi).any():
            middle = (lo + hi) >> 1
            less = (held(np.minimum(middle, self.n - 1)) < own) & open_
            lo, hi = np.where(less, middle + 1, lo), np.where(less | ~open_, hi, middle)
        at = np.minimum(lo, self.n - 1)
        return at, (lo < end) & (held(at) == own)

    def rows(self, at: np.ndarray) -> list[np.ndarray]:
        """The counts at some places."""
        out: list[np.ndarray] = []
        for codes, (often, rest, other) in zip(self.codes, self.groups):
            code = codes[at]
            v = often[np.minimum(code, max(len(often) - 1, 0))] if len(often) else np.zeros((len(at), often.shape[1]), np.int64)
            big = np.flatnonzero(code == 255)
            if len(big):
                v[big] = other[np.searchsorted(rest, at[big])]
            out += list(v.T)
        return out


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a pair of ids, or of a pair's hash and an id."""
    return mix(mix(u.astype(np.uint64) * _STEP) + w.astype(np.uint64))


class Vocabulary:
    """Ids of words from the files of their hashes: rank by frequency in the shard, times the
    number of shards, plus the shard, plus 1. 0 stands for nothing and for unknown words."""

    def __init__(self, about: dict):
        self.about, self.n = about, about["n_word_shards"]
        self._files: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _file(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        if s not in self._files:
            data = shared_files.mapped(self.about["uri"], f"ids-{s}")
            n = int(np.frombuffer(data, np.int64, 1)[0])
            self._files[s] = np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 16 * n)
        return self._files[s]

    def ids(self, h: np.ndarray) -> np.ndarray:
        every, where = _distinct(h)
        out = np.zeros(len(every), np.uint64)
        cuts = np.searchsorted(_shard(every, self.n), np.arange(self.n + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            if s in self.about["types_of"]:
                a, b = cuts[s], cuts[s + 1]
                keys, rank = self._file(s)
                at = np.minimum(np.searchsorted(keys, every[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[at] == every[a:b], rank[at].astype(np.uint64) * np.uint64(self.n) + np.uint64(s + 1), 0)
        return out[where]


def _word_shard(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids - np.uint64(1)) % np.uint64(n)).astype(np.int64)


def _rank(ids: np.ndarray, n: int) -> np.ndarray:
    return ((ids - np.uint64(1)) // np.uint64(n)).astype(np.int64)


def _among(ids: np.ndarray, about: dict) -> np.ndarray:
    """Whether words are frequent; the start mark and nothing are."""
    limits = about["limits"]
    some = ids > 0
    out = ~some | (ids == about["start"])
    out[some] |= _rank(ids[some], len(limits)) < limits[_word_shard(ids[some], len(limits))]
    return out


def _pair_place(u: np.ndarray, w: np.ndarray, about: dict) -> np.ndarray:
    """Shards of pairs are ranges of this; pairs of one first word lie together unless it is frequent."""
    return np.where(_among(u, about), pair_key(u, w), mix(u * _STEP))


def _triple_place(t: np.ndarray, u: np.ndarray, key: np.ndarray, about: dict) -> np.ndarray:
    """Shards of triples are ranges of this; triples of one context lie together unless its words are frequent."""
    return np.where(_among(t, about) & _among(u, about), key, pair_key(t, u))


def _count_words(texts: DataFrame, shards: int, uri: str) -> DataFrame:
    """Counts words and writes each shard's hashes, counts and ranks; (shard, types, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def fold() -> None:
            nonlocal keys, counts, held
            if held:
                new = np.sort(np.concatenate(held))
                at = _runs(new)
                keys, counts = _summed(np.concatenate((keys, new[at])), np.concatenate((counts, np.diff(np.append(at, len(new))))))
                held = []

        size = 0
        for batch in batches:
            for _, _, toks, _ in tokens(batch.column(0)):
                held.append(toks)
                size += len(toks)
                if size > COUNT_TOKENS:
                    fold()
                    size = 0
        fold()
        cuts = np.searchsorted(_shard(keys, shards), np.arange(shards + 1))
        rows = [(s, keys[a:b].tobytes(), _pack(counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _summed(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64), _counts(table.column("counts")))
        order = np.lexsort((keys, -counts))
        rank = np.empty(len(keys), np.uint32)
        rank[order] = np.arange(len(keys))
        shared_files.write(uri, f"ids-{key[0].as_py()}", np.array([len(keys)], np.int64), keys, counts[order], rank)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "types": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    dealt = texts.mapInArrow(run, "shard long, keys binary, counts binary")
    return dealt.groupBy("shard").applyInArrow(merge, "shard long, types long, tokens long")


def _ranked_counts(uri: str, s: int) -> np.ndarray:
    data = shared_files.mapped(uri, f"ids-{s}")
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int64, n, 8 + 8 * n)


def _limits(words: DataFrame, uri: str, shards: int, least: int) -> np.ndarray:
    """How many words of each shard occur at least so often (a number a shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([int(np.searchsorted(-_ranked_counts(uri, s), -least, "right")) for s in own], pa.int64())], ["shard", "n"])

    out = np.zeros(shards, np.int64)
    for r in words.select("shard").mapInArrow(run, "shard long, n long").collect():
        out[r["shard"]] = r["n"]
    return out


def _grams(held: list[tuple[np.ndarray, ...]], place) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """(places in order, distinct grams, their counts)."""
    grams = tuple(np.concatenate(x) for x in zip(*held))
    held.clear()
    key = grams[0]
    for g in grams[1:]:
        key = pair_key(key, g)
    order = np.argsort(key)
    at = _runs(key[order])
    count, some = np.diff(np.append(at, len(key))), order[at]
    grams, by = tuple(g[some] for g in grams), place(*(g[some] for g in grams), key[some])
    order = np.lexsort((*reversed(grams), by))
    return by[order], tuple(g[order] for g in grams), count[order]


def _dealt(by: np.ndarray, grams: tuple[np.ndarray, ...], count: np.ndarray, shards: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each shard: contexts (all ids but the last) with how many grams each has, the last ids, counts."""
    cuts = np.searchsorted(_shard(by, shards), np.arange(shards + 1))
    rows = []
    for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        a, b = cuts[s], cuts[s + 1]
        own = [g[a:b] for g in grams]
        new = np.concatenate(([True], np.any([g[1:] != g[:-1] for g in own[:-1]], axis=0)))
        runs = np.flatnonzero(new)
        rows.append((s, *(_pack(g[runs]) for g in own[:-1]), _pack(np.diff(np.append(runs, b - a))), _pack(own[-1]), _pack(count[a:b])))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(zip(*rows))], names)


def _count_grams(texts: DataFrame, shards: int, about: dict, order: int) -> DataFrame:
    """(shard, t, u, runs, w, counts), without t for pairs: grams of some texts. A text's first
    token follows the start mark, and as a triple nothing and the start mark."""
    names = ["shard", *(("t",) if order > 2 else ()), "u", "runs", "w", "counts"]

    def place(*grams: np.ndarray) -> np.ndarray:
        *ids, key = grams
        return _pair_place(ids[0], ids[1], about) if order == 2 else _triple_place(ids[0], ids[1], key, about)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        vocabulary, size = Vocabulary(about), 0
        for batch in batches:
            for _, _, toks, begins in tokens(batch.column(0)):
                w = vocabulary.ids(toks)
                u = before(w, begins, about["start"])
                held.append((u, w) if order == 2 else (before(u, begins, 0), u, w))
                size += len(toks)
                if size > COUNT_TOKENS:
                    yield from _dealt(*_grams(held, place), shards, names)
                    size = 0
        if held:
            yield from _dealt(*_grams(held, place), shards, names)

    return texts.mapInArrow(run, ", ".join(f"{c} {'binary' if i else 'long'}" for i, c in enumerate(names)))


def _write_triples(dealt: DataFrame, pair_shards: int, about: dict) -> DataFrame:
    """Sums each shard's triples and writes them, and for each shard of pairs the numbers N(.uw)
    and the pairs' sums as contexts; (shard, histogram).

    The latter are files in the shared folder too, which survive lost executors, so that
    the triples' shuffle can be removed before the pairs are summed.
    """

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        runs = _counts(table.column("runs"))
        t, u = (np.repeat(_unpack(table.column(x)), runs) for x in ("t", "u"))
        w, c = _unpack(table.column("w")), _counts(table.column("counts"))
        keys = pair_key(pair_key(t, u), w)
        order = np.argsort(keys)
        keys = keys[order]
        at = _runs(keys)
        c = np.add.reduceat(c[order], at)
        keys, t, u, w = keys[at], t[order[at]], u[order[at]], w[order[at]]
        whole = t > 0
        _write_table(about["uri"], f"triples-{key[0].as_py()}", keys[whole], (c[whole],))

        def by_pair(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            """Where the pairs' shards begin; the pairs and their sums, by shard."""
            order = np.argsort(pair_key(a, b))
            a, b = a[order], b[order]
            at = _runs(pair_key(a, b))
            sums = [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]
            a, b = a[at], b[at]
            place = _pair_place(a, b, about)
            order = np.lexsort((b, a, place))
            return np.searchsorted(_shard(place[order], pair_shards), np.arange(pair_shards + 1)), [x[order] for x in (a, b, *sums)]

        cuts, (v, x, seen) = by_pair(u, w, np.where(whole, 1, c))
        t, u, c = t[whole], u[whole], c[whole]
        context_cuts, (f, g, *own) = by_pair(t, u, c, *(((c == k) if k < 3 else (c >= 3)).astype(np.int64) for k in (1, 2, 3)))
        parts: list[bytes] = []
        for s in range(pair_shards):
            a, b, d, e = cuts[s], cuts[s + 1], context_cuts[s], context_cuts[s + 1]
            runs = _runs(v[a:b])
            columns = [] if a == b and d == e else [v[a:b][runs], np.diff(np.append(runs, b - a)) if b > a else runs, x[a:b], seen[a:b], *(o[d:e] for o in (f, g, *own))]
            data = [_pack(column) for column in columns]
            parts.append(struct.pack(f"<{len(data)}I", *map(len, data)) + b"".join(data))
        places = np.cumsum([0, *map(len, parts)]).astype(np.int64)
        shared_files.write(about["uri"], f"sent-{key[0].as_py()}", places, np.frombuffer(b"".join(parts), np.uint8))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([[int((c == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64()))], ["shard", "histogram"])

    return dealt.groupBy("shard").applyInArrow(merge, "shard long, histogram array<long>")


def _sent(about: dict, senders: list[int], shard: int) -> pa.Table:
    """What the shards of triples wrote for a shard of pairs, in rows like those of :func:`_count_grams`."""
    names, rows = ["u", "runs", "w", "counts", *_CONTEXT], []
    for s in senders:
        data = shared_files.mapped(about["uri"], f"sent-{s}")
        a, b = np.frombuffer(data, np.int64, about["n_pair_shards"] + 1)[shard : shard + 2].tolist()
        own = bytes(data[8 * (about["n_pair_shards"] + 1) :][a:b])
        if own:
            cuts = np.cumsum([4 * len(names), *struct.unpack_from(f"<{len(names)}I", own)]).tolist()
            rows.append([own[x:y] for x, y in zip(cuts, cuts[1:])])
    return pa.table({n: pa.chunked_array([pa.array([r[i] for r in rows], pa.binary())]) for i, n in enumerate(names)})


def _write_pairs(spark: SparkSession, dealt: DataFrame, about: dict) -> tuple[DataFrame, list[int]]:
    """Sums each shard's pairs and writes them; (target, ...) what each shard of words needs of
    them, and how many triples occur once, twice, three and four times.

    ``dealt`` has the pairs for order 2, and for order 3 what :func:`_write_triples` gave.
    """
    n = about["n_word_shards"]
    senders, triples = [], [0] * 4
    if about["order"] > 2:
        senders = [r["shard"] for r in dealt.select("shard").collect()]
        triples = list(dealt.select(*(F.sum(F.col("histogram")[i]).alias(f"s{i}") for i in range(4))).first())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                table = _sent(about, senders, s)
                if table.num_rows:
                    yield merge((pa.scalar(s),), table).to_batches()[0]

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        u, w = np.repeat(_unpack(table.column("u")), _counts(table.column("runs"))), _unpack(table.column("w"))
        keys, c = pair_key(u, w), _counts(table.column("counts"))
        order = np.argsort(keys)
        at = _runs(keys[order])
        c = np.add.reduceat(c[order], at) if len(at) else c
        keys, u, w = keys[order[at]], u[order[at]], w[order[at]]
        as_context = []
        if about["order"] > 2:
            found, *sums = _summed(pair_key(*(_unpack(table.column(x)) for x in _CONTEXT[:2])), *(_counts(table.column(x)) for x in _CONTEXT[2:]))
            at = np.searchsorted(keys, found)
            as_context = [np.zeros(len(keys), np.int64) for _ in sums]
            for to, values in zip(as_context, sums):
                to[at] = values
        _write_table(about["uri"], f"pairs-{key[0].as_py()}", keys, (c,), *([tuple(as_context)] if as_context else []))
        contexts, *own = _summed(u, *(x.astype(np.int64) for x in (c, c == 1, c == 2, c >= 3)))
        seen, many = _summed(w, np.ones(len(w), np.int64))
        histogram = [*(int((c == k).sum()) for k in (1, 2, 3, 4)), len(c)]
        by_u, by_w = (np.argsort(_word_shard(x, n), kind="stable") for x in (contexts, seen))
        cut_u, cut_w = (np.searchsorted(_word_shard(x, n)[o], np.arange(n + 1)) for x, o in ((contexts, by_u), (seen, by_w)))
        rows = []
        for s in range(n):
            a, b = by_u[cut_u[s] : cut_u[s + 1]], by_w[cut_w[s] : cut_w[s + 1]]
            if len(a) or len(b) or s == 0:
                rows.append((s, _pack(_rank(contexts[a], n)), *(_pack(x[a]) for x in own), _pack(_rank(seen[b], n)), _pack(many[b]), histogram if s == 0 else [0] * 5))
        kinds = [pa.int64(), *[pa.binary()] * 7, pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["target", "u", "total", "n1", "n2", "n3", "w", "before", "histogram"])

    schema = "target long, u binary, total binary, n1 binary, n2 binary, n3 binary, w binary, before binary, histogram array<long>"
    if about["order"] == 2:
        return dealt.groupBy("shard").applyInArrow(merge, schema), triples
    shards = spark.range(0, about["n_pair_shards"], 1, max(1, min(about["n_pair_shards"], 4 * spark.sparkContext.defaultParallelism, 100_000)))
    return shards.mapInArrow(read, schema), triples


def _write_words(needed: DataFrame, about: dict) -> DataFrame:
    """Writes what is known of words, by rank; sums of counts of counts for the discounts."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        counts = _ranked_counts(about["uri"], s) if s in about["types_of"] else np.zeros(0, np.int64)
        if s == 0:  # the start mark, a context only, comes last
            counts = np.append(counts, 0)

        def summed(at: str, name: str) -> np.ndarray:
            out = np.zeros(len(counts), np.int64)
            rank, value = _summed(_unpack(table.column(at)), _counts(table.column(name)))
            out[rank.astype(np.int64)] = value
            return out

        seen = summed("w", "before")
        _write_table(about["uri"], f"words-{s}", np.zeros(0, np.uint64), *((x,) for x in (counts, summed("u", "total"), seen, *(summed("u", x) for x in ("n1", "n2", "n3")))))
        pairs = [sum(x) for x in zip(*table.column("histogram").to_pylist())]
        sums = pairs[:5] + [int((seen == k).sum()) for k in (1, 2, 3, 4)] + [int((seen >= 3).sum())]
        return pa.Table.from_arrays([pa.array([sums], pa.list_(pa.int64()))], ["sums"])

    return needed.groupBy("target").applyInArrow(merge, "sums array<long>")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else 0.0
        out.append(min(max(d, 0.0), float(k)))
    return np.array(out)


class Model:
    """The arrays in the shared folder, mapped when first needed."""

    def __init__(self, about: dict):
        self.about = about
        self._files: dict[str, _Table] = {}
        self.vocabulary = Vocabulary(about)
        self.triple_discount, self.pair_discount, self.word_discount = (discounts(*about[x]) for x in ("triple_counts", "pair_counts", "word_counts"))
        n = about["word_counts"]
        mass = self.word_discount[1] * n[0] + self.word_discount[2] * n[1] + self.word_discount[3] * about["word_many"]
        self.pairs = about["pairs"]
        self.floor = (mass / self.pairs if self.pairs else 1.0) / (about["types"] + 1)

    def _table(self, name: str, groups: int) -> _Table:
        if name not in self._files:
            self._files[name] = _Table(shared_files.mapped(self.about["uri"], name), groups)
        return self._files[name]

    def words(self, ids: np.ndarray) -> list[np.ndarray]:
        """count, and as a context how often it was followed; words before it; followers seen once, twice, more often."""
        out = [np.zeros(len(ids), np.int64) for _ in range(6)]
        n, some = self.about["n_word_shards"], np.flatnonzero(ids > 0)
        shard = _word_shard(ids[some], n)
        some, shard = some[np.argsort(shard, kind="stable")], np.sort(shard)
        cuts = np.searchsorted(shard, np.arange(n + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            rows = some[cuts[s] : cuts[s + 1]]
            for o, v in zip(out, self._table(f"words-{s}", 6).rows(_rank(ids[rows], n))):
                o[rows] = v
        return out

    def _found(self, kind: str, key: np.ndarray, place: np.ndarray, columns: int) -> list[np.ndarray]:
        """Values of keys in any order; 0 where absent."""
        shard = _shard(place, self.about["n_pair_shards"])
        out = [np.zeros(len(key), np.int64) for _ in range(columns)]
        order = np.argsort(key)
        order = order[np.argsort(shard[order], kind="stable")]
        cuts = np.searchsorted(shard[order], np.arange(self.about["n_pair_shards"] + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            if s not in self.about[f"{kind}_shards"]:
                continue
            rows, table = order[cuts[s] : cuts[s + 1]], self._table(f"{kind}-{s}", min(columns, 2))
            if table.n:
                at, hit = table.find(key[rows])
                for o, v in zip(out, table.rows(at)):
                    o[rows] = np.where(hit, v, 0)
        return out

    def pairs_of(self, u: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """count, and with order 3 as a context: how often it was followed, followers seen once, twice, more often."""
        return self._found("pairs", pair_key(u, w), _pair_place(u, w, self.about), 1 if self.about["order"] < 3 else 5)

    def triple_counts(self, t: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = pair_key(pair_key(t, u), w)
        return self._found("triples", key, _triple_place(t, u, key, self.about), 1)[0]

    def score(self, toks: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each row."""
        every, where = _distinct(toks)
        names = np.append(self.vocabulary.ids(every), np.uint64(self.about["start"]))
        count, followed, before, n1, n2, n3 = self.words(names)
        total = self.about["tokens"] + self.about["types"] + 1
        base = np.log10((count[:-1] + 1) / total)[where]
        known = (count[:-1] > 0)[where]
        one = self.floor + np.maximum(before - self.word_discount[np.minimum(before, 3)], 0) / max(self.pairs, 1)
        # As a context: how often it was followed, and the mass that its discounts leave.
        d = self.pair_discount
        left = np.where((followed > 0) & (n1 + n2 + n3 > 0), (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(followed, 1), 1.0)
        previous = np.empty_like(where)
        previous[1:] = where[:-1]
        previous[begins[:-1]] = len(every)
        u, w = names[previous], names[where]
        c, *as_context = self.pairs_of(u, w)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(followed[previous], 1) + left[previous] * one[where]
        if as_context:
            # The pair before a token is its context; a text's first token has none.
            later = np.ones(len(toks), bool)
            later[begins[:-1]] = False
            later = np.flatnonzero(later)
            followed, n1, n2, n3 = (x[later - 1].astype(np.float64) for x in as_context)
            c, d = self.triple_counts(u[later - 1], u[later], w[later]), self.triple_discount
            left = np.where(followed > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(followed, 1), 1.0)
            p[later] = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(followed, 1) + left * p[later]
        return np.add.reduceat(known, begins[:-1], dtype=np.int64), np.add.reduceat(base, begins[:-1]), np.add.reduceat(np.log10(p), begins[:-1])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    ordered = h[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    where = np.empty(len(h), np.int64)
    where[order] = np.cumsum(new) - 1
    return ordered[new], where


def train(texts: DataFrame, text: str = "text", order: int = 2) -> dict:
    """Counts all rows of ``texts``, writes the model, and says what a :class:`Model` needs to know."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = ready(texts.sparkSession)
    uri = shared_uri(spark)
    texts = texts.select(F.col(text).alias("t"))
    # Shards of words grow with the input's partitions, but more slowly, as vocabularies do.
    word_shards = max(1, round(texts.rdd.getNumPartitions() ** 0.75))
    words = materialised(_count_words(texts, word_shards, uri))
    types_of = {r["shard"]: r["types"] for r in words.select("shard", "types").collect()}
    n_tokens, n_types = (int(x or 0) for x in words.agg(F.sum("tokens"), F.sum("types")).first())
    about = {"uri": uri, "order": order, "tokens": n_tokens, "types": n_types, "pairs": 0, "triple_counts": (0, 0, 0, 0), "triples_shards": set(), "pair_counts": (0, 0, 0, 0), "word_counts": (0, 0, 0, 0), "word_many": 0, "pairs_shards": set(), "n_word_shards": word_shards, "n_pair_shards": 1}
    # The start mark is the word after the last of the first shard.
    about |= {"types_of": types_of, "limits": np.zeros(word_shards, np.int64), "start": types_of.get(0, 0) * word_shards + 1}
    if not n_tokens:
        return about | {"start": 0}
    pair_shards = -(-n_tokens // SHARD_TOKENS)
    if pair_shards > 1:
        about["limits"] = _limits(words, uri, word_shards, max(2, n_tokens // (FREQUENT * pair_shards)))
    about["n_pair_shards"] = pair_shards
    dealt = _count_grams(texts, pair_shards, about, order)
    if order > 2:
        dealt = materialised(_write_triples(dealt, pair_shards, about))
        release(spark)
    needed, triples = _write_pairs(spark, dealt, about)
    done = materialised(_write_words(needed, about))
    sums = done.select(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(10))).first()
    _remove(spark, uri, "sent-*")
    made = _listed(spark, uri)
    return about | {
        "pairs": sums[4],
        "triple_counts": tuple(int(x or 0) for x in triples),
        "pair_counts": tuple(sums[:4]),
        "word_counts": tuple(sums[5:9]),
        "word_many": sums[9],
        **{f"{k}_shards": {int(x.split("-")[1]) for x in made if x.startswith(f"{k}-")} for k in ("triples", "pairs")},
    }


def _listed(spark: SparkSession, uri: str) -> list[str]:
    """Names of the model's files (one for each shard)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return [x.getPath().getName() for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]


def _remove(spark: SparkSession, uri: str, names: str) -> None:
    """Removes files that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{uri}/{names}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(path):
        store.delete(found.getPath(), False)


def score(docs: DataFrame, about: dict, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, base_score and score."""
    made = ["n_tokens", "n_known", "base_score", "score"]
    others = [c for c in docs.columns if c not in [text, *made]]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "n_tokens long, n_known long, base_score double, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(about)
        for batch in batches:
            for i, j, toks, begins in tokens(batch.column(0)):
                known, base, full = model.score(toks, begins)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(rows.column(k + 1) for k in range(len(others))), pa.array(np.diff(begins), pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(full)], [*others, *made])

    return docs.select(text, *others).mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """The contract's row per document."""
    marked = docs.select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    about = train(marked.filter(~F.col("held_out")), order=order)
    return score(marked, about).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(about["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
