"""Phrase collocations by suffix sorting (Suffix-sigma).

Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into
words ``[^\\x20\\x09]+``.  Every word starts a suffix of at most ``max_words`` words of
its piece.  Suffixes are counted within tasks, dealt by language and first words, sorted
in reverse lexicographic order, and one stack counts all their prefixes as they go by:
that gives the number of occurrences of every phrase from one row a word.  Phrases
below ``least`` go; their parts, which are at least as frequent, are joined afterwards.

A suffix travels as a binary key: codes of its language and words, none the prefix of
another, so keys that share words lie together in byte order.  Words that are frequent
in a sample of documents have codes of 1 to 3 bytes, all others are spelled out.  The
key space is cut into ranges by the same sample; a frequent first word fills several.
A prefix that a range's border may cut is given in parts, which are added up.  So the
sample settles how rows travel and not what is counted.

Null texts count as empty, a null language as ``und``.  Empty texts give nothing, very
long ones are read whole.  Repeated rows count each time.  An empty table gives an
empty result.  Only the columns of text and language are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import materialised, ready
from foldspark.llm.textvec import blocks, doc_chunks, raw_utf8, word_spans

#: Suffixes that a task holds before it counts equal ones and hands them on.
HELD = 1 << 20
#: Keys that go through the stack at a time.
PUSHED = 1 << 16
#: Documents, words and languages of the sample that codes are made from, and ranges for each partition of a shuffle.
SAMPLE, WORDS, LANGS, RANGES = 4096, 1 << 16, 64, 4
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_OUTSIDE = _CUTS.copy()
_OUTSIDE[[0x20, 0x09]] = True

# The code of the n-th word: one byte below 192, or one of 48 and a byte, or one of 15 and two bytes, none of which is
# 255 but the first of a word that is spelled out and the byte that ends it (UTF-8 has no 255).
_ONE, _TWO, _SPELLED = 192, 48, 255
_SIZES = np.ones(256, np.int64)
_SIZES[_ONE : _ONE + _TWO] = 2
_SIZES[_ONE + _TWO : _SPELLED] = 3


def code(n: int) -> bytes:
    if n < _ONE:
        return bytes((n,))
    if (n := n - _ONE) < _TWO * 255:
        return bytes((_ONE + n // 255, n % 255))
    n -= _TWO * 255
    return bytes((_ONE + _TWO + n // 255**2, n // 255 % 255, n % 255))


class Codes:
    """Codes of the languages and words given, most frequent first; others are spelled out."""

    def __init__(self, langs: list[str], words: list[str]):
        self.langs = {x: code(i) for i, x in enumerate(langs)}
        self.words, self.value_set = words, pa.array(words, pa.string())
        self.of = [code(i) for i in range(len(words))]
        self.back = dict(zip(self.of, words))
        self.back_langs = {v: k for k, v in self.langs.items()}

    def lang(self, name: str) -> bytes:
        return self.langs.get(name) or b"\xff" + name.encode() + b"\xff"

    def encoded(self, words: pa.Array) -> list[bytes]:
        """The code of each (different) word."""
        at = pc.index_in(words, value_set=self.value_set).to_pylist()
        return [b"\xff" + w.encode() + b"\xff" if i is None else self.of[i] for i, w in zip(at, words.to_pylist())]

    def decoded(self, key: bytes) -> tuple[str, list[str]]:
        """Language and words of a key."""
        out, at = [], 0
        while at < len(key):
            if key[at] == _SPELLED:
                end = key.index(b"\xff", at + 1) + 1
                out.append(key[at + 1 : end - 1].decode())
            else:
                end = at + int(_SIZES[key[at]])
                out.append((self.back if out else self.back_langs)[key[at:end]])
            at = end
        return out[0], out[1:]


def gathered(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after the other, and the offsets between them."""
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    return buf[np.repeat(starts - off[:-1], sizes) + np.arange(off[-1])], off


def _binary(buf: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])


def pieces(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """By chunk of rows: (row of each word, the words, where its piece ends among them, first row and end of the chunk)."""
    buf, off = raw_utf8(column)
    for i, j in doc_chunks(off, most):
        part, rel = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = word_spans(part, rel, _OUTSIDE)
        if not len(starts):
            continue
        row = np.repeat(np.arange(i, j), np.diff(first))
        cuts = np.cumsum(_CUTS[part])[starts]
        fresh = np.append(True, (row[1:] != row[:-1]) | (cuts[1:] != cuts[:-1]))
        at = np.flatnonzero(fresh)
        until = np.repeat(np.append(at[1:], len(row)), np.diff(np.append(at, len(row))))
        yield row, _binary(*gathered(_LOWER[part], starts, ends - starts), pa.string()).dictionary_encode(), until


def suffixes(texts: pa.Array, langs: pa.Array, codes: Codes, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By chunk: keys of all suffixes, as bytes and offsets."""
    names = pc.fill_null(langs, UNKNOWN).dictionary_encode()
    heads = [codes.lang(x) for x in names.dictionary.to_pylist()]
    lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for row, words, until in pieces(texts):
        made = codes.encoded(words.dictionary)
        pool = np.frombuffer(b"".join(heads + made), np.uint8)
        size = np.array([*map(len, heads), *map(len, made)], np.int64)
        begin = np.cumsum(size) - size
        at = words.indices.to_numpy(zero_copy_only=False) + len(heads)
        coded, off = gathered(pool, begin[at], size[at])
        n = len(row)
        end = np.minimum(np.arange(n) + max_words, until)
        # A key is two spans: its language and its words.
        spans, sizes = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64)
        spans[0::2], sizes[0::2] = begin[lang[row]], size[lang[row]]
        spans[1::2], sizes[1::2] = off[:-1] + len(pool), off[end] - off[:-1]
        keys, both = gathered(np.concatenate((pool, coded)), spans, sizes)
        yield keys, both[0::2]


def first_bytes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each key as a signed integer in the order of bytes."""
    size = np.minimum(np.diff(off), 8).astype(np.uint64)
    low = blocks(buf)[off[:-1]].byteswap()
    mask = np.where(size == 8, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(8 * size, 63).astype(np.uint64))
    return ((low & ~mask) ^ np.uint64(1 << 63)).view(np.int64)


def counted(docs: DataFrame, codes: Codes, max_words: int, borders: list[int], text: str, lang: str) -> DataFrame:
    """(range, key, n): the suffixes of ``docs``, equal ones of a task's share counted."""
    cuts = np.array(borders, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> Iterator[pa.RecordBatch]:
            by = pa.chunked_array(held).combine_chunks().value_counts()
            key, n = by.field("values"), by.field("counts")
            _, offsets, data = key.buffers()
            off = np.frombuffer(offsets, np.int32)[key.offset : key.offset + len(key) + 1].astype(np.int64)
            where = np.searchsorted(cuts, first_bytes(np.frombuffer(data, np.uint8), off), "right")
            made = pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), key, n], ["range", "key", "n"])
            for k in range(0, len(made), 1 << 16):
                yield made.slice(k, 1 << 16)

        for batch in batches:
            for buf, off in suffixes(batch.column(0), batch.column(1), codes, max_words):
                held.append(_binary(buf, off, pa.binary()))
            if sum(map(len, held)) >= HELD:
                yield from out()
                held.clear()
        if held:
            yield from out()

    return docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(run, "range int, key binary, n long")


def shared_prefix(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes that each key shares with the one before it; 0 for the first."""
    by, start = blocks(buf), off[:-1]
    size = np.diff(off)
    out = np.zeros(len(size), np.int64)
    most = np.minimum(size[1:], size[:-1])
    left, at = np.arange(1, len(size)), 0
    while len(left):
        x = by[start[left] + at] ^ by[start[left - 1] + at]
        same = (x == 0) & (at + 8 < most[left - 1])
        done = left[~same]
        lowest = x[~same]
        out[done] = np.where(lowest == 0, 8, np.searchsorted(_BYTES, lowest & (~lowest + np.uint64(1)), "right")) + at
        left, at = left[same], at + 8
    out[1:] = np.minimum(out[1:], most)
    return out


_BYTES = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)


def word_ends(buf: np.ndarray, off: np.ndarray, levels: int) -> np.ndarray:
    """(levels, keys): where the key's language and each of its words end; -1 beyond the last."""
    marks = np.flatnonzero(buf == _SPELLED)
    out = np.full((levels, len(off) - 1), -1, np.int64)
    left, at = np.arange(len(off) - 1), off[:-1].copy()
    for k in range(levels):
        on = at < off[left + 1]
        left, at = left[on], at[on]
        spelled = buf[at] == _SPELLED
        end = at + _SIZES[buf[at]]
        end[spelled] = marks[np.searchsorted(marks, at[spelled]) + 1] + 1
        out[k, left] = at = end
    return out


class Stack:
    """Counts the prefixes of keys that come in order: for each number of words the prefix
    that is open, what it has counted and whether it began with its range."""

    def __init__(self, codes: Codes, levels: int, least: int):
        self.codes, self.levels, self.least = codes, levels, least
        self.key: bytes | None = None
        self.range, self.sums, self.began = -1, [0] * levels, [False] * levels

    def push(self, ranges: np.ndarray, buf: np.ndarray, off: np.ndarray, n: np.ndarray) -> Iterator[tuple[str, int, str, int]]:
        """The prefixes (language, number of words, words, count) that these keys close."""
        held = self.key is not None
        if held:
            buf = np.concatenate((np.frombuffer(self.key, np.uint8), buf))
            off = np.concatenate(([0], off + len(self.key)))
            ranges, n = np.append(self.range, ranges), np.append(0, n)
        shared = shared_prefix(buf, off) + off[:-1]
        ends = word_ends(buf, off, self.levels)
        edge = np.append(not held, ranges[1:] != ranges[:-1])
        for k in range(self.levels):
            there = ends[k] >= 0
            fresh = edge | ~there | (ends[k] > shared)
            fresh[0] = True
            at = np.flatnonzero(fresh)
            weights = n.copy()
            weights[0] += self.sums[k] if held else 0
            sums, began = np.add.reduceat(weights, at), edge[at].copy()
            if held:
                began[0] = self.began[k]
            whole = ~(began[:-1] | edge[at[1:]])
            told = np.flatnonzero(there[at[:-1]] & (~whole | (sums[:-1] >= self.least)))
            for j in told.tolist():
                i = at[j]
                yield self._told(buf[off[i] : ends[k][i]].tobytes(), k, int(sums[j]))
            self.sums[k], self.began[k] = int(sums[-1]), bool(began[-1])
        self.key, self.range = buf[off[-2] : off[-1]].tobytes(), int(ranges[-1])

    def close(self) -> Iterator[tuple[str, int, str, int]]:
        """The prefixes still open; they may go on in another range."""
        if self.key is not None:
            ends = word_ends(np.frombuffer(self.key, np.uint8), np.array([0, len(self.key)]), self.levels)[:, 0]
            for k in np.flatnonzero(ends >= 0).tolist():
                yield self._told(self.key[: ends[k]], k, self.sums[k])

    def _told(self, key: bytes, k: int, n: int) -> tuple[str, int, str, int]:
        lang, words = self.codes.decoded(key)
        return lang, k, " ".join(words), n


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches together, as tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


_COUNTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _sample(docs: DataFrame, text: str, lang: str, max_words: int) -> tuple[Codes, list[int]]:
    """Codes and borders of ranges from about ``SAMPLE`` documents."""
    spark = docs.sparkSession
    few = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    n = few.select("lang").count()
    some = materialised(few.sample(min(1.0, SAMPLE / max(n, 1)), 7) if n > SAMPLE else few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, _ in pieces(batch.column(0)):
                by = words.value_counts()
                yield pa.RecordBatch.from_arrays([by.field("values").dictionary_decode(), by.field("counts")], ["word", "n"])

    # Long words would make a bounded number of them a large table.
    told = some.mapInArrow(run, "word string, n long").filter("length(word) <= 64").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r[0] for r in told.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    langs = [r[0] for r in some.groupBy("lang").count().filter("length(lang) <= 64").orderBy(F.desc("count"), "lang").limit(LANGS).collect()]
    codes = Codes(langs, words)
    many = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, off in suffixes(batch.column(0), batch.column(1), codes, max_words):
                yield pa.RecordBatch.from_arrays([pa.array(first_bytes(buf, off))], ["k"])

    at = F.percentile_approx("k", [i / many for i in range(1, many)], 10 * many)
    borders = some.mapInArrow(keys, "k long").agg(at).first()[0]
    return codes, sorted(set(borders or []))


def phrase_counts(docs: DataFrame, least: int = 100, max_words: int = 5, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, words, phrase, f): how often each phrase of 1 to ``max_words`` words occurs, from ``least`` on;
    phrases of no word tell how many words a language has."""
    ready(docs.sparkSession)
    codes, borders = _sample(docs, text, lang, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(codes, max_words + 1, least)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COUNTS.types)], schema=_COUNTS)

        for some in _gathered(batches, PUSHED):
            ranges, key, n = (c.combine_chunks() for c in some.columns)
            _, offsets, data = key.buffers()
            off = np.frombuffer(offsets, np.int32)[key.offset : key.offset + len(key) + 1].astype(np.int64)
            buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
            rows = list(stack.push(ranges.to_numpy(), buf, off - off[0], n.to_numpy()))
            if rows:
                yield table(rows)
        if rows := list(stack.close()):
            yield table(rows)

    dealt = counted(docs, codes, max_words, borders, text, lang).repartition("range").sortWithinPartitions("range", F.desc("key"))
    parts = dealt.mapInArrow(run, "lang string, words int, phrase string, f long")
    sums = parts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return materialised(sums.filter((F.col("words") == 0) | (F.col("f") >= least)))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of two words and more, by the cut that scores lowest."""
    known = counts.select("lang", F.col("phrase").alias("part"), "f")
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    cuts = counts.filter("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    word = F.split("phrase", " ")
    halves = cuts.select(
        "lang", "phrase", "words", F.col("f").alias("a"), "k",
        F.array_join(F.slice(word, 1, F.col("k")), " ").alias("first"), F.array_join(F.slice(word, F.col("k") + 1, F.col("words")), " ").alias("rest"),
    )
    halves = halves.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    halves = halves.join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    halves = halves.join(F.broadcast(total) if total.limit(LANGS + 1).count() <= LANGS else total, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = halves.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", *(F.col(f"b.{c}").alias(c) for c in ("words", "a", "l", "r", "n", "score")))


def contained(counts: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase) of phrases that lie in a longer one with at least ``share`` percent of their occurrences.
    One that is longer by a word tells: it has at least those of any that is longer still."""
    word = F.split("phrase", " ")
    inner = F.array(F.slice(word, 1, F.col("words") - 1), F.slice(word, 2, F.col("words") - 1))
    longer = counts.filter("words > 2").select("lang", "f", F.explode(inner).alias("w")).groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("f").alias("most"))
    return longer.join(counts.filter("words > 1"), ["lang", "phrase"]).filter(F.lit(100) * F.col("most") >= F.lit(share) * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 100, max_words: int = 5, share: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of all collocations."""
    counts = phrase_counts(docs, least, max_words, text, lang)
    return scored(counts).join(contained(counts, share), ["lang", "phrase"], "left_anti")


def best(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each language, with their rank. Parts of a language are cut to ``k`` first, so none is sorted whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in (1024, 32):
        salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def top_collocations(docs: DataFrame) -> DataFrame:
    """The contract's rows: each language's first 2000."""
    return best(collocations(docs), 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM starts),
f AS (SELECT lang, list_slice(w, i, i + k - 1) AS p, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cut AS (SELECT lang, p, k AS words, f AS a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
scores AS (
  SELECT cut.*, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.p = list_slice(cut.p, 1, c) JOIN f y ON y.lang = cut.lang AND y.p = list_slice(cut.p, c + 1, words) JOIN total ON total.lang = cut.lang
), lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
longer AS (SELECT lang, f, k, p, unnest(range(1, k + 1)) AS i FROM f WHERE k > 2),
spans AS (SELECT lang, f, k, p, i, unnest(range(i + 1, k + 1)) AS j FROM longer),
inside AS (SELECT lang, list_slice(p, i, j) AS p, max(f) AS most FROM spans WHERE j - i + 1 < k GROUP BY ALL),
kept AS (
  SELECT lowest.lang, array_to_string(lowest.p, ' ') AS phrase, a, l, r, n, score FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.p = lowest.p
  WHERE most IS NULL OR 100 * most < 100 * a
)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000
"""
