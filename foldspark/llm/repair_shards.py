"""Token-ID output: shard files of token ids compressed by a grammar (Re-Pair).

``write_shards`` encodes every document, appends an end id, sorts by ``doc_id`` and
writes blocks of about ``BLOCK_TOKENS`` tokens.  In a block all pairs of neighbouring ids
that occur ``LEAST`` times or more are replaced by new symbols (nonterminals), pass
after pass until no pair does; the block stores the rules, the length that each symbol expands to, and where each
document's symbols begin, so a single document can be decoded alone.  No pair
reaches over the end of a document.

The files are a Parquet table (part, seq, first_token, n_tokens, doc_ids, block) in
the shared folder, so that Spark's commit protocol keeps them whole when executors
are lost; ``block`` holds the bytes of the format.

A null text is empty and holds just the end id.  A null ``doc_id`` comes first.
Rows with the same ``doc_id`` follow each other by their text's hash.  An empty
table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm.bpe import load, slices
from foldspark.llm.common import ready, shared_uri

BLOCK_TOKENS = 1 << 20
#: How often a pair must occur to be replaced.
LEAST = 2
_MAGIC, _HEAD = b"RPG2", "<4sIIQQBBB"


def _bits(values: np.ndarray) -> tuple[int, bytes]:
    """Values in the fewest bits that hold all of them."""
    width = max(1, int(values.max(initial=0)).bit_length())
    # Eight values fill ``width`` bytes; each lies in at most five of them.
    rows = np.zeros((-(-len(values) // 8), width + 4), np.uint8)
    for i in range(8):
        byte, bit = divmod(i * width, 8)
        some = values[i::8].astype(np.uint64) << np.uint64(40 - bit - width)
        for k in range((bit + width + 7) // 8):
            rows[: len(some), byte + k] |= (some >> np.uint64(32 - 8 * k)).astype(np.uint8)
    return width, rows[:, :width].tobytes()[: (len(values) * width + 7) // 8]


def _unbits(data: np.ndarray, n: int, width: int, first: int = 0) -> np.ndarray:
    """Values ``first`` to ``first + n`` of those packed by :func:`_bits`."""
    low = first * width
    flags = np.unpackbits(data[low // 8 : (low + n * width + 7) // 8])[low % 8 : low % 8 + n * width].reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - width :] = flags
    return np.packbits(full).view(">u4").astype(np.int64)


def _ranked(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``width`` bits in ascending order, and the place of each. With its place in
    the bits below, where there is room, a key sorts as one number, which is faster."""
    room = len(keys).bit_length()
    if width + room > 63:
        order = np.argsort(keys)
        return keys[order], order
    both = keys << room | np.arange(len(keys))
    both.sort()
    return both >> room, both & ((1 << room) - 1)


def compress(ids: np.ndarray, lengths: np.ndarray, symbols: int) -> bytes:
    """One block: ``ids`` of documents of ``lengths`` tokens, each with its end id. Ids are below ``symbols``."""
    seq = ids.astype(np.int32 if symbols + len(ids) < 1 << 31 else np.int64)
    # An end stands as -1 until all passes are done: no pair with it counts.
    last = np.cumsum(lengths) - 1
    closing = seq[last]
    seq[last] = -1
    rules: list[np.ndarray] = []
    base = symbols
    near = np.flatnonzero((seq[:-1] | seq[1:]) >= 0)
    while len(near):
        width = base.bit_length()
        ordered, order = _ranked(seq[near].astype(np.int64) << width | seq[near + 1], 2 * width)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        count = np.diff(np.append(edge, len(ordered)))
        often = count >= LEAST
        chosen = ordered[edge[often]]
        if not len(chosen):
            break
        at = np.full(len(near), -1, np.int32)
        at[order[np.repeat(often, count)]] = np.repeat(np.arange(len(chosen), dtype=np.int32), count[often])
        some = np.flatnonzero(at >= 0)
        hit, at = near[some], at[some]
        # Of overlapping pairs in a row, every other one from the left.
        run = np.concatenate(([True], np.diff(hit) > 1))
        begin = np.maximum.accumulate(np.where(run, hit, 0))
        taken = (hit - begin) & 1 == 0
        hit, at = hit[taken], at[taken]
        # A pair that others took away everywhere needs no rule.
        used = np.zeros(len(chosen), bool)
        used[at] = True
        seq[hit] = base + (np.cumsum(used) - 1)[at]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        pairs = chosen[used]
        rules.append((pairs >> width) << 32 | pairs & ((1 << width) - 1))
        base += len(pairs)
        # A pass leaves no chosen pair behind (of two that overlap, one is taken and the other
        # ends with it), so only pairs with one of its symbols can be frequent.
        made = hit - np.arange(len(hit))
        near = np.stack((made - 1, made), axis=1).ravel()
        near = near[np.concatenate(([True], near[1:] != near[:-1])) & (near >= 0) & (near < len(seq) - 1)]
        near = near[(seq[near] | seq[near + 1]) >= 0]
    ends = np.flatnonzero(seq < 0)
    seq[ends] = closing
    flat = np.concatenate(rules) if rules else np.zeros(0, np.int64)
    left, right = flat >> 32, flat & 0xFFFFFFFF
    size = np.ones(base, np.int64)
    lo = symbols
    for group in rules:
        size[lo : lo + len(group)] = size[group >> 32] + size[group & 0xFFFFFFFF]
        lo += len(group)
    width, packed = _bits(seq)
    begins = np.concatenate(([0], ends + 1))
    (part_width, parts), (size_width, sizes) = _bits(np.concatenate((left, right))), _bits(size[symbols:])
    head = struct.pack(_HEAD, _MAGIC, symbols, len(flat), len(seq), len(lengths), width, part_width, size_width)
    return head + parts + sizes + begins.astype("<u8").tobytes() + packed


class Block:
    """Reads a block; documents are numbered from 0."""

    def __init__(self, data: bytes):
        magic, symbols, n_rules, self.n_symbols, self.n_docs, self.width, part_width, size_width = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        raw, at = np.frombuffer(data, np.uint8), struct.calcsize(_HEAD)

        def take(n: int, width: int) -> np.ndarray:
            nonlocal at
            out = _unbits(raw[at:], n, width)
            at += (n * width + 7) // 8
            return out

        parts, sizes = take(2 * n_rules, part_width), take(n_rules, size_width)
        left, right = parts[:n_rules], parts[n_rules:]
        self.begins = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.packed = np.frombuffer(data, np.uint8, offset=at)
        self.size = np.concatenate((np.ones(symbols, np.int64), sizes))
        # Expansions side by side, filled from the rules whose parts are known.
        self.at = np.concatenate((np.arange(symbols), symbols + np.cumsum(sizes) - sizes)).astype(np.int64)
        self.flat = np.concatenate((np.arange(symbols), np.zeros(int(sizes.sum()), np.int64)))
        todo = np.arange(n_rules)
        known = np.arange(symbols + n_rules) < symbols
        while len(todo):
            now = todo[known[left[todo]] & known[right[todo]]]
            self._fill(symbols + now, left[now], 0)
            self._fill(symbols + now, right[now], self.size[left[now]])
            known[symbols + now] = True
            todo = todo[~known[symbols + todo]]

    def _fill(self, rule: np.ndarray, part: np.ndarray, shift: np.ndarray | int) -> None:
        self.flat[self._places(self.at[rule] + shift, self.size[part])] = self._expand(part)

    @staticmethod
    def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
        end = np.cumsum(n)
        return np.repeat(start - end + n, n) + np.arange(end[-1] if len(end) else 0)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[self._places(self.at[symbols], self.size[symbols])]

    def document(self, i: int) -> np.ndarray:
        """The ids of one document."""
        lo, hi = int(self.begins[i]), int(self.begins[i + 1])
        return self._expand(_unbits(self.packed, hi - lo, self.width, lo))

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document's begin."""
        seq = _unbits(self.packed, self.n_symbols, self.width)
        total = np.concatenate(([0], np.cumsum(self.size[seq])))
        return self._expand(seq), total[self.begins]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes all documents and writes their blocks below ``folder``."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(open(tokenizer, "rb").read())  # one vocabulary file: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = load(shared.value)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        symbols = max(len(bpe.bytes_of), end_id + 1)
        keys, held, size, seq, first = [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            nonlocal keys, held, size, seq, first
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            data = compress(np.frombuffer(b"".join(held), "<u4"), lengths, symbols)
            columns = [[part], [seq], [first], [size], [keys], [data]]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, layout)], names)
            keys, held, seq, first, size = [], [], seq + 1, first + size, 0
            return out

        for batch in batches:
            sizes = [x or 0 for x in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for i, j in slices(sizes, 1 << 20):
                for k, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), bpe.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])):
                    keys.append(k)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                if size >= BLOCK_TOKENS:
                    yield block()
        if held:
            yield block()

    import pyarrow.compute  # noqa: F401

    layout = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("block", pa.binary())])
    names = layout.names
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    rows.mapInArrow(run, "part int, seq int, first_token long, n_tokens long, doc_ids array<long>, block binary").write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, decoded from the files."""
    ready(spark)
    blocks = spark.read.parquet(folder)
    # A number per part: as many as the write had tasks.
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for p, n in parts:
        before[p], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, keys, data = (batch.column(c)[row] for c in range(4))
                ids, begins = Block(data.as_py()).documents()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
                start = before[part.as_py()] + first.as_py() + begins[:-1]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(start, pa.int64()), pa.array(np.diff(begins), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "first_token", "doc_ids", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The contract's row per document, from files written to the shared folder."""
    folder = shared_uri(docs.sparkSession)
    write_shards(docs, tokenizer, folder, end_id)
    return read_shards(docs.sparkSession, folder)
