"""Quality classifier: a generalised additive model with pairwise interactions.

The score is a sum of lookup tables, one for each feature and one for each of a few
pairs of features.  Tables are learned by cyclic boosting: again and again, each
feature in turn gets a small step of a shallow tree over its bins, fitted to what
the sum so far leaves; then the pairs that explain most of the rest get tables alike.
Scoring bins the features and adds up table entries, for all rows at once.

Features are statistics of the text's bytes, words and lines; labels, language,
source and id are no inputs.  Null texts are scored as empty ones; empty texts get
what the tables say of zeros.  Equal texts get equal scores.  Without labelled rows
each score is 0.5.  An empty table gives no rows.

``PER_LABEL`` bounds the sample that is fitted on; scores read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import ready, remainder, with_computed
from foldspark.llm.samples import labelled_sample, text_labels
from foldspark.llm.textvec import doc_chunks, hash_spans, raw_utf8, word_spans

PER_LABEL, BINS, PAIR_BINS, PAIRS = 10_000, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15

_KINDS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "high": range(128, 256), "space": (32, 9, 11, 12, 13), "line": (10,),
    "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|/\\", "quote": b"'\"()[]-", "mark": b"#$%&*+<=>@^_`{}~",
}
_CLASS = np.zeros(256, np.uint8)
for _k, _v in enumerate(_KINDS.values(), 1):
    _CLASS[list(_v)] = _k

FEATURES = [
    "bytes", "words", "word_mean", "word_sd", "word_max", *(f"share_{k}" for k in _KINDS), "upper_of_letters", "distinct_words", "repeated_next", "lines", "line_repeats", "bytes_per_line",
    "ends_in_mark", "starts_upper", "short_words", "words_per_stop",
]


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.float64)))
    return np.diff(sums[first])


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each row."""
    key = h * np.uint64(0x9E3779B97F4A7C15) + owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, bool)
    return np.bincount(owner[order][new], minlength=n).astype(np.float64)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features of some rows)."""
    buf, off = raw_utf8(column)
    for i, j in doc_chunks(off):
        part, rel = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        n, size = j - i, np.diff(rel).astype(np.float64)
        kind = _CLASS[part]
        share = {k: _per_row(kind == c, rel) / np.maximum(size, 1) for c, k in enumerate(_KINDS, 1)}
        starts, ends, first = word_spans(part, rel)
        owner, length = np.repeat(np.arange(n), np.diff(first)), (ends - starts).astype(np.float64)
        words = np.diff(first).astype(np.float64)
        some = np.maximum(words, 1)
        mean = _per_row(length, first) / some
        sd = np.sqrt(np.maximum(_per_row(length * length, first) / some - mean * mean, 0))
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        h = hash_spans(part, starts, ends, True)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        # Lines are spans between line ends.
        cut = np.zeros(len(part) + 1, bool)
        cut[rel] = True
        is_line = part != 10
        begin, end = is_line.copy(), is_line.copy()
        begin[1:] &= ~is_line[:-1] | cut[1 : len(part)]
        end[:-1] &= ~is_line[1:] | cut[1 : len(part)]
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        line_first = np.searchsorted(a, rel)
        lines = np.diff(line_first).astype(np.float64)
        line_owner = np.repeat(np.arange(n), np.diff(line_first))
        distinct_lines = _distinct(hash_spans(part, a, b, False), line_owner, n)
        letters = share["lower"] + share["upper"] + share["high"]
        last = kind[ends - 1] if len(ends) else kind[:0]
        marks = [1 + list(_KINDS).index(k) for k in ("shout", "bar", "mark")]
        columns = [
            np.log1p(size), np.log1p(words), mean, sd, np.log1p(longest), *share.values(), share["upper"] / np.maximum(letters, 1e-9),
            _distinct(h, owner, n) / some, _per_row(again, first) / some, np.log1p(lines), 1 - distinct_lines / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)),
            _per_row(np.isin(last, marks), first) / some, _per_row(kind[starts] == 2, first) / some, _per_row(length <= 2, first) / some, np.log1p(words / np.maximum(share["stop"] * size, 1)),
        ]
        yield i, np.stack(columns, 1)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Values over bins in a row of a tree of at most ``depth``, from gradients and weights."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    cut = int(gain.argmax())
    if gain[cut] <= 1e-9:
        return out
    return np.concatenate((_tree(g[: cut + 1], h[: cut + 1], depth - 1, least), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1, least)))


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Values over cells of a tree of depth 2: rows are cut in two, then the columns of
    each part. The cut of rows is the one with the best cuts of columns after it, as
    interactions may show in no row sum."""
    best, out = -1.0, np.full(g.shape, g.sum() / (h.sum() + 1))
    for cut in range(1, len(g)):
        parts = [_tree(x.sum(0), w.sum(0), 1, least) for x, w in ((g[:cut], h[:cut]), (g[cut:], h[cut:]))]
        gain = sum((x.sum(0) * v).sum() - 0.5 * (v * v * w.sum(0)).sum() for v, x, w in zip(parts, (g[:cut], g[cut:]), (h[:cut], h[cut:])))
        if gain > best:
            best, out = gain, np.concatenate((np.tile(parts[0], (cut, 1)), np.tile(parts[1], (len(g) - cut, 1))))
    return out


@dataclass
class Gam:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, k])]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, base_rate: float) -> Gam:
    """Fits on rows that carry the weight which gives label 1 the share ``base_rate``."""
    if not len(x):
        return Gam()
    model = Gam(base=float(np.log((base_rate + 1e-3) / (1 - base_rate + 1e-3))))
    weight = np.where(y == 1, base_rate / max(y.mean(), 1e-9), (1 - base_rate) / max(1 - y.mean(), 1e-9))
    least = 0.0002 * len(x)
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.edges)]
    margin = np.full(len(x), model.base)
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            p = 1 / (1 + np.exp(-margin))
            g, h = np.bincount(b, weight * (y - p), len(model.tables[k])), np.bincount(b, weight * p * (1 - p), len(model.tables[k]))
            step = RATE * np.clip(_tree(g, h, 2, least), -4, 4)
            model.tables[k] += step
            margin += step[b]
    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k]) for k, e in enumerate(model.pair_edges)]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        at = coarse[a] * shape[1] + coarse[b]
        p = 1 / (1 + np.exp(-margin))
        n = shape[0] * shape[1]
        return at, np.bincount(at, weight * (y - p), n), np.bincount(at, weight * p * (1 - p), n), shape

    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            _, g, h, _ = cells(a, b)
            gains.append(((g * g / (h + 5)).sum(), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            at, g, h, shape = cells(a, b)
            g, h = g.reshape(shape), h.reshape(shape)
            step = _pair_tree(g, h, least)
            step = RATE * np.clip(step, -4, 4)
            model.pair_tables[k] += step
            margin += step.ravel()[at]
    return model


def train(docs: DataFrame, known: DataFrame, text: str = "text", per_label: int = PER_LABEL) -> Gam:
    """Fits on at most ``per_label`` texts of each label of ``known`` (doc_id, label: 0 or 1); labels' shares come from all of it."""
    ready(docs.sparkSession)
    known = known.filter(F.col("label").isin(0, 1))
    counts = {int(r[0]): r[1] for r in known.groupBy("label").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in features(batch.column(0)):
                part = batch.slice(i, len(x))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1), part.column(2)], ["x", "label", "h"])

    sample = labelled_sample(docs, text_labels(docs, known, text=text), per_label, text).select("text", F.col("label").cast("int"), "h")
    found = sorted(sample.mapInArrow(run, "x binary, label int, h long").collect(), key=lambda r: (r["label"], r["h"]))
    x = np.frombuffer(b"".join(r["x"] for r in found), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in found]), counts.get(1, 0) / max(sum(counts.values()), 1))


def score(docs: DataFrame, model: Gam, text: str = "text") -> DataFrame:
    """``docs`` with the probability ``score`` of label 1 (a column of that name is replaced)."""

    def start():
        def apply(column: pa.Array) -> Iterator[list[pa.Array]]:
            for _, x in features(column):
                yield [pa.array(model.score(x))]

        return apply

    ready(docs.sparkSession)
    return with_computed(docs, text, "score double", start)


def held_out_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The contract's row per document."""
    rows = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    known = labels.filter("quality is not null").filter(remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = train(rows, known)
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
