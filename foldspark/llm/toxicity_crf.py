"""Toxicity: a linear-chain conditional random field that tags toxic words.

Documents are labelled, words are not, so words get their labels from documents: a
word is labelled toxic in a toxic document if its document frequencies in toxic and
other documents of the sample differ by more than chance (a likelihood ratio) and by
a large factor.  A chain with two states and transitions is fitted to these labels; a
place's weights are those of its word, of the word's first 4, 5 and 6 bytes, and of the
words before and after it.  Forward-backward then gives each word of any text its
marginal probability.  A document's score comes from the largest marginal and the
sum of what marginals exceed ``FLOOR`` by, with a logistic curve fitted on the sample; words at
or above one half, joined where adjacent, are its offending spans.

The least likelihood ratio and the kinds of features are chosen by cross-validation
within the labelled sample: each half's documents are judged by the other half's words
(F1 at the labels' true shares), each half's chains by a chain fitted to the other's.

Words are runs of letters (ASCII letters and all bytes from 128 on; ASCII and Latin-1 letters in lower case);
chains are runs of ``WINDOW`` words of a text.  Null texts are scored as empty ones;
texts without words get the score of nothing found, and no spans.  Equal texts get
equal scores.  Without labelled rows each score is 0.  An empty table gives no rows.

``PER_LABEL`` and ``WINDOWS`` bound the sample that is fitted on; scores read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import materialised, ready, remainder, with_computed
from foldspark.llm.samples import labelled_sample, text_labels
from foldspark.llm.textvec import blocks, doc_chunks, hash_blocks, raw_utf8, word_spans

PER_LABEL, WINDOWS, WINDOW = 4_000, 4_000, 64
BUCKET_BITS = 18
#: What makes a word toxic: likelihood ratios to choose from, and how much more frequent it is in toxic documents.
RATIOS, TIMES = (8.0, 12.0, 16.0, 24.0, 32.0), 10.0
#: Marginals up to here count for nothing in a document, so that length alone adds nothing.
FLOOR = 0.3
PREFIXES = (4, 5, 6)
#: Features of a place: its word, prefixes, the words before and after. Those to choose from, and the chains of each kind and half for that.
N_OWN = 1 + len(PREFIXES)
KINDS, CHOICE_WINDOWS, CHOICE_ROUNDS = (tuple(range(1)), tuple(range(N_OWN)), tuple(range(N_OWN + 2))), 400, 30

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[65:91] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of words and their prefixes, where rows begin, bytes, starts, ends)."""
    buf, off = raw_utf8(column)
    for i, j in doc_chunks(off):
        part, rel = buf[off[i] : off[j]].copy(), off[i : j + 1] - off[i]
        part[np.flatnonzero((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)) + 1] += 32
        starts, ends, first = word_spans(part, rel, _OUTSIDE)
        by = blocks(part, True)
        h = [hash_blocks(by, starts, e) for e in (ends, *(np.minimum(starts + k, ends) for k in PREFIXES))]
        yield i, j, np.stack(h, 1), first, part, starts, ends


def with_neighbours(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hashes of words and prefixes, and those of the words before and after in the row (0 where there is none)."""
    near = np.zeros((len(h), 2), np.uint64)
    near[1:, 0], near[:-1, 1] = h[:-1, 0], h[1:, 0]
    begin, end = first[:-1], first[1:]
    near[begin[begin < end], 0] = near[end[begin < end] - 1, 1] = 0
    return np.concatenate((h, near), 1)


def bucket(h: np.ndarray) -> np.ndarray:
    """The weights that a place's hashes (last axis) share."""
    salt = np.arange(1, h.shape[-1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ salt) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the chains of each row's words."""
    count = np.diff(first)
    n = -(-count // WINDOW)
    row = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = first[row] + k * WINDOW
    return start, np.minimum(first[row + 1] - start, WINDOW)


@dataclass
class Chain:
    """Weights of state "toxic" against "other"; ``step[a, b]`` is the weight of going from a to b."""

    word: np.ndarray
    bias: float
    step: np.ndarray

    def marginals(self, emit: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each place (chains x places), and expected numbers of steps (2 x 2)."""
        n, t = emit.shape
        move = np.exp(self.step)
        e = np.exp(np.clip(emit, -30, 30))
        ahead = np.empty((t, n, 2))
        now = np.stack((np.ones(n), e[:, 0]), 1)
        ahead[0] = now / now.sum(1, keepdims=True)
        for k in range(1, t):
            now = ahead[k - 1] @ move
            now[:, 1] *= e[:, k]
            now /= now.sum(1, keepdims=True)
            ahead[k] = np.where((k < length)[:, None], now, ahead[k - 1])
        back = np.ones((n, 2))
        p = np.zeros((n, t))
        steps = np.zeros((2, 2))
        for k in range(t - 1, -1, -1):
            both = ahead[k] * back
            p[:, k] = both[:, 1] / both.sum(1)
            if k:
                inside = k < length
                seen = back.copy()
                seen[:, 1] *= e[:, k]
                joint = ahead[k - 1][:, :, None] * move[None] * seen[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                steps += joint[inside].sum(0)
                before = seen @ move.T
                before /= before.sum(1, keepdims=True)
                back = np.where(inside[:, None], before, back)
        return p, steps

    def emit(self, buckets: np.ndarray) -> np.ndarray:
        return self.word[buckets].sum(-1) + self.bias


def fit_chain(buckets: np.ndarray, toxic: np.ndarray, length: np.ndarray, rounds: int = 60, shrink: float = 3e-2) -> Chain:
    """Maximum likelihood with Adam over all chains at once (chains x places x features)."""
    n_words = 1 << BUCKET_BITS
    valid = np.arange(buckets.shape[1])[None] < length[:, None]
    y = toxic & valid
    seen = np.zeros((2, 2))
    both = valid[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum()
    rate = (y.sum() + 1) / (valid.sum() + 2)
    chain = Chain(np.zeros(n_words), float(np.log(rate)), np.zeros((2, 2)))
    scale = 1 / max(len(buckets), 1)
    flat, own = buckets[valid].ravel(), y[valid]
    params = np.zeros(n_words + 5)
    params[n_words] = chain.bias
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        p, steps = chain.marginals(chain.emit(buckets), length)
        left = p[valid] - own
        grad = np.concatenate((np.bincount(flat, np.repeat(left, buckets.shape[2]), n_words), [left.sum()], (steps - seen).ravel())) * scale
        grad += shrink * scale * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12) * (grad != 0)
        chain = Chain(params[:n_words], float(params[n_words]), params[n_words + 1 :].reshape(2, 2))
    return chain


@dataclass
class Tagger:
    chain: Chain
    curve: np.ndarray
    #: Which features of a place count, and the likelihood ratio that was chosen.
    kinds: tuple[int, ...] = KINDS[-1]
    ratio: float = 0.0

    def tag(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of every word, and (largest, expected number) for each row."""
        start, length = windows(first)
        p = np.zeros(len(h))
        if len(start):
            order = np.argsort(-length, kind="stable")
            emit = self.chain.emit(bucket(with_neighbours(h, first))[:, list(self.kinds)])
            for lo in range(0, len(order), 4096):
                some = order[lo : lo + 4096]
                n = length[some]
                at = start[some][:, None] + np.minimum(np.arange(n[0])[None], n[:, None] - 1)
                got, _ = self.chain.marginals(emit[at], n)
                inside = np.arange(n[0])[None] < n[:, None]
                p[at[inside]] = got[inside]
        sums = np.concatenate(([0], np.cumsum(np.maximum(p - FLOOR, 0) / (1 - FLOOR))))
        most = np.zeros(len(first) - 1)
        rows = np.flatnonzero(np.diff(first))
        if len(rows):
            most[rows] = np.maximum.reduceat(p, first[rows])
        return p, np.stack((most, np.log1p(sums[first[1:]] - sums[first[:-1]])), 1)

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(found @ self.curve[:2] + self.curve[2], -30, 30)))


def fit_curve(found: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small penalty."""
    x = np.column_stack((found, np.ones(len(found))))
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.1 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(hess, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_ratio(found: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The ratio with the largest F1 where a document is toxic if its largest (``found``) reaches it; of equal ones the smallest, as a half has less evidence than the whole."""

    def f1(ratio: float) -> float:
        told = found >= ratio
        hit = weight[told & (y == 1)].sum()
        return 2 * hit / max(weight[told].sum() + weight[y == 1].sum(), 1e-12)

    return max(RATIOS, key=lambda r: (round(f1(r), 9), -r))


def best_kinds(buckets: np.ndarray, own: np.ndarray, length: np.ndarray, half: np.ndarray) -> tuple[int, ...]:
    """The features whose chains, fitted on one half, tell the labels of the other with the smallest log loss."""
    inside = np.arange(own.shape[1])[None] < length[:, None]

    def loss(kinds: tuple[int, ...]) -> float:
        total = 0.0
        for side in (0, 1):
            a, b = half == side, half != side
            chain = fit_chain(buckets[a][:, :, list(kinds)], own[a], length[a], rounds=CHOICE_ROUNDS)
            p = np.clip(chain.marginals(chain.emit(buckets[b][:, :, list(kinds)]), length[b])[0], 1e-6, 1 - 1e-6)
            total -= np.where(own[b], np.log(p), np.log(1 - p))[inside[b]].sum()
        return total

    return min(KINDS, key=lambda kinds: (round(loss(kinds), 6), len(kinds)))


def train(docs: DataFrame, known: DataFrame, text: str = "text", per_label: int = PER_LABEL) -> Tagger | None:
    """Fits on at most ``per_label`` texts of each label of ``known`` (doc_id, label: 0 or 1); None without texts of both."""
    ready(docs.sparkSession)
    known = known.filter(F.col("label").isin(0, 1))
    counts = {int(r[0]): r[1] for r in known.groupBy("label").count().collect()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, first, *_ in word_hashes(batch.column(1)):
                part = batch.slice(i, j - i)
                words = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h[:, 0].copy().view(np.int64)))
                hashes = pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), words, hashes], ["h", "label", "words", "hashes"])

    sample = labelled_sample(docs, text_labels(docs, known, text=text), per_label, text).select("h", "text", F.col("label").cast("int").alias("label"))
    sample = materialised(sample.mapInArrow(split, "h long, label int, words array<long>, hashes binary")).withColumn("half", F.pmod("h", F.lit(2)).cast("int"))
    n = {(r[0], r[1]): r[2] for r in sample.groupBy("label", "half").count().collect()}
    if not all(any(n.get((y, s), 0) for s in (0, 1)) for y in (0, 1)):
        return None
    # Each word of the list is in many toxic documents, so the list has at most (words of a text) x n1 / (that many) entries.
    in_half = [F.col("half") == s for s in (0, 1)]
    by_word = sample.select("label", "half", F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(
        *(F.count(F.when(c, 1)).alias(f"d{s}") for s, c in enumerate(in_half)), *(F.count(F.when(c & (F.col("label") == 1), 1)).alias(f"t{s}") for s, c in enumerate(in_half))
    )

    def ratio(d: Column, t: Column, n1: int, n0: int) -> Column:
        if not n1 or not n0:
            return F.lit(0.0)
        other = d - t
        value = 2 * (t * F.ln(t * (n1 + n0) / (d * n1)) + F.when(other > 0, other * F.ln(other * (n1 + n0) / (d * n0))).otherwise(0.0))
        return F.when((t > 0) & ((t + 0.5) / (n1 + 1) >= TIMES * (other + 0.5) / (n0 + 1)), value).otherwise(0.0)

    every = [ratio(F.col(f"d{s}"), F.col(f"t{s}"), n.get((1, s), 0), n.get((0, s), 0)) for s in (0, 1)]
    every.append(ratio(F.col("d0") + F.col("d1"), F.col("t0") + F.col("t1"), *(sum(n.get((y, s), 0) for s in (0, 1)) for y in (1, 0))))
    ratios = by_word.select("w", *(c.alias(f"r{i}") for i, c in enumerate(every))).filter(F.greatest("r0", "r1", "r2") >= RATIOS[0])
    listed = sorted(tuple(r) for r in ratios.collect())
    words = np.array([r[0] for r in listed], np.int64)
    value = np.array([r[1:] for r in listed], np.float64).reshape(-1, 3)

    def of(w: np.ndarray) -> np.ndarray:
        """The three ratios of each word."""
        if not len(words):
            return np.zeros((len(w), 3))
        at = np.minimum(np.searchsorted(words, w), len(words) - 1)
        return np.where((words[at] == w)[:, None], value[at], 0.0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The largest ratio that the other half gives to a word of a document."""
        for batch in batches:
            each = [np.frombuffer(x, np.uint64).reshape(-1, N_OWN)[:, 0].view(np.int64) for x in batch.column(2).to_pylist()]
            most = [float(of(w)[:, 1 - s].max(initial=0)) for w, s in zip(each, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most, pa.float64())], ["label", "most"])

    share = counts[1] / (counts[0] + counts[1])

    def weights(y: np.ndarray) -> np.ndarray:
        return np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))

    judged = sorted(tuple(r) for r in sample.select("label", "half", "hashes").mapInArrow(judge, "label int, most double").collect())
    y = np.array([r[0] for r in judged], np.float64)
    least = best_ratio(np.array([r[1] for r in judged]), y, weights(y))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains of the sample with their labels, by all documents and by those of their half, as one binary row each."""
        for batch in batches:
            for h, label_, hashes, half in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4))):
                w = np.frombuffer(hashes, np.uint64).reshape(-1, N_OWN)
                hit = (of(w[:, 0].copy().view(np.int64))[:, [2, half]] >= least) & (label_ == 1)
                b = bucket(with_neighbours(w, np.array([0, len(w)]))).astype(np.int32)
                out = [(bool(hit[a : a + WINDOW, 0].any()), h ^ a, half, b[a : a + WINDOW].tobytes(), hit[a : a + WINDOW].T.tobytes()) for a in range(0, len(w), WINDOW)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["hit", "o", "half", "words", "labels"])

    chains = sample.mapInArrow(cut, "hit boolean, o long, half int, words binary, labels binary").withColumn("o", F.xxhash64("o"))
    kept = [r for hit in (True, False) for r in chains.filter(F.col("hit") == hit).orderBy("o", "words").limit(WINDOWS).collect()]
    length = np.array([len(r["labels"]) // 2 for r in kept], np.int64)
    buckets, toxic = np.zeros((len(kept), WINDOW, N_OWN + 2), np.int32), np.zeros((len(kept), 2, WINDOW), bool)
    for k, r in enumerate(kept):
        buckets[k, : length[k]] = np.frombuffer(r["words"], np.int32).reshape(-1, N_OWN + 2)
        toxic[k, :, : length[k]] = np.frombuffer(r["labels"], bool).reshape(2, -1)
    half, hit = np.array([r["half"] for r in kept], np.int64), np.array([r["hit"] for r in kept], bool)
    tagger = Tagger(Chain(np.zeros(1 << BUCKET_BITS), -9.0, np.zeros((2, 2))), np.zeros(3), ratio=least)
    if kept:
        few = np.concatenate([np.flatnonzero((half == s) & (hit == v))[:CHOICE_WINDOWS] for s in (0, 1) for v in (True, False)])
        tagger.kinds = best_kinds(buckets[few], toxic[few, 1], length[few], half[few])
        tagger.chain = fit_chain(buckets[:, :, list(tagger.kinds)], toxic[:, 0], length)
    tagger.chain.word = tagger.chain.word.astype(np.float32)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                rows_ = batch.slice(k, 100)
                hashes = rows_.column(3).to_pylist()
                first = np.cumsum([0, *(len(x) // (8 * N_OWN) for x in hashes)])
                _, got = tagger.tag(np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, N_OWN), first)
                yield pa.RecordBatch.from_arrays([rows_.column(1), pa.array(got[:, 0]), pa.array(got[:, 1])], ["label", "a", "b"])

    seen = sorted(tuple(r) for r in sample.mapInArrow(found, "label int, a double, b double").collect())
    y = np.array([r[0] for r in seen], np.float64)
    tagger.curve = fit_curve(np.array([r[1:] for r in seen]), y, weights(y))
    return tagger


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """``docs`` with the probability ``score`` and ``spans``, the offending stretches of
    characters with their largest marginal (columns of these names are replaced)."""

    def start():
        def apply(column: pa.Array) -> Iterator[list[pa.Array]]:
            _, off = raw_utf8(column)
            for i, j, h, first, part, starts, ends in word_hashes(column):
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                values = np.zeros(j - i)
                if tagger is not None:
                    p, found = tagger.tag(h, first)
                    values = tagger.score(found)
                    hits = np.flatnonzero(p >= 0.5)
                    for k, r in zip(hits.tolist(), (np.searchsorted(first, hits, "right") - 1).tolist()):
                        base = off[i + r] - off[i]
                        a = int(np.count_nonzero(part[base : starts[k]] & 0xC0 != 0x80))
                        b = a + int(np.count_nonzero(part[starts[k] : ends[k]] & 0xC0 != 0x80))
                        last = spans[r][-1] if spans[r] else None
                        if last and last["k"] == k - 1:
                            last.update(end=b, p=max(last["p"], float(p[k])), k=k)
                        else:
                            spans[r].append({"start": a, "end": b, "p": float(p[k]), "k": k})
                    for one in spans:
                        for s in one:
                            del s["k"]
                yield [pa.array(values), pa.array(spans, _SPANS)]

        return apply

    ready(docs.sparkSession)
    return with_computed(docs, text, "score double, spans array<struct<start:int,end:int,p:double>>", start)


def held_out_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The contract's row per document."""
    rows = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    known = labels.filter("toxic is not null").filter(remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    tagger = train(rows, known)
    return score(rows, tagger).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
