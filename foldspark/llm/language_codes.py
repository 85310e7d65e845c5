"""Language ID by error-correcting output codes.

Each language has a codeword.  One binary classifier for each bit is fitted on hashed
byte n-grams (1 to 4) of a sample of labelled texts; the bits predicted are decoded
to the language whose codeword has the smallest loss, bits weighted by how well they
separate the sample.  A prediction is flagged as ambiguous if the runner-up's loss is
hardly larger.

Texts that are null or have no letter are ``und`` with score 0.  Without any labelled
text everything is ``und``; with one language every text with a letter is that one.
Equal texts get equal predictions.  An empty table gives no rows.

``fits`` tells whether a text is in one of the languages at all: its smallest loss
must not exceed a limit, which lies above the losses of all texts of the sample that
a model fitted without them gives.

``PER_LANGUAGE`` bounds the sample that is fitted on; predictions read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import ready, remainder, with_computed
from foldspark.llm.samples import labelled_sample
from foldspark.llm.textvec import doc_chunks, raw_utf8

PER_LANGUAGE, BINS, ORDERS = 300, 1 << 12, 4
#: Rows whose features are held at a time.
ROWS = 256
#: Loss of the runner-up over that of the best below which a prediction is ambiguous.
AMBIGUOUS = 1.02
#: The limit lies so far on the way from the largest loss of a labelled text to that of one that tells no bit.
SLACK = 0.25
_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def histograms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram features of some rows, whether they have a letter)."""
    buf, off = raw_utf8(column)
    for i, j in ((k, min(k + ROWS, j)) for i, j in doc_chunks(off) for k in range(i, j, ROWS)):
        raw, rel = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        c = _LETTER[raw]
        capital = np.flatnonzero((c[:-1] == 0xC3) & (c[1:] >= 0x80) & (c[1:] <= 0x9E)) + 1  # Latin capitals with accents
        c[capital] += 32
        has = np.diff(np.concatenate(([0], np.cumsum((c >= 97) & (c < 123))))[rel]) > 0
        for r in np.flatnonzero(~has & (np.diff(np.concatenate(([0], np.cumsum(c >= 128)))[rel]) > 0)):
            has[r] = any(ch.isalpha() for ch in raw[rel[r] : rel[r + 1]].tobytes().decode("utf-8", "replace"))
        wide, h, grams = c.astype(np.uint32), np.zeros(len(c), np.uint32), []
        for n in range(ORDERS):
            h = h[: len(c) - n] * np.uint32(0x01000193) + wide[n:] + np.uint32(1) if n else wide + np.uint32(1)
            grams.append(((h * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64))
        out = np.zeros((j - i, BINS), np.float32)
        for r in range(j - i):
            a, b = rel[r], rel[r + 1]
            for n, g in enumerate(grams):
                if b - n > a:
                    out[r] += np.bincount(g[a : b - n], minlength=BINS)
        np.sqrt(out, out=out)
        out /= np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)
        yield i, out, has


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``k`` classes: all different splits for few
    classes, else the random code of several with the largest least distance."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 4:
        splits = [[1] + [1 if s >> b & 1 else -1 for b in range(k - 1)] for s in range(2 ** (k - 1) - 1)]
        return np.array(splits, np.float64).T.reshape(k, -1)
    rng = np.random.default_rng(k)
    width, best = int(np.ceil(10 * np.log2(k))), None
    for _ in range(200):
        code = np.where(rng.random((k, width)) < 0.5, 1.0, -1.0)
        code = code[:, np.abs(code.sum(0)) < k]
        apart = ((code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(k)).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    #: Smallest loss up to which a text is in one of the languages.
    limit: float = np.inf

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each language's codeword (rows x languages)."""
        margin = x @ self.weights + self.bias
        return np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, its score, and whether it is ambiguous."""
        loss = self.losses(x)
        best = loss.argmin(1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = 1 / share.sum(1)
        if loss.shape[1] < 2:
            return best, score, np.zeros(len(x), bool)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, score, two[:, 1] < AMBIGUOUS * two[:, 0]


def fit(x: np.ndarray, labels: list[str], rounds: int = 200, shrink: float = 1e-4, languages: list[str] | None = None) -> Codes:
    languages = languages or sorted(set(labels))
    code = codewords(len(languages))
    number = np.array([languages.index(v) for v in labels], np.int64)
    y = code[number]
    share = (1 / np.maximum(np.bincount(number, minlength=len(languages)), 1) / max(len(languages), 1))[number][:, None]
    w, b = np.zeros((BINS, code.shape[1])), np.zeros(code.shape[1])
    m, v = np.zeros((BINS + 1, code.shape[1])), np.zeros((BINS + 1, code.shape[1]))
    x = x.astype(np.float32)
    for t in range(1, rounds + 1):  # Adam on the balanced logistic loss of all bits at once
        g = -y / (1 + np.exp(np.clip(y * (x @ w.astype(np.float32) + b), -50, 50))) * share
        grad = np.vstack((x.T @ g.astype(np.float32) + shrink * w, g.sum(0)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    right = (((x @ w + b) * y > 0) * share).sum(0) if len(x) and code.shape[1] else np.ones(code.shape[1])
    trust = np.log(np.clip(right, 0.55, 0.999) / np.clip(1 - right, 0.001, 0.45))
    return Codes(languages, code, w.astype(np.float32), b.astype(np.float32), trust / max(trust.mean(), 1e-9) if len(trust) else trust)


def rejection_limit(x: np.ndarray, labels: list[str]) -> float:
    """Limit of the smallest loss: each half of the texts is judged by a model of the other half."""
    languages, names, largest = sorted(set(labels)), np.array(labels, object), -np.inf
    for part in (0, 1):
        own = np.arange(len(names)) % 2 == part
        judged = ~own & np.isin(names, list(set(names[own])))
        if judged.any():
            largest = max(largest, float(fit(x[own], list(names[own]), languages=languages).losses(x[judged]).min(1).max()))
    if largest == -np.inf:
        return np.inf
    none = np.log(2) * codewords(len(languages)).shape[1]  # weights of bits are 1 on average
    return largest + SLACK * max(none - largest, 0.0)


def train(rows: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, calibrate: bool = False) -> Codes:
    """Fits on at most ``per_language`` texts of each label; with ``calibrate``, finds the limit for :func:`fits` too."""
    ready(rows.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, has in histograms(batch.column(0)):
                labels = batch.column(1).slice(i, len(x)).filter(pa.array(has))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[has].astype(np.float16)], pa.binary()), labels, batch.column(2).slice(i, len(x)).filter(pa.array(has))], ["x", "label", "h"])

    kept = labelled_sample(rows, rows.select(F.xxhash64(text).alias("h"), F.col(label).alias("label")), per_language, text).select("text", F.col("label").cast("string"), "h").mapInArrow(features, "x binary, label string, h long")
    found = sorted(kept.collect(), key=lambda r: (r["label"], r["h"]))
    x = np.frombuffer(b"".join(r["x"] for r in found), np.float16).reshape(-1, BINS)
    labels = [r["label"] for r in found]
    model = fit(x, labels)
    if calibrate:
        model.limit = rejection_limit(x, labels)
    return model


def predict(docs: DataFrame, model: Codes, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous (columns of these names are replaced)."""

    def start():
        def apply(column: pa.Array) -> Iterator[list[pa.Array]]:
            for _, x, has in histograms(column):
                if model.languages:
                    best, score, vague = model.predict(x)
                    lang = [model.languages[b] if h else "und" for b, h in zip(best, has)]
                else:
                    lang, score, vague = ["und"] * len(x), np.zeros(len(x)), np.zeros(len(x), bool)
                yield [pa.array(lang, pa.string()), pa.array(np.where(has, score, 0.0).astype(np.float64)), pa.array(vague | ~has)]

        return apply

    ready(docs.sparkSession)
    return with_computed(docs, text, "lang_pred string, score double, ambiguous boolean", start)


def fits(docs: DataFrame, model: Codes, text: str = "text") -> DataFrame:
    """``docs`` with a column fits (one of this name is replaced): the text has a letter and a loss
    within the model's limit. A model that learned no language rejects no text with a letter."""

    def start():
        def apply(column: pa.Array) -> Iterator[list[pa.Array]]:
            for _, x, has in histograms(column):
                yield [pa.array(has & (model.losses(x).min(1) <= model.limit) if model.languages else has)]

        return apply

    ready(docs.sparkSession)
    return with_computed(docs, text, "fits boolean", start)


def held_out_languages(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    rows = docs.select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")))
    return predict(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
