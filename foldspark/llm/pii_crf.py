"""Personal data by patterns and a skip-chain conditional random field.

``base`` finds e-mail addresses, IPv4 addresses, card and phone numbers by patterns and
checks, each in one pass over a text.  Patterns miss what stands too near to something
else, lacks a part, or is mentioned again in another form.  The random field finds those.

Its nodes are the tokens (runs of what is not white space) with a digit or an ``@``; any
other token counts as no personal data.  Labels are the four kinds and none.

* Node potentials are log-linear in a token's shape and its neighbours'.  They and the
  chain potentials between adjacent nodes are fitted to the base spans of a bounded
  sample by maximising the likelihood of the chains; not to chains with a number of too many
  digits, which a pattern may have read past its end.
* Skip potentials join each occurrence of a token to the next one in the document that is the same or
  similar (same letters and digits, same last seven digits, same part before the ``@``), however far.
  They favour equal labels by the odds with which such pairs agree in the sample.
* Tokens of base spans are given; loopy message passing, all documents of a batch at
  once, a fixed number of rounds, gives the others' marginals.  Messages never cross
  documents, so equal texts get equal spans whatever else is in the batch.

A token is added if one kind has at least ``SURE`` of its marginal; adjacent added
tokens of a number are one span, as long as it has no more digits than its kind.  What is
added must pass its kind's check (a phone number without its country code has 7 digits at
least).  Base spans always stay and added ones never overlap them.

Null texts count as empty.  Empty texts have no spans.  Very long texts are read whole,
by patterns that are linear in them.  Repeated rows get a row each.  A table without any
base span adds nothing.  An empty table gives an empty result.  Columns named
like what is made are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.bpe import slices
from foldspark.llm.common import ready, with_computed

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Chains and pairs of the sample; tokens of a chain of the sample (longer ones give several).
CHAINS, PAIRS, CHAIN = 20_000, 20_000, 24
#: Places of hashed features, rounds of fitting, rounds of messages and the part of a message that is kept.
PLACES, STEPS, ROUNDS, KEPT = 1 << 13, 150, 20, 0.3
#: Marginal from which a token is added.
SURE = 0.9

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An ``@`` ends the run of characters before it, so a match begins where that run does."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield start, found.end()
            last = found.end()
        else:
            last = at + 1  # a run never goes back over an "@"
        at = text.find("@", max(last, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base(text: str) -> list[Span]:
    """(kind, start, end) of all matches that pass, by kind and start."""
    out = [(0, *span) for span in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def run_on(text: str) -> list[tuple[int, int]]:
    """Spans of what looks like a card or phone number but has too many digits: it may hold one and something else."""
    cards = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 19 and len(_NOT_DIGIT.sub("", m[0])) > 19]
    return cards + [m.span() for m in _PHONE.finditer(text) if len(_NOT_DIGIT.sub("", m[0])) > 15]


def shape(token: str) -> str:
    """Lower-case letters as a, others A, digits as 0, with the lengths of runs up to 5; other characters as they are."""
    token = token[:64] + ("..." if len(token) > 64 else "")
    token = re.sub("[^\\W\\d_]", lambda m: "a" if m[0].islower() else "A", token)
    return re.sub(r"([aA0])\1*", lambda m: f"{m[1]}{min(len(m[0]), 5)}", re.sub("[0-9]", "0", token))


@dataclass
class Nodes:
    """The tokens of one text: spans, labels of base spans (NONE elsewhere), features, and links between them."""

    spans: list[tuple[int, int]]
    labels: list[int]
    features: list[list[int]]
    chain: list[bool]
    skips: list[tuple[int, int, int]]


def _place(name: str) -> int:
    return crc32(name.encode()) % PLACES


def _core(token: str) -> str:
    return re.sub(r"^[^\w+(]+|[^\w)]+$", "", token)


def _keys(token: str) -> list[str]:
    """By what a token is the same as or similar to another."""
    whole = "".join(c for c in token.lower() if c.isalnum())
    out = ["=" + whole] if len(whole) > 2 else []
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) >= 7:
        out.append("#" + digits[-7:])
    local = token.partition("@")[0].lower().strip(".,;:()[]<>\"'")
    if len(local) >= 5 and any(c.isdigit() for c in local):
        out.append("@" + local)
    return out


def strength(token: str) -> int:
    """Short tokens are often the same by chance: 0 below 4 letters and digits, 1 below 7, else 2."""
    n = sum(c.isalnum() for c in token)
    return 0 if n < 4 else 1 if n < 7 else 2


def nodes(text: str, spans: list[Span]) -> Nodes:
    found = [m.span() for m in _TOKEN.finditer(text)]
    words = [text[a:b] for a, b in found]
    labels = [NONE] * len(found)
    ends = np.array([b for _, b in found], np.int64)
    for kind, a, b in reversed(spans):  # of two kinds the first stays
        i = int(np.searchsorted(ends, a, "right"))
        while i < len(found) and found[i][0] < b:
            labels[i] = kind
            i += 1
    chain = [0 < i and found[i][0] - found[i - 1][1] <= 2 and text[found[i - 1][1] : found[i][0]].isspace() for i in range(len(found))]
    shapes = [shape(_core(w)) for w in words]
    features = []
    for i, w in enumerate(words):
        before = shapes[i - 1] if chain[i] else ""
        after = shapes[i + 1] if i + 1 < len(words) and chain[i + 1] else ""
        core = _core(w)
        digits = _NOT_DIGIT.sub("", core) if len(core) <= 64 else ""
        checked = f"L{len(digits)}{luhn(digits)}" if digits == core and len(digits) > 12 else ""
        near = f"{before}|{shapes[i]}|{after}"
        features.append([_place(x) for x in ("s" + shapes[i] + checked, "p" + before, "n" + after, "b" + near, f"@{core.count('@')}{core.count('.')}", f"d{min(len(digits), 20)}{checked}", "*")])
    last: dict[str, int] = {}
    skips: dict[tuple[int, int], int] = {}
    for i, w in enumerate(words):
        for key in _keys(w):
            if key in last:
                skips[last[key], i] = min(strength(words[last[key]]), strength(w))
            last[key] = i
    return Nodes(found, labels, features, chain, [(i, j, s) for (i, j), s in skips.items() if not (j == i + 1 and chain[j])])


def _chains(n: Nodes, unsure: list[tuple[int, int]]) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Features and labels of the chains, in parts of at most ``CHAIN`` tokens; not of those with a span of ``unsure``."""
    begin, at, unsure = 0, 0, sorted(unsure)
    for i in range(1, len(n.spans) + 1):
        if i == len(n.spans) or not n.chain[i] or i - begin == CHAIN:
            while at < len(unsure) and unsure[at][1] <= n.spans[begin][0]:
                at += 1
            if at == len(unsure) or unsure[at][0] >= n.spans[i - 1][1]:
                yield n.features[begin:i], n.labels[begin:i]
            begin = i


@dataclass
class Model:
    unary: np.ndarray
    chain: np.ndarray
    #: Log odds with which a token and its next occurrence agree, by strength.
    skip: np.ndarray


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(chains: list[tuple[list[list[int]], list[int], int]], pairs: list[tuple[int, int, int, int]]) -> Model:
    """From (features, labels, how many such) of chains and (strength, label, label, how many such) of pairs."""
    k = NONE + 1
    unary, chain = np.zeros((PLACES, k)), np.zeros((k, k))
    if chains:
        m, t = len(chains), max(len(y) for _, y, _ in chains)
        width = max(len(f) for x, _, _ in chains for f in x)
        where = np.zeros((m, t, width), np.int64)
        label, there = np.zeros((m, t), np.int64), np.zeros((m, t), bool)
        for c, (x, y, _) in enumerate(chains):
            where[c, : len(y)], label[c, : len(y)], there[c, : len(y)] = x, y, True
        weight = np.log1p(np.array([n for _, _, n in chains], float))
        mean_u, var_u, mean_c, var_c = np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(chain), np.zeros_like(chain)
        seen = np.eye(k)[label] * (there * weight[:, None])[..., None]
        both = there[:, 1:] & there[:, :-1]
        seen_pairs = np.einsum("mta,mtb,mt->ab", np.eye(k)[label[:, :-1]], np.eye(k)[label[:, 1:]], both * weight[:, None])
        flat = where.reshape(-1, width)
        for step in range(1, STEPS + 1):
            u = unary[where].sum(2)
            alpha, beta = np.zeros((m, t, k)), np.zeros((m, t, k))
            alpha[:, 0] = u[:, 0]
            for i in range(1, t):
                moved = _logsum(alpha[:, i - 1, :, None] + chain, 1)
                alpha[:, i] = np.where(there[:, i, None], moved + u[:, i], alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                moved = _logsum((beta[:, i + 1] + u[:, i + 1])[:, None, :] + chain, 2)
                beta[:, i] = np.where(there[:, i + 1, None], moved, 0.0)
            total = _logsum(alpha[:, -1], 1)
            p = np.exp(alpha + beta - total[:, None, None]) * (there * weight[:, None])[..., None]
            two = alpha[:, :-1, :, None] + chain + (u + beta)[:, 1:, None, :] - total[:, None, None, None]
            expected = np.einsum("mtab,mt->ab", np.exp(np.where(both[..., None, None], two, -np.inf)), both * weight[:, None])
            gap = (seen - p).reshape(-1, k)
            g = np.zeros_like(unary)
            for j in range(width):
                np.add.at(g, flat[:, j], gap)
            scale = weight.sum()
            for value, grad, mean, var in ((unary, g / scale - 1e-4 * unary, mean_u, var_u), (chain, (seen_pairs - expected) / scale - 1e-4 * chain, mean_c, var_c)):
                mean += 0.1 * (grad - mean)
                var += 0.01 * (grad * grad - var)
                value += 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    skip = np.zeros(3)
    for s in range(3):
        agree = sum(n for z, a, b, n in pairs if z == s and a == b != NONE)
        differ = sum(n for z, a, b, n in pairs if z == s and a != b)
        # Half a dozen agreements for long tokens are taken for granted, one for short ones.
        skip[s] = min(max(np.log((agree + (1, 3, 6)[s]) / (differ + 1)), 0.0), 4.0)
    return Model(unary, chain, skip)


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model, from the base spans of at most ``CHAINS`` different chains and ``PAIRS`` kinds of pairs; the tokens
    of all documents are looked at, and those chains are taken that hash lowest."""
    spark = ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices([x or 0 for x in pc.binary_length(batch.column(0)).to_pylist()], 1 << 20):
                rows = []
                for one in batch.column(0).slice(i, j - i).to_pylist():
                    if one:
                        n = nodes(one, base(one))
                        rows += [("chain", [p for f in x for p in f], y) for x, y in _chains(n, run_on(one))]
                        rows += [("pair", [s], [n.labels[a], n.labels[b]]) for a, b, s in n.skips if (n.labels[a], n.labels[b]) != (NONE, NONE)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["what", "x", "y"])

    # The same chain is told once, with how often it occurs, before it moves.
    told = docs.filter(F.col(text).rlike("[0-9@]")).select(text).mapInArrow(run, "what string, x array<int>, y array<int>").groupBy("what", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    order = F.xxhash64("x", "y"), "x", "y"
    chains = told.filter("what = 'chain'").orderBy(*order).limit(CHAINS).collect()
    pairs = told.filter("what = 'pair'").orderBy(*order).limit(PAIRS).collect()
    width = len(nodes("0", []).features[0])
    split = lambda x: [x[i : i + width] for i in range(0, len(x), width)]
    return fit([(split(r["x"]), r["y"], r["n"]) for r in chains], [(r["x"][0], *r["y"], r["n"]) for r in pairs])


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Each node's marginals by loopy message passing. ``edges`` (i, j) have log potentials[e, label of i, label of j]."""
    n, k = unary.shape
    out = unary.copy()
    if len(edges):
        source, goal = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        across = np.concatenate((potentials, potentials.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        sent = np.zeros((len(source), k))
        for _ in range(ROUNDS):
            out = unary.copy()
            np.add.at(out, goal, sent)
            made = _logsum((out[source] - sent[back])[:, :, None] + across, 1)
            made -= _logsum(made, 1)[:, None]
            sent = KEPT * sent + (1 - KEPT) * made
        out = unary.copy()
        np.add.at(out, goal, sent)
    return np.exp(out - _logsum(out, 1)[:, None])


def _trimmed(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """The span without what can't begin or end data of its kind."""
    first, last = (r"[A-Za-z0-9]", r"[A-Za-z0-9]") if kind == 0 else (r"[0-9]", r"[0-9]") if kind < 3 else (r"[+(0-9]", r"[0-9]")
    begin = re.compile(first).search(text, start, end)
    if not begin:
        return start, start
    while end > start and not re.match(last, text[end - 1]):
        end -= 1
    return begin.start(), end


def find(texts: list[str | None], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, those added) of each text."""
    out, graphs = [], []
    for text in texts:
        spans = base(text or "")
        out.append((spans, []))
        if text and spans or text and model.unary.any():
            graph = nodes(text, spans)
            if any(y == NONE for y in graph.labels):
                graphs.append((len(out) - 1, graph))
    if not graphs or not model.unary.any():
        return out
    unary, edges, potentials, at = [], [], [], 0
    same = [w * np.eye(NONE + 1) for w in model.skip]
    for _, g in graphs:
        u = model.unary[np.array(g.features)].sum(1)
        given = np.array(g.labels)
        known = given != NONE
        u[known] = -30.0
        u[known, given[known]] = 0.0
        unary.append(u)
        links = [(i - 1, i, model.chain) for i in range(len(g.spans)) if g.chain[i]] + [(i, j, same[s]) for i, j, s in g.skips]
        edges += [(at + i, at + j) for i, j, _ in links]
        potentials += [p for _, _, p in links]
        at += len(g.spans)
    p = marginals(np.concatenate(unary), np.array(edges, np.int64).reshape(-1, 2), np.array(potentials).reshape(-1, NONE + 1, NONE + 1))
    at = 0
    for row, g in graphs:
        own = p[at : at + len(g.spans)]
        at += len(g.spans)
        text, added, open_ = texts[row], [], None
        for i, (a, b) in enumerate(g.spans):
            kind = int(own[i].argmax())
            if kind == NONE or g.labels[i] != NONE or own[i, kind] < SURE:
                open_ = None
            elif open_ == kind and g.chain[i] and kind > 1 and _digits(text[added[-1][1] : b]) <= (19 if kind == 2 else 15):
                added[-1] = (kind, added[-1][1], b)
            else:
                added.append((kind, a, b))
                open_ = kind
        taken = sorted((a, b) for _, a, b in out[row][0])
        for kind, a, b in added:
            a, b = _trimmed(text, kind, a, b)
            if b > a and _passes(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
                out[row][1].append((kind, a, b))
    return out


def _passes(kind: int, found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    if kind == 1:
        return bool(_IP.fullmatch(found)) and all(map(_small, found.split(".")))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 7 <= len(digits) <= 15


def _digits(text: str) -> int:
    return len(_NOT_DIGIT.sub("", text))


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the number of base spans of each kind, their digest, all spans (kind:start:end) and how many were added."""
    ready(docs.sparkSession)

    def start():
        def apply(values: pa.Array) -> Iterator[list[pa.Array]]:
            for i, j in slices([x or 0 for x in pc.binary_length(values).to_pylist()], 1 << 20):
                rows = []
                for spans, added in find(values.slice(i, j - i).to_pylist(), model):
                    counts = [sum(k == kind for k, _, _ in spans) for kind in range(NONE)]
                    rows.append((*counts, sha256(told(spans).encode()).hexdigest(), told(spans + added), len(added)))
                yield [pa.array(c, pa.string() if 4 <= n < 6 else pa.int64()) for n, c in enumerate(zip(*rows))]

        return apply

    return with_computed(docs, text, _FIELDS, start)


def personal_data(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs.select("text"))).drop("text")
