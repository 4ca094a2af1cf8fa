"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its potentials come from features of the line and of its two neighbours, and from the
pair of labels of adjacent lines; forward-backward gives each line's marginal. A document's share of good lines, weighted
by their lengths, becomes its score through a logistic curve. The labels mark documents only, so training alternates:
lines start with their document's label, and lines of bad documents then take the label that the field itself gives
them, as long as enough of the document stays bad.

Training takes all labelled rows outside the held-out fifth. They are dealt by a hash of their id to blocks of about BLOCK_DOCS
texts; each block fits a field of its own, and the field is the mean of theirs, weighted by their texts (the mixture weight
method for conditional models). The curve is fitted on all of them. Scoring is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, give_back, slices, stored, utf8
from .kneser_ney import fit_curve, judged, training_rows

#: Labelled texts that a block fits its field on, more or less.
BLOCK_DOCS = 2_400
#: Score from which a document is kept.
KEEP = 0.3
ROUNDS, STEPS, RIDGE = 3, 100, 1e-3
#: Lines of documents that go through forward-backward together.
BATCH_LINES = 65_536
#: Bytes of texts whose lines are described at once (about 35 times as much memory); a text alone may be longer.
CHUNK_BYTES = 256 << 10

# Kinds of bytes whose shares of a line are its features.
_KIND = np.full(256, 7, np.int64)  # part of a letter beyond ASCII
_KIND[:128] = 6  # other signs
for _k, _of in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", ".,;:'\"-()?", "!|#$%&*@^~=_+<>{}[]\\/")):
    _KIND[[ord(c) for c in _of]] = _k
KINDS = 8
OWN = KINDS + 7
FEATURES = 3 * OWN + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines of all texts: features (own and neighbours'), lengths, and the number of lines of each text."""
    chunk = np.cumsum([len(t) + 1 for t in texts]) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
    x, length, lines = zip(*(_line_features(texts[s:e]) for s, e in pairwise(cuts)), strict=True)
    return np.concatenate(x), np.concatenate(length), np.concatenate(lines)


def _line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    ends = np.r_[np.flatnonzero(data == 10), len(data)]
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    sizes = np.array([len(t) for t in texts])
    of = np.searchsorted(np.cumsum(sizes + 1) - 1, starts, "left")  # which text a line begins in
    lines = np.bincount(of, minlength=len(texts))
    counts = np.zeros((len(starts), KINDS))
    if len(data):
        kind = _KIND[data]
        line = np.repeat(np.arange(len(starts)), length + 1)[: len(data)]
        inside = data != 10
        counts = np.bincount(line[inside] * KINDS + kind[inside], minlength=len(starts) * KINDS).reshape(-1, KINDS).astype(float)
    share = counts / np.maximum(length, 1)[:, None]
    word = length / (counts[:, 3] + 1)
    cut = [line.split() for line in joined.split(b"\n")]
    n = np.array([len(w) for w in cut], float)
    again = np.array([sum(map(eq, w, w[1:])) for w in cut]) / np.maximum(n - 1, 1)  # words that repeat the word before
    distinct = np.array([len(set(w)) for w in cut]) / np.maximum(n, 1)
    upper = counts[:, 1] / (counts[:, 0] + counts[:, 1] + 1)
    own = np.c_[share, np.minimum(word, 30) / 10, upper, share[:, 5] > 0.03, length == 0, again, again > 0.3, (distinct < 0.5) & (n > 5)]
    first = np.zeros(len(starts), bool)
    first[np.cumsum(lines)[:-1]] = True
    first[:1] = True
    last = np.r_[first[1:], True]
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    return np.c_[own, before, after, first, last, np.ones(len(starts))], length, lines


def _padded(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines in a (document, line) grid."""
    doc = np.repeat(np.arange(len(lines)), lines)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(lines) - lines, lines)


def marginals(emit: np.ndarray, pair: np.ndarray, lines: np.ndarray, edges: bool = False):
    """_forward_backward for documents of any lengths: those within a power of two go together."""
    good, expected = np.zeros(len(emit)), np.zeros((2, 2))
    doc, kind = np.repeat(np.arange(len(lines)), lines), np.frexp(lines)[1]
    for k in np.unique(kind):
        those = np.flatnonzero((kind == k)[doc])
        good[those], more = _forward_backward(emit[those], pair, lines[kind == k], edges)
        expected += more
    return (good, expected) if edges else good


def _forward_backward(emit: np.ndarray, pair: np.ndarray, lines: np.ndarray, edges: bool):
    """P(good) of each line by forward-backward, all documents at once; with edges also the expected counts of label pairs.

    emit: score of the label good (bad has 0); pair: 2 x 2 scores of adjacent labels. In logarithms, so long documents don't underflow.
    """
    doc, at = _padded(lines)
    most = int(lines.max(initial=1))
    e = np.zeros((len(lines), most, 2))
    e[doc, at, 1] = emit
    valid = np.zeros((len(lines), most), bool)
    valid[doc, at] = True
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for t in range(1, most):
        x = a[:, t - 1, :, None] + pair
        a[:, t] = np.logaddexp(x[:, 0], x[:, 1]) + e[:, t]
    for t in range(most - 2, -1, -1):
        x = pair + (e[:, t + 1] + b[:, t + 1])[:, None, :]
        b[:, t] = np.where(valid[:, t + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0)
    both = a + b
    good = 1 / (1 + np.exp(np.clip(both[..., 0] - both[..., 1], -500, 500)))
    if not edges:
        return good[doc, at], np.zeros((2, 2))
    total = np.logaddexp(both[..., 0], both[..., 1])
    expected = np.zeros((2, 2))
    for t in range(1, most):
        p = a[:, t - 1, :, None] + pair + (e[:, t] + b[:, t])[:, None, :] - total[:, t - 1, None, None]
        expected += np.exp(p[valid[:, t]]).sum(0)
    return good[doc, at], expected


class Field:
    def __init__(self, weights: np.ndarray, pair: np.ndarray, curve: np.ndarray):
        self.weights, self.pair, self.curve = weights, pair, curve

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, length, lines = line_features(texts)
        return marginals(x @ self.weights, self.pair, lines), length, lines

    def share(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; documents of like numbers of lines go together."""
        order = sorted(range(len(texts)), key=lambda i: texts[i].count(b"\n"))
        out, at = np.ones(len(texts)), 0
        while at < len(order):
            end = at
            while end < len(order) and (end == at or (end - at + 1) * (texts[order[end]].count(b"\n") + 1) <= BATCH_LINES):
                end += 1
            part = order[at:end]
            good, length, lines = self.lines([texts[i] for i in part])
            doc = np.repeat(np.arange(len(part)), lines)
            weight = length + 1e-6
            out[part] = np.bincount(doc, good * weight, len(part)) / np.bincount(doc, weight, len(part))
            at = end
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * self.share(texts) + self.curve[1], -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of a field and its scores of adjacent labels."""
    x, length, lines = line_features(texts)
    doc, at = _padded(lines)
    y = labels[doc].astype(float)
    balance = np.where(labels[doc] > 0, 0.5 / max((labels[doc] > 0).mean(), 1e-9), 0.5 / max((labels[doc] == 0).mean(), 1e-9))
    w, pair = np.zeros(FEATURES), np.zeros((2, 2))
    adjacent = np.flatnonzero(at > 0)
    for _ in range(ROUNDS):
        m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for step in range(1, STEPS + 1):  # Adam on the conditional log-likelihood
            good, expected = marginals(x @ w, pair, lines, edges=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, ((y[adjacent - 1] > 0.5).astype(int), (y[adjacent] > 0.5).astype(int)), 1)
            g = np.r_[x.T @ ((y - good) * balance) / len(y) - RIDGE * w, ((seen - expected) / len(y) - RIDGE * pair).ravel()]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w, pair = w + move[:-4], pair + move[-4:].reshape(2, 2)
        # Lines of bad documents that the field finds good are good, unless nothing bad would be left.
        good = marginals(x @ w, pair, lines)
        found = (good > 0.5).astype(float)
        bad_left = np.bincount(doc, (found < 0.5) * length, len(lines)) > 0.1 * np.bincount(doc, length, len(lines))
        y = np.where(labels[doc] > 0, 1.0, np.where(bad_left[doc], found, 0.0))
    return w, pair


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """None where there is nothing to learn from."""
    rows = stored(training_rows(docs, labels, "quality"), "labelled")
    count = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(count) < 2:
        dropped(rows)
        return None
    blocks = max(1, sum(count.values()) // BLOCK_DOCS)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, sorted by block -> the number of texts of each block and its field."""

        def told(texts: list[bytes], y: list[int]) -> pa.RecordBatch:
            w, pair = fit(texts, np.array(y))
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(y)], pa.int64()), pa.array([np.r_[w, pair.ravel()]], pa.list_(pa.float64()))], ["block", "n", "v"])

        at, texts, y = None, [], []
        for b in slices(batches):
            for block, text, label in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                if block != at:
                    if y:
                        yield told(texts, y)
                    at, texts, y = block, [], []
                texts.append(text)
                y.append(label)
        if y:
            yield told(texts, y)

    block = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(blocks)).cast("int").alias("block")
    dealt = rows.select(block, "doc_id", "text", "label").repartitionById(blocks, "block").sortWithinPartitions("block", "doc_id").select("block", "text", "label")
    fields = sorted(dealt.mapInArrow(learned, "block long, n long, v array<double>").collect())
    v = np.average([f.v for f in fields], axis=0, weights=[f.n for f in fields])
    field = Field(v[:-4], v[-4:].reshape(2, 2), np.array([1.0, 0.0]))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(field.share(utf8(b.column(0)))[:, None]), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    seen = stored(rows.select("text", "label").mapInArrow(shares, "x array<double>, y int"), "shares")
    dropped(rows)
    field = Field(field.weights, field.pair, fit_curve(seen))
    dropped(seen)
    return field


def scoring(docs: DataFrame, labels: DataFrame):
    """A function: texts -> scores, as learned from docs and their labels; 1 where there is nothing to learn from."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    give_back()
    return lambda texts: np.ones(len(texts)) if model.value is None else model.value.score(texts)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), one row for each row of docs.

    A null or empty text is one empty line. Where no class or only one is labelled, every score is 1.
    """
    return judged(docs, scoring(docs, labels), KEEP)
