"""Toxicity by class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary texts, score each word (an expression with its ends marked). The highest
order is a word's whole beginning, so a long expression is known as such; it discounts the counts of its class. All lower
orders use continuation counts (how many different grams of the next order end in a gram), of both classes together up to
SHARED characters. So what is rare is smoothed through counts that both share, and an
expression that neither class knows well gets nearly the same likelihood from both. The discount of each order and class is
estimated from its grams seen once and twice. A text's evidence is its log-likelihood ratio divided by its length, the
ratios, divided by their lengths, of its most toxic expressions, and what expressions of large ratio make up of its words. A
logistic curve, fitted on labelled texts that the models haven't seen, turns the evidence into a score from 0 to 1.

Training takes all labelled rows outside the held-out fifth, read once and kept in the shared folder while the models are
made: words are counted and the curve is fitted where the rows are. The models hold every beginning of every word of those
rows, so they grow with the vocabulary; scoring is one pass over whole texts, whose memory is bounded by the models and a memo of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import BROADCAST_IDS, U64, dropped, give_back, mix, slices, stored, utf8, with_column

#: How many of five labelled texts go to the models (the rest fit the curve).
MODEL_SHARE = 3
#: Orders in characters, lowest first; the last is a word's whole beginning. Those up to SHARED are shared by the classes.
LEVELS, SHARED = (1, 2, 3, 0), 3
#: Ratio of an expression's likelihoods, as a logarithm, from which it counts as one of large ratio.
LARGE = 2.0
#: Characters that are scored at once, those that a process remembers scores of, and the longest word that is remembered.
CHUNK, MEMO_CHARS, MEMO_WORD = 60_000, 1_600_000, 64
#: Words whose grams are counted at once while the models are made, and words that a task counts before it hands its counts on.
MODEL_WORDS, COUNT_WORDS = 10_000, 100_000
_WORD = re.compile(r"[^\W\d_]+")
_BASE = U64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _flat(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with their ends marked, one after another: code points, places within their word, starts of the words."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in ws).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    n = np.array([len(w) + 2 for w in ws], np.int64)
    starts = np.cumsum(n) - n
    return codes, np.arange(len(codes)) - np.repeat(starts, n), starts


def _grams(codes: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """At each place the hash of the last k characters up to it, 0 where the word has fewer; k = 0: of the word's whole beginning."""
    with np.errstate(over="ignore"):
        if k:
            h = np.zeros(len(codes), U64)
            for back in range(k):
                h[back:] += codes[: len(codes) - back] * pow(int(_BASE), back + 1, 2**64)
            h = mix(h, k)
            h[place < k - 1] = 0
            return h
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _BASE))[place]
        sums = np.cumsum(codes * powers)
        before = np.r_[U64(0), sums][np.arange(len(codes)) - place]
        return mix(sums - before ^ place.astype(U64) << U64(48), 64)


def _contexts(codes: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """At each place the hash of what an order knows before it: k - 1 characters, or the word's beginning; 1 for the lowest order."""
    if k == 1:
        return np.full(len(codes), U64(1))
    return np.where(place > 0, np.r_[U64(0), _grams(codes, place, k - 1 if k else 0)[:-1]], U64(0))


class Table:
    """hash -> a row of values by binary search over sorted hashes; zeros where there is none."""

    def __init__(self, keys: np.ndarray, columns: Iterable[np.ndarray], width: int):
        """keys: sorted and distinct; columns: width of them, taken one at a time."""
        self.keys, self.values = keys, np.zeros((len(keys) + 1, width), np.float32)
        for i, column in enumerate(columns):
            self.values[:-1, i] = column

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        missing = at == len(self.keys)
        missing[~missing] = self.keys[at[~missing]] != keys[~missing]
        at[missing] = len(self.keys)
        return self.values[at].T.astype(float)


def _merged(parts: list[tuple[np.ndarray, ...]], plus: int = 0) -> list[np.ndarray]:
    """Columns of the parts, sorted by the first, whose repeated values become one row: of the last `plus` columns the sums, of others the first. Empties parts."""
    rows = [list(x) for x in parts]
    parts.clear()
    keys = np.concatenate([x.pop(0) for x in rows])
    give_back()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    columns = [keys[starts]]
    del keys
    while rows[0]:
        column = np.concatenate([x.pop(0) for x in rows])
        columns.append(np.add.reduceat(column[order], starts) if len(rows[0]) < plus else column[order[starts]])
        give_back()
    return columns


def discount(n: np.ndarray) -> float:
    """The Kneser-Ney discount from how many grams were seen once and twice; a half where none was seen once."""
    once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    return once / (once + 2 * twice) if once else 0.5


class Models:
    """The two class models over shared lower orders."""

    def __init__(self, ws, number: np.ndarray):
        """ws: distinct words (a list or an Arrow array); number: their counts in ordinary and in toxic texts, a row each."""
        if isinstance(ws, list):
            by = sorted(range(len(ws)), key=ws.__getitem__)
            ws, number = pa.array([ws[i] for i in by]), number[by]
        letters, held = np.zeros(0, U64), np.zeros(0, U64)
        # Of each order: (longer gram, gram, context), (gram, context, how often) and (gram, context, how often in each class).
        found: list[list[tuple]] = [[] for _ in LEVELS]
        for s in range(0, len(ws), MODEL_WORDS):
            codes, place, starts = _flat(ws[s : s + MODEL_WORDS].to_pylist())
            letters = np.union1d(letters, codes)
            counts = np.repeat(number[s : s + MODEL_WORDS].astype(np.float32), np.diff(np.r_[starts, len(codes)]), axis=0)
            grams, contexts = [_grams(codes, place, k) for k in LEVELS], [_contexts(codes, place, k) for k in LEVELS]
            names, first, at = np.unique(grams[-1], return_index=True, return_inverse=True)
            found[-1].append((names, contexts[-1][first], *(np.bincount(at, counts[:, c], len(names)).astype(np.float32) for c in range(2))))
            # Words are in order, so the beginnings that a part shares with those before it are those of the last word before it.
            first = first[(grams[-2][first] > 0) & ~np.isin(names, held)]
            held = grams[-1][starts[-1] :]
            g, one, n = np.unique(grams[-2][first], return_index=True, return_counts=True)
            found[-2].append((g, contexts[-2][first][one], n.astype(float)))
            for i in range(len(LEVELS) - 2):
                has = np.flatnonzero(grams[i] > 0)
                # A word's beginning that is shorter than the next order ends in nothing longer, and counts once.
                longer, one = np.unique(np.where(grams[i + 1][has] > 0, grams[i + 1][has], mix(grams[i][has], 99)), return_index=True)
                found[i].append((longer, grams[i][has][one], contexts[i][has][one]))
        self.floor = 1.0 / max(len(letters), 1)
        self.levels = []
        give_back()
        while found:
            i, parts = len(self.levels), found.pop(0)
            if i < len(LEVELS) - 2:
                _, g, context = _merged(parts)
                parts = [(g, context, np.ones(len(g)))]
            keys, context, *seen = _merged(parts, 2 if i == len(LEVELS) - 1 else 1)
            d = [discount(n) for n in seen]
            # Discounted counts of grams; of contexts the totals and what was discounted; a column, or two, for each class.
            table = Table(keys, (np.maximum(n - x, 0) for n, x in zip(seen, d, strict=True)), len(seen))
            del keys
            order = np.argsort(context, kind="stable")
            context = context[order]
            starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            context = context[starts]
            sums = (np.add.reduceat(f(n[order]), starts, dtype=float) for n, x in zip(seen, d, strict=True) for f in (lambda v: v, lambda v, x=x: np.minimum(v, x)))
            self.levels.append((table, Table(context, sums, 2 * len(seen))))
            del context, seen, order, sums
            give_back()

    def log_likelihoods(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every character of the words, their end marks included, the logarithms of its likelihood, a row for each class; places; starts."""
        codes, place, starts = _flat(ws)
        p = [np.full(len(codes), self.floor)]
        for k, (grams, contexts) in zip(LEVELS, self.levels, strict=True):
            g = _grams(codes, place, k)
            counts, rest = grams(g), contexts(_contexts(codes, place, k))
            p = [p[0], p[0]] if len(counts) > len(p) else p
            for c in range(len(p)):
                total, left = rest[2 * c], rest[2 * c + 1]
                known = (g > 0) & (total > 0)
                p[c] = np.where(known, (counts[c] + left * p[c]) / np.where(known, total, 1), p[c])
        return np.log(np.stack([p[0], p[-1]])), place, starts

    def log_ratio(self, ws: list[str]) -> np.ndarray:
        """For each word the toxic less the ordinary log-likelihood."""
        logs, place, starts = self.log_likelihoods(ws)
        return np.add.reduceat(np.where(place > 0, logs[1] - logs[0], 0.0), starts)


class Scorer:
    """Words -> ratios by a memo; texts -> evidence."""

    def __init__(self, models: Models):
        self.models, self.memo, self.held = models, {}, 0

    def ratios(self, ws: list[str]) -> Iterator[tuple[str, float]]:
        """Words in chunks of bounded length; a word alone may be longer."""
        chunk = np.cumsum([len(w) + 2 for w in ws]) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(ws)] if ws else [0]
        for s, e in pairwise(cuts):
            yield from zip(ws[s:e], self.models.log_ratio(ws[s:e]).tolist(), strict=True)

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Rows of: ratio by character; the best expression's ratio and the third best's, by their lengths' roots; root of the share of
        expressions of large ratio; mean of the best fiftieth."""
        cuts = [words(t) for t in texts]
        if self.held > MEMO_CHARS:
            self.memo, self.held = {}, 0
        long = {}
        for w, r in self.ratios(sorted(set(chain.from_iterable(cuts)).difference(self.memo))):
            if len(w) > MEMO_WORD:
                long[w] = r
            else:
                self.memo[w] = r
                self.held += len(w)
        out = np.zeros((len(texts), 5))
        for i, c in enumerate(cuts):
            if c:
                n = np.fromiter(map(len, c), float, len(c))
                r = np.fromiter((self.memo[w] if len(w) <= MEMO_WORD else long[w] for w in c) if n.max() > MEMO_WORD else map(self.memo.__getitem__, c), float, len(c))
                best = np.sort(r / np.sqrt(n + 2))[::-1]
                out[i] = r.sum() / (n.sum() + 2 * len(n)), best[0], best[min(2, len(best) - 1)], np.sqrt((r > LARGE).mean()), best[: -(-len(best) // 50)].mean()
        return out


def fit_curve(rows: DataFrame, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on the standardised columns of rows(x array<double>, y int), whose gradients are added up where the rows are; returns weights for [x, 1]."""

    def added(f) -> np.ndarray:
        """The sum of f(x, y) over all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([f(x, b.column(1).to_numpy()).ravel()], pa.list_(pa.float64()))], ["v"])

        return np.sum([r.v for r in rows.mapInArrow(run, "v array<double>").collect()], axis=0)

    n, *total = added(lambda x, _: np.r_[len(x), x.sum(0)])
    mean = np.array(total) / n
    scale = np.sqrt(added(lambda x, _: ((x - mean) ** 2).sum(0)) / n) + 1e-9
    w = np.zeros(len(mean) + 1)
    for _ in range(50):

        def slope(x, y, w=w):
            z = np.c_[(x - mean) / scale, np.ones(len(x))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.c_[z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z]

        both = added(slope).reshape(len(w), -1)
        step = np.linalg.solve(both[:, 1:] + ridge * np.eye(len(w)), both[:, 0] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int | None = None) -> DataFrame:
    """(doc_id, text, label): all labelled rows outside the held-out fifth; with a bound so many of each class at most, taken by a hash of their id.

    Contradicting or repeated labels of one doc_id count once, as the larger; of several texts of one doc_id the smallest is
    taken. The rows are chosen from the narrow labels before a text is read.
    """
    chosen = labels.where(f"doc_id is not null and {label} is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0").groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    if bound is not None:
        some = [chosen.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for c in (0, 1)]
        chosen = some[0].unionByName(some[1])
    few = chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame):
    """The models, broadcast, and the curve; None where a class has no labelled text."""
    rows = stored(training_rows(docs, labels, "toxic"), "labelled")
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}

        def told():
            ws = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([counts[w][0] for w in ws], pa.int64()), pa.array([counts[w][1] for w in ws], pa.int64())], ["w", "n0", "n1"])

        for b in slices(batches):
            for text, label in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                for w in set(words(text.decode())):  # a word counts once for a text: copies within a text say nothing new
                    counts.setdefault(w, [0, 0])[label] += 1
            if len(counts) > COUNT_WORDS:
                yield told()
                counts.clear()
        yield told()

    # The distinct words of the labelled texts, in order, so that parts of them share few beginnings.
    got = rows.where(part < MODEL_SHARE).select("text", "label").mapInArrow(counted, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0"), F.sum("n1")).orderBy("w").toArrow()
    number = np.stack([got.column(c).to_numpy() for c in (1, 2)], axis=1) if got.num_rows else np.zeros((0, 2))
    if not number.sum(0).all():
        dropped(rows)
        return None
    ws = got.column(0)
    del got
    scorer = Scorer(Models(ws, number))
    del ws, number
    give_back()
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    del scorer
    give_back()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = model.value.evidence([t.decode() for t in utf8(b.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rest = stored(rows.where(part >= MODEL_SHARE).select("text", "label").mapInArrow(seen, "x array<double>, y int"), "evidence")
    dropped(rows)
    classes = rest.select("y").distinct().count()
    curve = fit_curve(rest) if classes == 2 else np.array([10.0, 1.0, 1.0, 0.0, 0.0, -5.0])
    dropped(rest)
    return model, curve


def scoring(docs: DataFrame, labels: DataFrame):
    """A function: texts -> scores, as learned from docs and their labels; 0 where there is nothing to learn from."""
    learned = train(docs, labels)
    if learned is None:
        return lambda texts: np.zeros(len(texts))
    model, w = learned

    def score(texts: list[bytes]) -> np.ndarray:
        x = model.value.evidence([t.decode() for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))

    return score


def judged(docs: DataFrame, score, least: float) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted); a null doc_id is not held out."""
    scored = with_column(docs.select("doc_id", "text"), "score", DoubleType(), score)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), one row for each row of docs.

    Null and empty texts and texts without letters have no evidence and get the curve's value at none (0 where there
    is nothing to learn from).
    """
    return judged(docs, scoring(docs, labels), 0.5)
