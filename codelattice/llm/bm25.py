"""Exact top-k search by BM25 over an inverted index, shard by shard, with block-max WAND pruning.

Documents are cut into shards of bounded size where they are read, without a shuffle, and each shard's inverted index is written
once to the shared folder: terms, their documents, frequencies. The document frequencies, number and mean length of all
documents are added up from the shards, so their top k merge into the exact top k. Queries go out in blocks of bounded
size; a task holds one shard's index and answers a whole block; a block's answers are written before the next goes out.

A posting list is cut into blocks by ranges of BLOCK documents, each with the largest impact in it. As in block-max WAND, the
sum of a query's block maxima bounds the score of every document in a range, and only ranges whose bound reaches the k-th
best score so far are opened; the postings of all others are skipped. Ranges near a query's best bound are opened first (instead
of moving cursors a document at a time), so the threshold is high before the others are looked at. In an opened range the dense
blocks, of terms that many of its documents hold, are added up by one product of matrices for all queries that open it, of
those columns alone that one of them asks for, the sparse ones by their postings. Queries go together that share their most
common terms, so mostly of one language, which leaves few columns. The products are in single precision and only choose the documents whose scores are then
computed in full. Dropping nothing that could tie, the result is exact; equal scores rank by doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Memo, dropped, give_back, hashed, slices, small_batches, stored, utf8, word_hashes

K1, B = 1.2, 0.75
#: Documents to a shard (their places take 16 bits), to a range, queries that go out together (about 3 KB each).
SHARD_DOCS, BLOCK, QUERY_BLOCK = 10_000, 1_024, 3_000
#: Share of a range's documents from which a term's block is dense.
DENSE = 0.1
#: Queries that are taken together; documents of which the best is looked at for a threshold (a divisor of BLOCK).
BATCH, TOGETHER = 128, 32
#: Ranges are opened first whose bound reaches this share of the best.
OPEN_FIRST = 0.15
#: Scores are rounded to so many digits, in which ties are seen.
DIGITS = 6
#: Bytes of words (A-Z lowered, all beyond ASCII kept); others part them.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its distinct terms: text numbers, term hashes, frequencies; and the texts' lengths."""
    counts = [Counter(t.translate(_WORDS).split()) for t in texts]
    size = np.array([len(c) for c in counts], np.int64)
    tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, size.sum())
    of = np.repeat(np.arange(len(texts)), size)
    return of, hashed(list(chain.from_iterable(counts)), memo), tf, np.bincount(of, tf, len(texts)).astype(np.int64)


def packed_index(ids: np.ndarray, of: np.ndarray, h: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> dict:
    """The postings of some documents by term, as bytes.

    Documents with the same most frequent common term (so mostly of one language) and like lengths get neighbouring
    numbers, which makes block maxima tight.
    """
    if len(h):
        names, at, df = np.unique(h, return_inverse=True, return_counts=True)
        at = at.astype(np.int32)
        favourite = np.lexsort((names[at], tf * (df[at] > 0.05 * len(ids)), of))  # the last of a document is its favourite
        last = np.flatnonzero(np.r_[of[favourite][1:] != of[favourite][:-1], True])
        key = np.full(len(ids), -1, np.int64)
        key[of[favourite][last]] = at[favourite][last]
        by = np.lexsort((lengths, key))
        place = np.empty(len(ids), np.int64)
        place[by] = np.arange(len(ids))
        ids, lengths, of = ids[by], lengths[by], place[of].astype(np.uint16)
        del names, at, favourite
        order = np.argsort(of, kind="stable")
        h, of, tf = h[order], of[order], tf[order]
    order = np.argsort(h, kind="stable")  # documents stay in order within a term
    h, of, tf = h[order], of[order], tf[order]
    del order
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return {"ids": ids.astype("<i8").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "names": h[starts].astype("<u8").tobytes(), "starts": starts.astype("<u4").tobytes(), "docs": of.astype("<u2").tobytes(), "tf": tf.astype("<u4" if len(tf) and tf.max() > 65_535 else "<u2").tobytes()}


class Shard:
    """The inverted index of some documents. A block holds the postings of a term in a range of documents and their largest impact; full
    blocks are dense, a column of their range's matrix (kept as a row), all others sparse."""

    def __init__(self, row: dict, mean: float):
        self.ids, lengths, self.names = (np.frombuffer(row[c], t) for c, t in (("ids", "<i8"), ("lengths", "<u4"), ("names", "<u8")))
        self.norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        doc = np.frombuffer(row["docs"], "<u2").astype(np.int32)
        n = len(doc)
        tf = np.frombuffer(row["tf"], "<u2" if len(row["tf"]) == 2 * n else "<u4")
        impact = _impact(tf, self.norm[doc])
        starts = np.frombuffer(row["starts"], "<u4").astype(np.int64)
        self.ranges = -(-len(self.ids) // BLOCK)
        # Blocks, one after another by term.
        new = np.zeros(n + 1, bool)
        new[1:-1] = doc[1:] // BLOCK != doc[:-1] // BLOCK
        new[starts] = True
        first = np.flatnonzero(new[:-1])
        size = np.diff(np.r_[first, n])
        self.blocks = np.searchsorted(first, np.r_[starts, n])
        self.range = doc[first] // BLOCK
        self.most = np.maximum.reduceat(impact, first) if n else impact
        # Dense blocks: columns are numbered range by range; impacts in single precision, for bounds, and frequencies.
        dense = np.flatnonzero(size > DENSE * BLOCK)
        dense = dense[np.argsort(self.range[dense], kind="stable")]
        self.column = np.full(len(first), -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        self.ends = np.searchsorted(self.range[dense], np.arange(self.ranges + 1))
        width = np.diff(self.ends)
        of = np.repeat(self.column, size)
        mine = of >= 0
        cell = of[mine].astype(np.int64)
        cell *= BLOCK
        cell += doc[mine] % BLOCK
        self.rough, self.tf = np.zeros(len(dense) * BLOCK, np.float32), np.zeros(len(dense) * BLOCK, tf.dtype)
        self.rough[cell], self.tf[cell] = impact[mine], tf[mine]
        self.rough, self.tf = self.rough.reshape(-1, BLOCK), self.tf.reshape(-1, BLOCK)
        del cell, of
        # Sparse blocks: first and last posting.
        mine = ~mine
        self.sparse = np.empty(int(np.count_nonzero(mine)), np.complex128)  # impact and document side by side, so one read gets both
        self.sparse.real, self.sparse.imag = impact[mine], doc[mine]
        size[dense] = 0
        self.last = np.cumsum(size)
        self.first = self.last - size
        # More than any two sums in single precision can differ from what they stand for, as a share.
        self.slack = 2 * (4 + int(width.max(initial=0))) * 2.0**-24

    def search(self, terms: np.ndarray, weights: np.ndarray, asked: np.ndarray, ends: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """terms (sorted) and weights: of all queries; a query asks for those numbered in asked from one of the ends to the next. For each
        query the k best (doc_id, score) of this shard; only scores above 0."""
        at = np.searchsorted(self.names, terms)
        ok = at < len(self.names)
        ok[ok] = self.names[at[ok]] == terms[ok]
        at[~ok] = -1
        for i in range(0, len(ends) - 1, BATCH):
            e = ends[i : i + BATCH + 1]
            some = asked[e[0] : e[-1]]
            ok = at[some] >= 0
            yield from self.batch(at[some[ok]], weights[some[ok]], np.repeat(np.arange(len(e) - 1), np.diff(e))[ok], len(e) - 1, k)

    def batch(self, at: np.ndarray, weight: np.ndarray, of: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """at, weight, of: terms of n queries, one query after another."""
        blocks, i = _spread(self.blocks[at], self.blocks[at + 1], np.arange(len(at)))
        upper = np.bincount(of[i] * self.ranges + self.range[blocks], self.most[blocks] * weight[i], n * self.ranges).reshape(n, -1)
        column = self.column[blocks]
        full = column >= 0
        # What a query asks of dense blocks, in order of the columns.
        asks, column, asked = of[i[full]], column[full], weight[i[full]]
        order = np.argsort(asks * int(self.ends[-1]) + column)
        column, asked, mine = column[order], asked[order], np.searchsorted(asks[order], np.arange(n + 1))
        rough = np.zeros((n, self.ends[-1]), np.float32)
        rough[asks[order], column] = asked
        used = np.zeros(self.ends[-1], bool)
        used[column] = True
        slack = self.slack * upper.max(1, initial=0) + 10.0**-DIGITS  # the latter for ties in the last digit
        blocks, i = blocks[~full], i[~full]
        cell = of[i] * self.ranges + self.range[blocks]
        threshold, held = np.zeros(n), [[] for _ in range(n)]
        # Ranges by falling bounds: those near a query's best bound give its threshold; the pivot is where no range can reach that.
        first = upper >= OPEN_FIRST * upper.max(1, initial=0, keepdims=True)
        for turn in (0, 1):
            opened = first & (upper > 0) if turn == 0 else ~first & (upper > 0) & (upper >= (threshold - slack)[:, None])
            near = np.zeros((n, self.ranges * BLOCK))
            for r in np.flatnonzero(opened.any(0)):
                who = np.flatnonzero(opened[:, r])
                columns = self.ends[r] + np.flatnonzero(used[self.ends[r] : self.ends[r + 1]])
                near[who, r * BLOCK : (r + 1) * BLOCK] = rough[np.ix_(who, columns)] @ self.rough[columns]
            # Opened blocks of a term that lie side by side are read as one.
            some = np.flatnonzero(opened.ravel()[cell])
            start, end, j = self.first[blocks[some]], self.last[blocks[some]], i[some]
            runs = np.flatnonzero(np.r_[True, (start[1:] != end[:-1]) | (j[1:] != j[:-1])][: len(j)])
            start, end, j = start[runs], end[np.r_[runs[1:], len(end)][: len(runs)] - 1], j[runs]
            cuts, v = np.searchsorted(of[j], np.arange(n + 1)), weight[j]
            for q in np.flatnonzero(opened.any(1)):
                some = slice(cuts[q], cuts[q + 1])
                postings, score = _spread(start[some], end[some], v[some])
                postings = self.sparse.take(postings)
                score *= postings.real
                score = np.bincount(postings.imag.astype(np.int64), score, self.ranges * BLOCK).astype(float, copy=False)  # of no postings it counts in whole numbers
                near[q] += score
                # The k-th best of the best of a few documents each: no more than the k-th best of all.
                best = near[q].reshape(TOGETHER, -1).max(0)
                if len(best) > k:
                    threshold[q] = max(threshold[q], float(np.partition(best, -k)[-k]))
                docs = np.flatnonzero(near[q] >= max(threshold[q] - slack[q], 1e-300))  # what isn't opened has 0
                held[q].append((docs, score[docs], near[q, docs]))
        for q in range(n):
            docs, exact, told = (np.concatenate([x[c] for x in held[q]]) if held[q] else np.zeros(0, t) for c, t in enumerate((np.int64, float, float)))
            if len(told) > k:
                ok = told >= np.partition(told, -k)[-k] - slack[q]
                docs, exact = docs[ok], exact[ok]
            columns, v = column[mine[q] : mine[q + 1]], asked[mine[q] : mine[q + 1]]
            cuts = np.searchsorted(columns, self.ends)
            for r in np.unique(docs // BLOCK):
                some, these = np.flatnonzero(docs // BLOCK == r), slice(cuts[r], cuts[r + 1])
                exact[some] += v[these] @ _impact(self.tf[columns[these, None], docs[some] % BLOCK], self.norm[docs[some]])
            exact = np.round(exact, DIGITS)
            docs, exact = docs[exact > 0], exact[exact > 0]
            best = np.lexsort((self.ids[docs], -exact))[:k]
            yield self.ids[docs[best]], exact[best]


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return tf * (K1 + 1) / (tf + norm)


def _spread(start: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of [start, end) one after another, with the value of their range."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size), np.repeat(value, size)


def alike(asked: np.ndarray, ends: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries that share their most common terms one after another: their order, what they ask and its ends in that order.

    many: documents of each term.
    """
    size = np.diff(ends)
    of = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((asked, -many[asked], of))
    top = [np.where(size > t, asked[by[np.minimum(ends[:-1] + t, len(by) - 1)]], -1) for t in range(3)] if len(by) else [size]
    order = np.lexsort(top[::-1])
    at, _ = _spread(ends[:-1][order], ends[1:][order], order)
    return order, asked[at], np.r_[0, np.cumsum(size[order])]


_INDEX = "ids binary, lengths binary, names binary, starts binary, docs binary, tf binary"
_INDEX_ARROW = pa.schema([(c, pa.binary()) for c in ("ids", "lengths", "names", "starts", "docs", "tf")])


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """docs(doc_id, text, ...), queries(query_id, text, ...) -> (query_id, rank, doc_id, score): the k best documents of each query.

    Terms are runs of letters (any beyond ASCII) and digits, A-Z lowered; a query counts each of its terms once, its
    whole text. Only documents that share a term are ranked, so a query may have fewer than k rows, or none if its
    text is null or empty. Rows with a null id are not searched; rows that repeat a doc_id are ranked each for itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    queries = queries.select("query_id", "text").where("query_id is not null")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, base = word_hashes(), [], 0

        def row():
            parts = [np.concatenate([x[i] for x in held]) for i in range(5)]
            held.clear()
            return pa.RecordBatch.from_pylist([packed_index(*parts)], schema=_INDEX_ARROW)

        for b in slices(batches, 1024):
            for s in (0, SHARD_DOCS - base) if base + b.num_rows > SHARD_DOCS else (0,):
                some = b.slice(s, SHARD_DOCS - base) if b.num_rows - s > SHARD_DOCS - base else b.slice(s)
                of, h, tf, n = terms(utf8(some.column(1)), memo)
                held.append((some.column(0).to_numpy(), (of + base).astype(np.uint16), h, tf.astype(np.uint32), n.astype(np.uint32)))
                base += some.num_rows
                if base == SHARD_DOCS:
                    yield row()
                    give_back()
                    base = 0
        if base:
            yield row()

    # Without a shuffle: partitions are joined into as many tasks as there are shards, or stay as they are.
    index = stored(docs.coalesce(max(1, -(-docs.count() // SHARD_DOCS))).mapInArrow(build, _INDEX), "index")

    def frequencies(batches):
        """Of each shard the number of documents of each term; documents and words under a name of their own, a null."""
        for b in batches:
            for row in b.to_pylist():
                names, starts = np.frombuffer(row["names"], "<i8"), np.frombuffer(row["starts"], "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.diff(np.r_[starts, len(row["docs"]) // 2])), pa.array(np.full(len(names), 2, np.int32))], ["h", "n", "kind"])
                told = [len(row["ids"]) // 8, int(np.frombuffer(row["lengths"], "<u4").sum())]
                yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.int64()), pa.array(told), pa.array([0, 1], pa.int32())], ["h", "n", "kind"])

    stats = stored(index.select("ids", "lengths", "names", "starts", "docs").mapInArrow(frequencies, "h long, n long, kind int").groupBy("h", "kind").agg(F.sum("n").alias("n")), "terms")
    told = {r.kind: r.n for r in stats.where("h is null").collect()}
    n_docs, mean = told.get(0) or 0, (told.get(1) or 0) / max(told.get(0) or 0, 1)

    def query_terms(batches):
        memo = word_hashes()
        for b in slices(batches):
            ids = b.column(0).to_numpy()
            of, h, _, _ = terms(utf8(b.column(1)), memo)
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(h.view(np.int64))], ["id", "h"])

    asked = queries.mapInArrow(query_terms, "id long, h long").distinct().join(stats.where("kind = 2").select("h", "n"), "h")
    asked = asked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("h", "n"))).alias("q"))  # bounded by a query's text
    asked = stored(asked, "asked")
    rounds = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.select(F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int").alias("round"), "id", F.col("q.h").alias("h"), F.col("q.n").alias("n"))

    paths = []
    for r in range(rounds):
        block = asked.where(F.col("round") == r).select("id", "h", "n").toArrow().combine_chunks()  # QUERY_BLOCK queries, more or less
        ids, h, n = (block.column(c).combine_chunks() for c in range(3)) if block.num_rows else (pa.array([], pa.int64()),) * 3
        packed = None
        if block.num_rows:
            # Each term goes out once, with its weight; queries name their terms by number.
            names, first, asks = np.unique(h.values.to_numpy().view(U64), return_index=True, return_inverse=True)
            many = n.values.to_numpy()[first]
            order, asks, ends = alike(asks.astype(np.int32), h.offsets.to_numpy(), many)
            packed = ids.to_numpy()[order], names, np.log(1 + (n_docs - many + 0.5) / (many + 0.5)), asks, ends
        packed = spark.sparkContext.broadcast(packed)

        def search(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 1) if packed.value else ():
                ids, *asked = packed.value
                shard = Shard({c: b.column(c)[0].as_buffer() for c in b.schema.names}, mean)  # read where it lies, not copied
                give_back()
                out = list(shard.search(*asked, k))
                del shard
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x[1]) for x in out])), pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], ["query_id", "doc_id", "score"])

        # A round's answers are written, so neither the plan nor what the driver holds grows with the number of queries.
        paths += stored(index.mapInArrow(search, "query_id long, doc_id long, score double"), "found").inputFiles()
        packed.unpersist(True)
    best = spark.read.schema("query_id long, doc_id long, score double").parquet(*paths) if paths else spark.createDataFrame([], "query_id long, doc_id long, score double")
    dropped(index)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
