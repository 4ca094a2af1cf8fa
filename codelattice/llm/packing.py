"""Best-fit packing of tokenised documents into sequences, with swap-based local search.

Lengths are whole numbers up to the capacity, so the packing is planned on their histogram, whose size doesn't depend
on the data: a class is a multiset of lengths and the number of sequences that are filled that way. Best fit by
decreasing length makes the first plan. Then a local search works on the underfull sequences: it moves a document, or
exchanges one for one, two for one or one for two, whenever the sum of squared fills grows, until no exchange helps.
Documents take their places in the plan by their rank among the pieces of their length; ranks come from counts by task
and length, so no length is gathered anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .common import slices, stored, utf8

#: Counts by task and length that may be broadcast (64 bytes each, 16 MB in all); more are joined by a shuffle of the narrow pieces.
BROADCAST_COUNTS = 250_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row for each piece of each document: its ids, then end_id; longer ones are cut into full pieces, the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_bpe.encoder(tokenizer).packed, byte_bpe.packed([end_id])
        task, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                ids = memoryview(encode(text.decode()) + end)
                n = len(ids) // 4
                at = [0] if n <= capacity else [*([0] if n % capacity else []), *range(n % capacity, n, capacity)]
                for k, (s, e) in enumerate(zip(at, [*at[1:], n], strict=True)):
                    rows.append((doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), task, ranks[e - s]))
                    ranks[e - s] += 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


class Plan:
    """Classes of sequences: a pattern (sorted lengths with their counts) -> how many sequences are filled that way."""

    def __init__(self, capacity: int):
        self.capacity, self.classes = capacity, Counter()

    def fill(self, pattern) -> int:
        return sum(x * n for x, n in pattern)

    def best_fit(self, histogram: dict[int, int]) -> None:
        """Decreasing best fit, whole classes at a time."""
        open_rooms, by_room = [], {}  # rooms in order; room -> [(pattern, number)]

        def put(pattern, number):
            room = self.capacity - self.fill(pattern)
            if room not in by_room:
                by_room[room] = []
                insort(open_rooms, room)
            by_room[room].append((pattern, number))

        for x in sorted(histogram, reverse=True):
            left = histogram[x]
            while left:
                at = bisect_left(open_rooms, x)
                if at == len(open_rooms):
                    each = self.capacity // x
                    if left >= each:
                        put(((x, each),), left // each)
                    if left % each:
                        put(((x, left % each),), 1)
                    break
                room = open_rooms[at]
                pattern, number = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    open_rooms.pop(at)
                each = min(room // x, max(1, left // number))
                used = min(number, left // each)
                if used < number:
                    put(pattern, number - used)
                put(changed(pattern, [x] * each, []), used)
                left -= each * used
        for rooms in by_room.values():
            for pattern, number in rooms:
                self.classes[pattern] += number

    def improve(self) -> None:
        """Local search: raises the sum of squared fills until the count of sequences can't fall, or no exchange helps.

        Two classes are compared when one of them is new or has become more, so pairs without a gain aren't tried again.
        """
        total, number = sum(self.fill(p) * n for p, n in self.classes.items()), sum(self.classes.values())
        self.open = {p: f for p in self.classes if (f := self.fill(p)) < self.capacity}
        queue = [(f, p) for p, f in self.open.items()]
        heapify(queue)
        while queue and number * self.capacity >= total + self.capacity:
            _, a = heappop(queue)
            if a in self.open and (best := self.best_exchange(a)):
                number -= self.exchange(*best)
                for p in {*best[:2], changed(best[0], best[3], best[2]), changed(best[1], best[2], best[3])} & self.open.keys():
                    heappush(queue, (self.open[p], p))

    def best_exchange(self, a):
        """(p, q, give, take) of the largest gain, by which a sequence of class p, or q, being a, and one of the other change; or None."""
        best, found = 0, None
        for b in self.open:
            if a == b and self.classes[a] < 2:
                continue
            for p, q in {(a, b), (b, a)}:
                apart, room = self.open[q] - self.open[p], self.capacity - self.open[q]
                most = min(room, self.open[p])
                if 2 * most * (apart + most) <= best:
                    continue
                for count, (sums, takes) in ((1, sums_of(q, 2)), (2, sums_of(q, 1))):
                    for give in gives(p, count):
                        # The gain rises with what moves, so the smallest sum that may come back is the best.
                        at = bisect_left(sums, sum(give) - room)
                        if at < len(sums) and 2 * (moved := sum(give) - sums[at]) * (apart + moved) > best and moved > 0:
                            best, found = 2 * moved * (apart + moved), (p, q, give, takes[at])
        return found

    def exchange(self, p, q, give, take) -> int:
        """As many sequences as there are of both classes take part; the number of sequences that run empty."""
        number = self.classes[p] // 2 if p == q else min(self.classes[p], self.classes[q])
        for pattern, n in ((p, -number), (q, -number), (left := changed(p, take, give), number), (changed(q, give, take), number)):
            self.classes[pattern] += n
            if not self.classes[pattern] or not pattern:
                del self.classes[pattern]
                self.open.pop(pattern, None)
            elif (f := self.fill(pattern)) < self.capacity:
                self.open[pattern] = f
        return 0 if left else number

    def places(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, run in a sequence, first sequence, offset): where the pieces of a length go, in order of their rank."""
        ranks, rows, sequence = Counter(), [], 0
        for pattern, number in sorted(self.classes.items()):
            offset = 0
            for x, n in pattern:
                rows.append((x, ranks[x], n, sequence, offset))
                ranks[x] += n * number
                offset += x * n
            sequence += number
        return sorted(rows)


@lru_cache(4096)
def gives(pattern, count: int) -> list[tuple[int, ...]]:
    """The groups of `count` lengths of a pattern."""
    return sorted(set(combinations([x for x, n in pattern for _ in range(min(n, count))], count)))


@lru_cache(4096)
def sums_of(pattern, most: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """The groups of up to `most` lengths, by their sums."""
    found = sorted((sum(g), g) for count in range(most + 1) for g in gives(pattern, count))
    return [s for s, _ in found], [g for _, g in found]


def changed(pattern, more, less):
    items = Counter(dict(pattern))
    items.update(more)
    items.subtract(less)
    return tuple(sorted((x, n) for x, n in items.items() if n))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    A null or empty text is a document of end_id alone. Repeated rows are packed each for itself; a null doc_id stays null.
    """
    cut = stored(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    plan = Plan(capacity)
    plan.best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()})  # `capacity` rows at most
    plan.improve()
    places = cut.sparkSession.sparkContext.broadcast(np.array(plan.places(), np.int64).reshape(-1, 5))  # classes are made by lengths: thousands of rows

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, run, sequence, offset = places.value.T
        keys = (length << 48) + first
        for b in batches:
            x, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, (x << 48) + rank, "right") - 1
            k = rank - first[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + k // run[at]), pa.array(offset[at] + k % run[at] * x)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = cut.join(F.broadcast(before) if counts.limit(BROADCAST_COUNTS + 1).count() <= BROADCAST_COUNTS else before, ["task", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank")).mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
