"""Merkle fixity audit of WARC records.

Records are hashed under their key. The keys of the reference replica in order make up ranges of RANGE_KEYS, each a range of
offsets; the first keys of the ranges are the only thing that a replica has to know of another for a tree of its own. A leaf
of the tree hashes a range: its number, first key, number of keys, bytes, and the sums of the parts of its keys' hashes (keys
with sizes and digests; sums combine before a shuffle and leave no group to collect). A node hashes FANOUT children, up to one root.

Trees are built and stored for each replica alone. Two are compared root first, and only the children of differing nodes are
looked at: intact replicas differ in no root and nothing else is read; else the records of differing ranges, and of no others,
are compared by key. Offsets are told, not hashed, so a lost record doesn't make all ranges after it differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, dropped, stored

#: Children to a node, keys to a leaf.
FANOUT, RANGE_KEYS = 64, 1_024
#: Keys to a partition of the manifest.
PART_KEYS = 250_000


def warc_record(url: Column, payload: Column) -> Column:
    """A response record: header, payload, and the two line ends after it. Nulls are empty."""
    payload = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def hashed_records(records: DataFrame, key: str, record: Column) -> DataFrame:
    """(key, n_bytes, digest), one row for each key (null too): SHA-256 over the number of its records and the sums of their hashes' parts.

    The sums don't depend on an order and combine before the shuffle, so a key that repeats in many rows costs no more than others.
    """
    each = records.select(F.col(key).alias("key"), F.octet_length(record).cast("long").alias("n_bytes"), F.sha2(record, 256).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i in range(4)]
    sums = each.select("key", "n_bytes", *parts).groupBy("key").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(4)))
    return sums.select("key", "n_bytes", F.sha2(F.concat_ws(":", "n", "p0", "p1", "p2", "p3"), 256).alias("digest"))


def _parts(n: int, spark) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PART_KEYS)))


def _starts(rows: DataFrame, running: list[str], combine) -> DataFrame:
    """rows(part, ...): for each partition what the ones before it come to; one row for each partition reaches the driver."""
    out, state = [], [0] * len(running)
    for part, *values in sorted(map(tuple, rows.collect())):
        out.append((part, *state))
        state = [combine(x, y or 0) for x, y in zip(state, values, strict=True)]
    return rows.sparkSession.createDataFrame(out, ", ".join(["part long", *(f"{c} long" for c in running)]))


def manifest(hashed: DataFrame, n: int) -> DataFrame:
    """(key, range, place, first_offset, n_bytes, digest): the keys in order, with their place, the range of it and the offset of their bytes."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, offset = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = b.column(1).to_numpy()
            ends = offset + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part)), pa.array(np.arange(place, place + len(size))), pa.array(ends - size)], ["key", "n_bytes", "digest", "part", "place", "first_offset"])
            if len(size):
                place, offset = place + len(size), int(ends[-1])

    kind = dict(hashed.dtypes)["key"]
    local = stored(hashed.repartitionByRange(_parts(n, hashed.sparkSession), "key").sortWithinPartitions("key").mapInArrow(numbered, f"key {kind}, n_bytes long, digest string, part long, place long, first_offset long"), "manifest")
    start = _starts(local.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")), ["places", "offsets"], int.__add__)
    place = F.col("place") + F.col("places")
    return local.join(F.broadcast(start), "part").select("key", F.floor(place / RANGE_KEYS).alias("range"), place.alias("place"), (F.col("first_offset") + F.col("offsets")).alias("first_offset"), "n_bytes", "digest")


def splitters(manifest: DataFrame) -> DataFrame:
    """(key, range): the first key of each range."""
    return manifest.where(F.col("place") % RANGE_KEYS == 0).select("key", "range")


def ranged(hashed: DataFrame, n: int, firsts: DataFrame) -> DataFrame:
    """(key, range, n_bytes, digest): the keys of another replica under the ranges that begin with the given keys. Keys before the first are in range 0."""

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, schema = TaskContext.get().partitionId(), 0, None
        for b in batches:
            schema = b.schema
            here = np.maximum.accumulate(np.r_[at, b.column(3).fill_null(0).to_numpy()])[1:]
            at = int(here[-1]) if len(here) else at
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(here), pa.array(np.full(len(here), part))], [*schema.names, "part"]).filter(b.column(2).is_valid())
        if schema is not None:  # the last range that begins in this partition, in a row without a digest
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in [schema.field(i) for i in range(3)]), pa.array([at]), pa.array([part])], [*schema.names, "part"])

    kind = dict(hashed.dtypes)["key"]
    none = F.lit(None)
    both = hashed.select("key", "n_bytes", "digest", none.cast("long").alias("range")).unionByName(firsts.select("key", none.cast("long").alias("n_bytes"), none.cast("string").alias("digest"), "range"))
    dealt = both.repartitionByRange(_parts(n, hashed.sparkSession), "key").sortWithinPartitions("key", F.asc_nulls_last("range"))
    local = stored(dealt.mapInArrow(filled, f"key {kind}, n_bytes long, digest string, range long, part long"), "ranged")
    start = _starts(local.where("digest is null").select("part", "range"), ["before"], max)
    return local.where("digest is not null").join(F.broadcast(start), "part").select("key", F.greatest("range", "before").alias("range"), "n_bytes", "digest")


def leaves(keys: DataFrame) -> DataFrame:
    """keys(key, range, n_bytes, digest) -> (node, n_bytes, digest), a leaf for each range that holds a key."""
    each = keys.select("key", "range", "n_bytes", F.sha2(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("-")), "n_bytes", "digest"), 256).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i in range(4)]
    sums = each.select("key", "range", "n_bytes", *parts).groupBy("range").agg(F.min("key").alias("first"), F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(4)))
    return sums.select(F.col("range").alias("node"), "n_bytes", F.sha2(F.concat_ws(":", "range", F.coalesce(F.col("first").cast("string"), F.lit("-")), "n", "n_bytes", "p0", "p1", "p2", "p3"), 256).alias("digest"))


def tree(leaf: DataFrame, ranges: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Leaves of `ranges` ranges -> the levels (node, n_bytes, digest), leaves first, root last."""
    levels = [stored(leaf, "tree")]
    while ranges > 1:
        # At most `fanout` children to a node, under their numbers; a child that is missing is left out.
        child = F.array_sort(F.collect_list(F.struct("node", "digest")))
        told = F.array_join(F.transform(child, lambda c: F.concat_ws("=", c.node, c.digest)), ",")
        levels.append(stored(levels[-1].groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(F.sum("n_bytes").alias("n_bytes"), F.sha2(told, 256).alias("digest")), "tree"))
        ranges = math.ceil(ranges / fanout)
    return levels


def differing(good: list[DataFrame], other: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(node) of the leaves that differ, or that one tree alone has; descends from the roots into differing branches alone."""
    front = None
    for a, b in zip(reversed(good), reversed(other), strict=True):
        if front is not None:
            few = front.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
            parents = front.select(F.col("node").alias("parent"))
            parents = F.broadcast(parents) if few else parents
            a, b = (x.withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, "parent", "left_semi").drop("parent") for x in (a, b))
        both = a.select("node", F.col("digest").alias("x")).join(b.select("node", F.col("digest").alias("y")), "node", "full").where("not x <=> y").select("node")
        front = stored(both, "front")
        if front.isEmpty():
            break
    return front


@dataclass
class Replica:
    """A replica's keys under ranges, and its tree."""

    keys: DataFrame
    levels: list[DataFrame]
    ranges: int
    firsts: DataFrame

    def drop(self) -> None:
        for level in self.levels:
            dropped(level)
        dropped(self.keys)


def replica(records: DataFrame, key: str, record: Column, like: Replica | None = None) -> Replica:
    """The keys and the tree of a table of records; of `like` only the first keys of its ranges are read."""
    hashed = stored(hashed_records(records, key, record), "hashed")
    n = hashed.count()
    keys = manifest(hashed, n) if like is None else ranged(hashed, n, like.firsts)
    ranges = max(1, math.ceil(n / RANGE_KEYS)) if like is None else like.ranges
    out = Replica(keys, tree(leaves(keys), ranges), ranges, stored(splitters(keys), "splitters") if like is None else like.firsts)
    dropped(hashed)
    return out


def compared(good: Replica, other: Replica) -> DataFrame:
    """(key, first_offset, n_bytes, digest, other_digest), one row for each key whose records differ, from the records of differing ranges."""
    front = differing(good.levels, other.levels).select(F.col("node").alias("range"))
    front = F.broadcast(front) if front.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else front
    a = good.keys.join(front, "range", "left_semi").select("key", "first_offset", "n_bytes", "digest")
    b = other.keys.join(front, "range", "left_semi").select(F.col("key").alias("k"), F.col("digest").alias("other_digest"))
    both = a.join(b, F.col("key").eqNullSafe(F.col("k")), "full").where("not digest <=> other_digest")
    return both.select(F.coalesce("key", "k").alias("key"), "first_offset", "n_bytes", "digest", "other_digest")


def audit(good: DataFrame, other: DataFrame, key: str, record: Column) -> DataFrame:
    """Two replicas of a table of records -> (key, first_offset, n_bytes, digest, other_digest), one row for each key whose records differ.

    Offsets are those of the good replica. other_digest is null where the other replica lost the key; keys that only
    the other replica has come with a null offset, size and digest. A null key is a key, the first; records that repeat
    a key are hashed as a set with counts.
    """
    first = replica(good, key, record)
    second = replica(other, key, record, first)
    found = stored(compared(first, second), "differing")
    first.drop()
    second.drop()
    return found
