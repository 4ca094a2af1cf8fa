"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Every shingle flips one bit of a sketch, so the Hamming distance
of two sketches is at most the size of the symmetric difference of the sets. Jaccard >= t holds exactly if
|A xor B| <= (|A| + |B|) * (1 - t) / (1 + t); the candidates come from the pigeonhole principle on that bound:

* Sizes fall into bands [2^k, 2^(k+1)); a pair is sought in the band of its larger set. A document signs for its own
  band and, where a partner can be that large, for the next.
* In a band the hash space is cut into blocks, more than there can be differences. A block's content is the XOR (the
  parity) of its shingles' hashes. A difference touches one block, so two similar sets agree on a non-empty block.
  With the prefix principle over one global order of the block contents, the first D + 1 non-empty blocks suffice (D:
  the most differences). The order puts blocks that hold nothing but frequent shingles last and fuller blocks first; it affects
  the speed only.
* A set that has no more than D non-empty blocks, and all sets in small bands, sign with single shingles.

Signatures travel in packed blobs of 6 bytes each, dealt by ranges of the key space; the number of ranges follows the bytes of
all texts, so a range has a bounded number of signatures but for a key that many documents share (12 bytes for each). In a
range, small groups give all their pairs and large groups a star around their smallest member. Pairs pass the bound on
sketches of full length, then the exact comparison of whole texts; a hub's sketch and text are copied once for HUB_MEMBERS
members, not once for each pair. Where the stars leave a large group in several components, its strays (members outside the
largest one) are compared by sketches with all its members, in cells of bounded size; a cell gives no more than a few pairs for
each stray a turn, the nearest first, and pairs that links have joined meanwhile are left out, until none is left. Later
turns take only the strays that have more. So no link between components is lost.

Null or empty texts and texts without words have the empty set and no links. Rows with a null doc_id are returned
with a null component. Where rows repeat a doc_id with other texts, each row gets the component of its own text, and
sets whose smallest doc_id is the same count as linked. Sets are told apart by 128-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, U64, Memo, dropped, hashed, mix, slices, small_batches, small_semi_join, stored, utf8, word_hashes
from .components import components

WORDS = 5
#: A band whose sets stay below this signs with single shingles.
RAW_BELOW = 128
#: Blocks in a band, as a share of its largest size.
BLOCKS = 0.6
#: Groups up to this size give all their pairs at once.
SMALL_GROUP = 8
#: Members of a large group in a cell (their sketches take CELL_BYTES at most, but for a longer one alone), and members that a stray is paired with in the first turn.
CELL_MEMBERS, CELL_BYTES, TURN_PAIRS = 2_048, 8 << 20, 2
#: Members that meet one copy of their hub.
HUB_MEMBERS = 512
#: Documents of a task whose signatures are packed together (their places take 16 bits).
PACK_DOCS = 2_048
#: Bytes of text to a range of the key space. A shingle takes two bytes at least, mostly six, and gives less than one signature.
RANGE_BYTES = 24 << 20
#: Documents that are looked at for frequent shingles; they only set the order of blocks.
ORDER_SAMPLE = 20_480
#: Frequent shingles that are kept for the order (8 bytes each, broadcast).
ORDER_SHINGLES = 65_536

_POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, k, 2**64) for k in range(WORDS)], U64)
_C1, _C2 = U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def shingle_sets(texts: list[bytes], memo: Memo) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes. bytes.lower() lowers A-Z alone; bytes.split() cuts at x20, x09-x0D."""
    words = [t.lower().split() for t in texts]
    flat = hashed(list(chain.from_iterable(words)), memo)
    n = len(flat) - WORDS + 1
    with np.errstate(over="ignore"):
        rolled = mix(sum((flat[k : n + k] * _POWERS[k] for k in range(1, WORDS)), flat[:n] * _POWERS[0])) if n > 0 else flat[:0]
    sets, at = [], 0
    for w in words:
        if len(w) >= WORDS:
            sets.append(np.unique(rolled[at : at + len(w) - WORDS + 1]))
        else:
            sets.append(np.array([xxhash.xxh64_intdigest(b" ".join(w), len(w))] if w else [], U64))
        at += len(w)
    return sets


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return (int(np.add.reduce(mix(h, 3), dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(mix(h, 4)).view(np.int64))) if len(h) else (0, 0)


def sketch(h: np.ndarray) -> bytes:
    """One bit flipped for each shingle, eight to sixteen bits a shingle and a power of two in all."""
    bits = 8 << len(h).bit_length()
    counts = np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches; the longer one is folded by XOR to the shorter, which keeps parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def differences(a: int, b: int, percent: int) -> int:
    """The most elements in which sets of these sizes may differ: 100 * inter >= percent * union."""
    return (a + b) * (100 - percent) // (100 + percent)


def _raw_keys(h: np.ndarray, late: np.ndarray, prefix: int, salt: int) -> np.ndarray:
    keys = mix(h ^ U64(salt), 5)
    order = (late.astype(U64) << U64(63)) | (keys >> U64(1))
    return keys[np.argsort(order, kind="stable")[:prefix]]


def signatures(h: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set. Two sets with enough overlap share one at least. frequent: sorted hashes."""
    a = len(h)
    if not a:
        return h
    own, most = a.bit_length() - 1, a * 100 // percent
    late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h if len(frequent) else np.zeros(a, bool)
    places, parts = mix(h, 1) >> U64(32), mix(h, 2)
    found = []
    for band in (own, *range(own + 1, most.bit_length())):
        largest = min(most, (2 << band) - 1)
        smallest = -(-a * percent // 100) if band == own else 1 << band
        prefix = a - (-(-(a + smallest) * percent // (100 + percent))) + 1
        if 2 << band <= RAW_BELOW:
            found.append(_raw_keys(h, late, prefix, band))
            continue
        d = differences(a, largest, percent)
        block = (places * U64(BLOCKS * (2 << band))) >> U64(32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        parity = np.bitwise_xor.reduceat(parts[order], starts)
        full = np.diff(np.r_[starts, a])
        last = np.bitwise_and.reduceat(late[order], starts)
        with np.errstate(over="ignore"):
            keys = mix(parity ^ block[starts] * _C1 ^ U64(64 + band) * _C2)
        rank = (last.astype(U64) << U64(63)) | ((U64(31) - np.minimum(full, 31).astype(U64)) << U64(58)) | (keys >> U64(6))
        found.append(keys[np.argsort(rank, kind="stable")[: d + 1]])
        if len(starts) <= d:
            found.append(_raw_keys(h, late, prefix, 128 + band))
    return np.concatenate(found)


_SIGNED = "rng int, node0 long, blob binary, doc_id long, node long, n int, fp1 long, fp2 long, sketch binary"
_SIGNED_ARROW = pa.schema([("rng", pa.int32()), ("node0", pa.int64()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sketch", pa.binary())])


def _sign(ranges: int, frequent, percent: int):
    """Rows of two kinds: for each document its node, size, fingerprint and sketch; for each range a blob of keys and places."""

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SIGNED_ARROW], schema=_SIGNED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, late = word_hashes(), frequent.value
        base, place, seen, keys, places = TaskContext.get().partitionId() << 32, 0, set(), [], []

        def packed():
            if keys:
                k = np.concatenate(keys)
                p = np.repeat(np.array([x for x, _ in places], np.uint16), [x for _, x in places])
                r = ((k >> U64(32)) * U64(ranges)) >> U64(32)
                order = np.argsort(r, kind="stable")
                k, p, r = (k[order] & U64(0xFFFFFFFF)).astype(np.uint32), p[order], r[order]
                cuts = np.flatnonzero(np.r_[True, np.diff(r) != 0])
                ends = np.r_[cuts[1:], len(r)]
                for i in range(0, len(cuts), 256):
                    part = slice(i, i + 256)
                    blobs = [k[s:e].tobytes() + p[s:e].tobytes() for s, e in zip(cuts[part], ends[part], strict=True)]
                    yield rows({"rng": r[cuts[part]].astype(np.int32), "node0": np.full(len(blobs), base + place - place_in), "blob": blobs}, len(blobs))

        place_in = 0  # documents since the last packing
        for b in slices(batches):
            ids, texts = b.column(0), utf8(b.column(1))
            sets = shingle_sets(texts, memo)
            out = {"doc_id": ids, "node": np.arange(base + place, base + place + len(sets)), "n": [len(h) for h in sets], "sketch": [sketch(h) if len(h) else None for h in sets]}
            out["fp1"], out["fp2"] = zip(*(prints := [fingerprint(h) for h in sets]), strict=True)
            yield rows(out, len(sets))
            for h, fp, i in zip(sets, prints, ids.is_valid().to_pylist(), strict=True):
                if len(h) and i and fp not in seen:
                    seen.add(fp)
                    keys.append(signatures(h, late, percent))
                    places.append((place_in, len(keys[-1])))
                place, place_in = place + 1, place_in + 1
            if place_in > PACK_DOCS:
                yield from packed()
                place_in, seen, keys, places = 0, set(), [], []
        yield from packed()

    return run


_PAIRED = "l long, r long, gid long, size long, members array<long>"
_PAIRED_ARROW = pa.schema([("l", pa.int64()), ("r", pa.int64()), ("gid", pa.int64()), ("size", pa.int64()), ("members", pa.list_(pa.int64()))])


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs, sorted by range -> pairs of nodes that share a key; large groups as parts of their members under the hub l."""

    def grouped(keys: np.ndarray, nodes: np.ndarray):
        """Pairs and large groups of a range, a part of the keys at a time."""
        left, right, told = [], [], set()
        part = (keys >> np.uint32(29)).astype(np.uint8)
        for p in range(8):
            some = np.flatnonzero(part == p)
            if not len(some):
                continue
            k, v = keys[some], nodes[some]
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            # Keys of one node alone, most of them, are left out from here on.
            v = v[np.repeat(sizes > 1, sizes)]
            sizes = sizes[sizes > 1]
            starts = np.cumsum(sizes) - sizes
            size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
            for d in range(1, SMALL_GROUP):
                i = np.flatnonzero((size[d:] <= SMALL_GROUP) & (first[d:] == first[:-d])) if len(v) > d else []
                if len(i):
                    left.append(v[i])
                    right.append(v[i + d])
            for g in np.flatnonzero(sizes > SMALL_GROUP):
                s, e = starts[g], starts[g] + sizes[g]
                gid = xxhash.xxh64_intdigest(v[s:e].tobytes())
                if gid not in told:
                    told.add(gid)
                    parts = [v[x : min(x + 8192, e)] for x in range(s, e, 8192)]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v[s])), pa.nulls(n, pa.int64()), pa.array(np.full(n, gid, U64).view(np.int64)), pa.array(np.full(n, e - s)), pa.array(parts, pa.list_(pa.int64()))], schema=_PAIRED_ARROW)
        l, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if len(l):
            names, at = np.unique(np.r_[l, r], return_inverse=True)
            both = np.unique(at[: len(l)].astype(U64) * U64(len(names)) + at[len(l) :].astype(U64))
            l, r = names[(both // U64(len(names))).astype(np.int64)], names[(both % U64(len(names))).astype(np.int64)]
            ok = l != r
            l, r = l[ok], r[ok]
            for x in range(0, len(l), 65_536):
                n = len(l[x : x + 65_536])
                yield pa.RecordBatch.from_arrays([pa.array(l[x : x + n]), pa.array(r[x : x + n]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], schema=_PAIRED_ARROW)

    at, keys, nodes = None, [], []
    for b in slices(batches, 8):
        for rng, node0, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if rng != at:
                if keys:
                    yield from grouped(np.concatenate(keys), np.concatenate(nodes))
                at, keys, nodes = rng, [], []
            n = len(blob) // 6
            keys.append(np.frombuffer(blob, "<u4", n))
            nodes.append(np.frombuffer(blob, "<u2", n, 4 * n).astype(np.int64) + node0)
    if keys:
        yield from grouped(np.concatenate(keys), np.concatenate(nodes))


def _by_hub(batches: Iterator[pa.RecordBatch], read, keep) -> Iterator[pa.RecordBatch]:
    """Rows (c, salt, m, n, value), sorted so that hubs (m null) come before their members -> the (c, salt, m) that keep(hub, member)
    accepts for a hub of the same c and salt. read makes the values of a slice comparable; one hub is held at a time."""
    at, hubs = None, []
    for b in slices(batches, 256):
        c, salt, m, n = (b.column(i).to_pylist() for i in range(4))
        found = []
        for i, value in enumerate(read(b.column(4))):
            if (c[i], salt[i]) != at:
                at, hubs = (c[i], salt[i]), []
            if m[i] is None:
                hubs.append((n[i], value))
            else:
                found.append(any(keep(*hub, n[i], value) for hub in hubs))
        yield b.select([0, 1, 2]).filter(b.column(2).is_valid()).filter(pa.array(found, pa.bool_()))


def _near(percent: int):
    """Keeps pairs whose sizes and sketches allow the similarity."""

    def keep(x: int, p: bytes, y: int, q: bytes) -> bool:
        return 100 * min(x, y) >= percent * max(x, y) and hamming(p, q) <= differences(x, y, percent)

    return lambda batches: _by_hub(batches, lambda column: column.to_pylist(), keep)


def _linked(percent: int):
    """The exact comparison of two whole texts."""

    def keep(_, x: np.ndarray, __, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        yield from _by_hub(batches, lambda column: shingle_sets(utf8(column), memo), keep)

    return run


def _folded(raw: list[bytes], width: int) -> np.ndarray:
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in raw])
    return bits.view(U64) if width % 8 == 0 else bits


def _within(percent: int, turn: int):
    """A cell holds some of a group's strays (members outside its largest component) and some of all its members. For each
    stray the members whose sketches allow the similarity and whose component differs by now, the nearest first: in turn 0
    the first TURN_PAIRS, then eight times as many each turn (those that were compared before among them, so that none is
    missed where links have joined others). A row (stray, null, gid, component) tells that a stray has more."""
    high = TURN_PAIRS * 8**turn

    def run(t: pa.Table) -> pa.Table:
        stray, ids, comp, now, n = (t.column(c).to_numpy() for c in ("stray", "id", "component", "now", "n"))
        own = t.column("own").to_numpy(zero_copy_only=False)
        raw = np.array(t.column("sketch").to_pylist(), object)
        width = np.array([len(x) for x in raw])
        xs, ys, far = [], [], []
        for w in np.unique(width[own]):
            rows = np.flatnonzero(own & (width == w))
            for v in np.unique(width[~own]):
                if not w <= 2 * v <= 4 * w:  # sizes of one width lie within a power of two
                    continue
                others = np.flatnonzero(~own & (width == v))
                others = others[np.argsort(n[others], kind="stable")]
                mine, theirs, sizes = _folded(raw[rows], min(v, w)), _folded(raw[others], min(v, w)), n[others].astype(np.int64)
                for x, bits in zip(rows, mine, strict=True):
                    a = int(n[x])
                    at = np.arange(np.searchsorted(sizes, -(-a * percent // 100)), np.searchsorted(sizes, a * 100 // percent, "right"))
                    y = others[at]
                    # Two strays meet twice; the one with the smaller id counts.
                    ok = (now[y] != now[x]) & ((stray[y] == 0) | (ids[x] < ids[y]))
                    at, y = at[ok], y[ok]
                    if len(y):
                        apart = np.bitwise_count(theirs[at] ^ bits).sum(1, dtype=np.int64)
                        ok = apart <= (a + sizes[at]) * (100 - percent) // (100 + percent)
                        y, apart = y[ok], apart[ok]
                        if len(y) > high + 1:
                            some = np.lexsort((ids[y], apart))[: high + 1]
                            y, apart = y[some], apart[some]
                        xs.append(np.full(len(y), x))
                        ys.append(y)
                        far.append(apart)
        x, y, apart = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (xs, ys, far))
        order = np.lexsort((ids[y], apart, x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
        chosen, more = rank < high, np.unique(x[rank >= high])
        n = int(chosen.sum())
        told = {"c": np.r_[ids[x[chosen]], ids[more]], "m": [*ids[y[chosen]].tolist(), *[None] * len(more)], "gid": [None] * n + t.column("gid").take(more).to_pylist(), "component": [None] * n + comp[more].tolist()}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in told.items()})

    return run


def _frequent(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles that many of a few documents share. A hint for the order of blocks; results don't depend on it."""

    def shingles(batches):
        memo = word_hashes()
        for b in slices(batches):
            sets = shingle_sets(utf8(b.column(0)), memo)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    some = docs.select("text").where(F.rand(17) < min(1.0, ORDER_SAMPLE / max(n_docs, 1)))
    least = 4
    top = some.mapInArrow(shingles, "h long").groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(ORDER_SHINGLES)
    return np.sort(top.select("h").toArrow().column(0).to_numpy().astype(np.int64).view(U64))


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id), one row for each row of docs.

    component_id: the smallest doc_id that is reached by links 100 * |A & B| >= percent * |A | B| between sets of
    distinct 5-word shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(16, (size.bytes or 0) // RANGE_BYTES)
    frequent = spark.sparkContext.broadcast(_frequent(docs, size.n))
    signed = stored(docs.mapInArrow(_sign(ranges, frequent, percent), _SIGNED).withColumn("kind", F.when(F.col("rng").isNull(), "set").otherwise("blob")), "signed", "kind")
    blobs = signed.where("kind = 'blob'").select("rng", "node0", "blob").repartitionById(ranges, "rng").sortWithinPartitions("rng", "node0")
    paired = stored(blobs.mapInArrow(_pair, _PAIRED), "paired")
    dropped(signed, "kind=blob")
    signed = signed.where("kind = 'set'")

    sets = signed.select("doc_id", "node", "n", "fp1", "fp2")
    reps = sets.where("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.min("node").alias("node"))
    member = stored(sets.where("n > 0 and doc_id is not null").join(reps.select("fp1", "fp2", "rep"), ["fp1", "fp2"]).select("node", "rep", "n"), "members")
    sketches = signed.select("node", "n", "sketch").join(reps.select("node", "rep"), "node").select("rep", "n", "sketch")
    named = member.select("node", "rep")

    def by_hub(pairs: DataFrame, rows: DataFrame, keep) -> DataFrame:
        """pairs(c, salt, m), rows(rep, n, value) -> the pairs that keep lets through. A hub's value is copied once for each of its salts."""
        hubs = pairs.select("c", "salt").distinct().join(rows.withColumnRenamed("rep", "c"), "c").select("c", "salt", F.lit(None).cast("long").alias("m"), "n", "value")
        members = pairs.join(rows.withColumnRenamed("rep", "m"), "m").select("c", "salt", "m", "n", "value")
        return hubs.union(members).repartition("c", "salt").sortWithinPartitions("c", "salt", F.asc_nulls_first("m")).mapInArrow(keep, "c long, salt int, m long")

    def linked(pairs: DataFrame) -> DataFrame:
        """pairs(c, salt, m) -> links(a, b), by exact comparison of whole texts."""
        ids = pairs.select(F.col("c").alias("doc_id")).union(pairs.select("m")).distinct()
        texts = stored(small_semi_join(docs, ids, "doc_id", ids.limit(BROADCAST_IDS + 1).count()).dropDuplicates(["doc_id", "text"]), "texts")
        rows = texts.select(F.col("doc_id").alias("rep"), F.lit(None).cast("int").alias("n"), F.col("text").alias("value"))
        found = stored(by_hub(pairs, rows, _linked(percent)).select(F.col("c").alias("a"), F.col("m").alias("b")).distinct(), "links")
        dropped(texts)
        return found

    # Hubs are named before their members are spread out, so no key of the joins on nodes is hot.
    parts = paired.where("gid is not null").dropDuplicates(["gid", "members"]).join(named.toDF("l", "hub"), "l")
    groups = stored(parts.select("gid", "hub", "size", F.explode("members").alias("node")).join(member, "node").select("gid", "hub", "size", F.col("rep").alias("id"), "n").distinct(), "groups")
    pairs = paired.where("gid is null").select("l", "r").distinct().join(named.toDF("l", "x"), "l").join(named.toDF("r", "y"), "r").where("x <> y")
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / HUB_MEMBERS)).cast("int")
    spokes = groups.where("id <> hub").select(F.col("hub").alias("c"), salt.alias("salt"), F.col("id").alias("m"))
    star = pairs.select(F.least("x", "y").alias("c"), F.lit(0).alias("salt"), F.greatest("x", "y").alias("m")).union(spokes).groupBy("c", "m").agg(F.max("salt").alias("salt"))
    near = stored(by_hub(star.select("c", "salt", "m"), sketches.withColumnRenamed("sketch", "value"), _near(percent)), "near")
    dropped(paired)
    links = linked(near)
    dropped(near)
    found = components(links)
    dropped(links)

    # The groups that the stars leave in more than one component: their strays are compared with all members, in cells.
    labelled = groups.join(found, "id", "left").select("gid", "id", "n", F.coalesce("component", "id").alias("component"))
    of = labelled.groupBy("gid", "component").agg(F.count("*").alias("size"), F.sum(2 * F.col("n")).alias("bytes"))
    of = of.groupBy("gid").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("size"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts"))
    heavy = F.greatest(F.lit(CELL_MEMBERS / CELL_BYTES) * F.col("bytes") / F.col("size"), F.lit(1.0))  # by bytes where sets are large
    cells = lambda n: F.greatest(F.ceil(n * heavy / CELL_MEMBERS), F.lit(1)).cast("int")
    split = stored(of.where("parts > 1").select("gid", "main", cells(F.col("size")).alias("columns"), cells(F.col("size") - F.col("most")).alias("rows")), "split")
    held = labelled.join(F.broadcast(split) if split.count() <= BROADCAST_IDS else split, "gid").withColumn("stray", (F.col("component") != F.col("main")).cast("int"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    kept = ["gid", "id", "component", "stray"]
    spread = held.where("stray = 1").select(*kept, F.lit(True).alias("own"), own("rows").alias("i"), F.explode(to("columns")).alias("j"))
    spread = spread.union(held.select(*kept, F.lit(False).alias("own"), F.explode(to("rows")).alias("i"), own("columns").alias("j")))
    spread = stored(spread.join(sketches.withColumnRenamed("rep", "id"), "id"), "spread")
    parts = stored(held.select("gid", "component").distinct(), "parts")
    dropped(groups)
    turn, more, merged, done, cells = 0, [], None, [], spread.withColumn("now", F.col("component"))
    while True:
        pairs = stored(cells.groupBy("gid", "i", "j").applyInArrow(_within(percent, turn), "c long, m long, gid long, component long").distinct(), "cross")
        for x in done:
            dropped(x)
        more.append(linked(pairs.where("m is not null").select("c", F.lit(0).alias("salt"), "m")))
        # Links between components; few against the links of the stars.
        between = reduce(DataFrame.union, more)
        for end in ("a", "b"):
            between = between.join(found.select(F.col("id").alias(end), F.col("component").alias("of")), end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
        merged = components(between)
        # A further turn only for the strays that have more such members, in groups that still are in several components, and
        # there only with members of another component than all of these strays. Components, not members, are labelled anew.
        waiting = pairs.where("m is null").select("gid", F.col("c").alias("id"), "component")
        now = parts.join(waiting.select("gid").distinct(), "gid").join(merged.toDF("component", "now"), "component", "left")
        now = stored(now.select("gid", "component", F.coalesce("now", "component").alias("now")), "now")
        several = now.groupBy("gid").agg(F.min("now").alias("x"), F.max("now").alias("y")).where("x <> y").select("gid")
        left = stored(waiting.join(several, "gid").join(now, ["gid", "component"]).select("gid", "id", "now"), "left")
        done = [now, left]
        dropped(pairs)
        if not left.limit(1).count():
            break
        turn += 1
        span = left.groupBy("gid").agg(F.min("now").alias("x"), F.max("now").alias("y"))
        others = now.join(span, "gid").where("x <> y or now <> x").select("gid", "component", "now")
        cells = spread.where("own").join(left, ["gid", "id"]).unionByName(spread.where("not own").join(others, ["gid", "component"]))
    for x in done:
        dropped(x)
    dropped(parts)
    dropped(spread)
    label = member.select("node", "rep").join(found.toDF("rep", "component"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    label = label.join(merged.toDF("component", "merged"), "component", "left").select("node", F.coalesce("merged", "component").alias("component_id"))
    rows = sets.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")).join(label, "node", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
