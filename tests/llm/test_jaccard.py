import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codelattice.llm import jaccard_join as j
from codelattice.llm.components import components

from .helpers import ODD, docs


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts, percent=75):
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            at[x].add(i)
    for i, s in enumerate(sets):
        for k in {k for x in s for k in at[x] if k < i}:
            both = len(s & sets[k])
            if 100 * both >= percent * (len(s) + len(sets[k]) - both):
                parent[root(i)] = root(k)
    smallest = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        smallest[root(i)].append(d)
    return sorted((d, len(sets[i]), min(x for x in smallest[root(i)])) for i, (d, _) in enumerate(texts))


def edited(rng, words, rate):
    return [rng.choice(["zz", w + "x", w]) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize(("seed", "percent"), [(0, 75), (1, 75), (2, 90)])
def test_components_match_brute_force(spark, seed, percent, monkeypatch):
    """Families of near copies of all sizes, a passage in many texts, and large groups (so that stars and blocks are used)."""
    monkeypatch.setattr(j, "SMALL_GROUP", 3)
    monkeypatch.setattr(j, "CELL_MEMBERS", 8)
    monkeypatch.setattr(j, "TURN_PAIRS", 1)
    monkeypatch.setattr(j, "HUB_MEMBERS", 4)
    monkeypatch.setattr(j, "RANGE_BYTES", 4_000)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for size in (1, 3, 4, 5, 6, 12, 40, 90, 200, 700):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(14):
            w = edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.06]))
            texts.append(" ".join(w))
    for _ in range(40):
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 80]))] + passage))
    texts += texts[:20]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = j.jaccard_components(docs(spark, rows), percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, percent)


def test_ranges_keep_whole_groups():
    """Every pair of nodes with a common key comes out, as a pair or through a group, with its key's whole group."""
    rng = np.random.default_rng(5)
    blobs, at = [], defaultdict(set)
    for r in range(2):
        for doc in range(60):  # keys of 2 to 8 nodes, of many nodes, and of one node
            keys = np.unique(np.r_[rng.choice(40, 3) * 90_000_001, [7, 8][doc % 2], 2**32 - 1 if doc % 3 else 5, rng.integers(0, 2**32, 20)].astype(np.uint32))
            blobs.append((r, doc * 100, keys.tobytes() + np.zeros(len(keys), np.uint16).tobytes()))
            for k in keys:
                at[r, int(k)].add(doc * 100)
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blobs, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["rng", "node0", "blob"])
    rows = [x for b in j._pair(iter([batch])) for x in b.to_pylist()]
    groups, hubs = defaultdict(set), {}
    for x in rows:
        if x["gid"] is not None:
            groups[x["gid"]].update(x["members"])
            hubs[x["gid"]] = (x["l"], x["size"])
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in at.values() if len(g) > j.SMALL_GROUP}
    assert all(hubs[g] == (min(m), len(m)) for g, m in groups.items())
    assert {(x["l"], x["r"]) for x in rows if x["gid"] is None} == {(a, b) for g in at.values() if len(g) <= j.SMALL_GROUP for a in g for b in g if a < b}


def test_a_star_that_holds_nothing_together(spark, monkeypatch):
    """A hub that is like no member, members in chains: only the cells find the links, over several turns and cells."""
    monkeypatch.setattr(j, "SMALL_GROUP", 2)
    monkeypatch.setattr(j, "CELL_MEMBERS", 16)
    monkeypatch.setattr(j, "TURN_PAIRS", 1)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base[:60] + [f"h{i}" for i in range(60)]))]
    for chain in range(6):
        w = base[:]
        for step in range(25):
            x = rng.randrange(60, 115)
            w = w[:x] + [f"c{chain}s{step}"] + w[x + 1 :]
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    assert sorted(map(tuple, j.jaccard_components(docs(spark, rows)).collect())) == brute(rows)


def test_later_turns_count_only_members_that_are_apart_by_now():
    """The nearest members have joined the stray's component since turn 0; the farther ones still are compared, or it is told that there are more."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [base] + [np.r_[base[k // 4 :], rng.integers(0, 2**63, k // 4, dtype=np.uint64)] for k in range(40)]
    n = len(sets)
    cell = pa.table({"gid": pa.array([9] * n), "id": pa.array(range(n)), "component": pa.array(range(n)), "now": pa.array([0 if i <= 20 else i for i in range(n)]), "stray": pa.array([1] + [0] * (n - 1), pa.int32()), "own": pa.array([True] + [False] * (n - 1)), "n": pa.array([100] * n, pa.int32()), "sketch": pa.array([j.sketch(x) for x in sets], pa.binary())})
    for turn in (1, 2):
        rows = j._within(75, turn)(cell).to_pylist()
        found = {x["m"] for x in rows if x["m"] is not None}
        assert found <= set(range(21, n)) and len(found) == min(n - 21, j.TURN_PAIRS * 8**turn)
        assert [(x["c"], x["gid"], x["component"]) for x in rows if x["m"] is None] == ([(0, 9, 0)] if turn == 1 else [])


def test_odd_rows(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(docs(spark, ODD)).collect()]
    assert sorted(x for x in got if x[0]) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5), (6, 2, 6), (7, 1, 7), (8, 1, 8)]
    assert [x for x in got if x[0] is None] == [(None, 2, None)]


def test_empty_table(spark):
    assert j.jaccard_components(docs(spark, [])).count() == 0


def test_sketches_bound_differences():
    rng = np.random.default_rng(0)
    for _ in range(200):
        common = rng.integers(0, 2**63, rng.integers(0, 500), dtype=np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64)]) for _ in range(2))
        assert j.hamming(j.sketch(a), j.sketch(b)) <= len(np.setxor1d(a, b))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 1200))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        d = int(rng.integers(0, max(1, len(a) // 4) + 1))
        b = np.unique(np.r_[a[: len(a) - d // 2], rng.integers(0, 2**63, d - d // 2, dtype=np.uint64)]) if rng.random() < 0.7 else a[: max(1, len(a) - d)]
        both = len(np.intersect1d(a, b))
        frequent = np.sort(rng.choice(a, len(a) // 3, replace=False)) if rng.random() < 0.5 else a[:0]
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(np.intersect1d(j.signatures(a, frequent, 75), j.signatures(b, frequent, 75)))


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 101), (101, 102), (102, 100), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 10 for i in range(10, 61)} | {i: 100 for i in (100, 101, 102)}
