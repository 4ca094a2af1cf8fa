import random
import tracemalloc

import numpy as np
import pytest

from codelattice.llm import kneser_ney, line_crf

from .helpers import ODD, docs

RNG = random.Random(5)
PLAIN = ["".join(RNG.choice(["ba", "ke", "lo", "mi", "tu"]) for _ in range(RNG.choice([1, 2, 3]))) for _ in range(400)]
BAD = ["zorkish", "grumpel", "vlixoid"]


def text(toxic):
    w = [RNG.choice(PLAIN) for _ in range(RNG.choice([30, 80, 200]))]
    for _ in range(4 if toxic else 0):
        w[RNG.randrange(len(w))] = RNG.choice(BAD) + RNG.choice(["", "s"])
    return " ".join(w)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxic_texts_are_found_on_held_out_rows(spark):
    rows = [(i, text(i % 4 == 0)) for i in range(600)]
    out = kneser_ney.toxicity(docs(spark, rows), labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(600)])).collect()
    assert len(out) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97


def brute_kneser_ney(counts, word):
    """Log-likelihoods of a word in both classes, by dictionaries of strings and the formula alone."""
    marked = {w: f"\x02{w}\x03" for w in counts}
    letters = {x for m in marked.values() for x in m}

    def ends(k):  # (place, gram, gram of the next order or of one of its own where it is too short) of all words
        for w, m in marked.items():
            for i in range(len(m)):
                gram = m[: i + 1] if k == 0 else m[i - k + 1 : i + 1] if i >= k - 1 else None
                above = kneser_ney.LEVELS[kneser_ney.LEVELS.index(k) + 1] if k else None
                longer = None if above is None else m[: i + 1] if above == 0 else m[i - above + 1 : i + 1] if i >= above - 1 else ("short", gram)
                if gram is not None:
                    yield w, gram, longer

    def table(k, seen):
        n = {}
        for w, gram, longer in ends(k):
            if seen(w):
                n.setdefault(gram, {} if k else 0)
                if k:
                    n[gram][longer] = 1
                else:
                    n[gram] += seen(w)
        return {g: len(x) if k else x for g, x in n.items()}

    out = []
    for c in (0, 1):
        m = f"\x02{word}\x03"
        p = [1 / len(letters)] * len(m)
        for k in kneser_ney.LEVELS:
            n = table(k, (lambda w: counts[w][c]) if k == 0 else sum_of(counts))
            d = kneser_ney.discount(np.array(list(n.values())))
            for i in range(len(m)):
                if k > 1 and i < k - 1:
                    continue
                gram = m[: i + 1] if k == 0 else m[i - k + 1 : i + 1]
                if k != 1 and i == 0:
                    same = {g: x for g, x in n.items() if len(g) == 1}
                else:
                    same = {g: x for g, x in n.items() if g[:-1] == gram[:-1] and len(g) == len(gram)}
                if same:
                    p[i] = (max(n.get(gram, 0) - d, 0) + sum(min(x, d) for x in same.values()) * p[i]) / sum(same.values())
        out.append(np.log(p[1:]).sum())
    return out


def sum_of(counts):
    return lambda w: sum(counts[w])


def test_likelihoods_match_the_formula():
    counts = {w: (RNG.randrange(0, 5) + 1, RNG.randrange(0, 3)) for w in PLAIN[:60] + BAD}
    m = kneser_ney.Models(list(counts), np.array(list(counts.values())))
    for w in [*BAD, *PLAIN[:8], "zorkba", "unseen", "q", "bakelomitubakelomitu" * 3]:
        logs, place, _ = m.log_likelihoods([w])
        assert np.allclose(logs[:, place > 0].sum(1), brute_kneser_ney(counts, w))


def test_model_is_a_distribution():
    """After a beginning the likelihoods of all characters add up to one, in both classes."""
    counts = {w: (RNG.randrange(0, 5) + 1, RNG.randrange(0, 3)) for w in PLAIN + BAD}
    m = kneser_ney.Models(list(counts), np.array(list(counts.values())))
    letters = sorted({x for w in counts for x in w})
    for start in ["", "b", "ba", "zork", "zorkisht", "kelo"]:
        logs, place, _ = m.log_likelihoods([start + x for x in letters] + [start])
        at = [np.flatnonzero(place == 0)[i] + len(start) + 1 for i in range(len(letters) + 1)]
        # The begin mark alone is missing: it has a share of the lowest order.
        assert np.all(np.exp(logs[:, at]).sum(1) <= 1 + 1e-9) and np.all(np.exp(logs[:, at]).sum(1) > 0.9)
    assert np.isfinite(m.log_ratio([*BAD, "unseen", "q", "é"])).all()
    same = kneser_ney.Models(sorted(set(PLAIN)), np.full((len(set(PLAIN)), 2), 3))
    assert np.abs(same.log_ratio(PLAIN[:50] + ["unseen"])).max() < 1e-9


def test_long_words_are_whole():
    """Words longer than what is scored or remembered at once are neither cut nor lost."""
    m = kneser_ney.Models(["aab", "b" * 70], np.array([[1, 2], [3, 1]]))
    s = kneser_ney.Scorer(m)
    texts = ["aab " + "b" * 70, "漢" * 600_000, "b" * 70]
    got = s.evidence(texts)
    assert np.isfinite(got).all() and set(s.memo) == {"aab"}
    assert got[2, 0] == pytest.approx(m.log_ratio(["b" * 70])[0] / 72)


def test_repeated_ids_learn_from_one_text(spark):
    rows = [(i // 2, text(i % 3 == 0)) for i in range(80)]
    label = labels(spark, [(i, 1, i % 2) for i in range(40)])
    first, second = (sorted(kneser_ney.training_rows(docs(spark, r), label, "toxic", 100).collect()) for r in (rows, rows[::-1]))
    assert first == second and len({r.doc_id for r in first}) == len(first)


def test_models_learn_from_every_labelled_text(spark, monkeypatch):
    """Each text has a word of its own; the models get those of all texts that are neither held out nor kept for the curve, and the curve the rest."""
    n = 5200
    name = lambda i: "own" + "".join(chr(97 + int(x)) for x in str(i))
    rows = [(i, f"{name(i)} {PLAIN[i % 400]} {BAD[i % 3] if i % 2 else ''}") for i in range(n)]
    learned, curve = {}, []
    monkeypatch.setattr(kneser_ney.Models, "__init__", lambda self, ws, number, make=kneser_ney.Models.__init__: (learned.update(zip(ws.to_pylist(), number.tolist(), strict=True)), make(self, ws, number))[1])
    monkeypatch.setattr(kneser_ney, "fit_curve", lambda rows, make=kneser_ney.fit_curve: (curve.append(rows.count()), make(rows))[1])
    monkeypatch.setattr(kneser_ney, "MODEL_WORDS", 1000)
    monkeypatch.setattr(kneser_ney, "COUNT_WORDS", 500)
    kneser_ney.scoring(docs(spark, rows), labels(spark, [(i, 1, i % 2) for i in range(n)]))
    train = spark.range(n).selectExpr("id", "pmod(crc32(cast(id as string)), 5) as fifth", "pmod(xxhash64(id, 5), 5) as part").where("fifth <> 0").collect()
    assert min(sum(r.id % 2 == c for r in train) for c in (0, 1)) > 2000
    own = {name(r.id): r.id % 2 for r in train if r.part < kneser_ney.MODEL_SHARE}
    assert {w: x for w, x in learned.items() if w.startswith("own")} == {w: [1 - c, c] for w, c in own.items()}
    assert curve == [len(train) - len(own)]


def test_curve_matches_newton_in_one_place(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=300) > 1).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y int").repartition(5)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(300)], np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(4), z.T @ (p - y) + 1e-2 * w)
    assert np.allclose(kneser_ney.fit_curve(rows), np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()])


def page(good):
    lines = []
    for _ in range(RNG.choice([3, 10, 25])):
        w = [RNG.choice(PLAIN) for _ in range(12)]
        kind = 0 if good or RNG.random() < 0.2 else RNG.choice([1, 2, 3])
        lines.append([" ".join(w).capitalize() + ".", " | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(w[:1] * 12)][kind])
    return "\n".join(lines)


def test_quality_on_held_out_rows(spark):
    rows = [(i, page(i % 5 != 0)) for i in range(500)]
    out = line_crf.quality(docs(spark, rows), labels(spark, [(i, int(i % 5 != 0), 0) for i in range(500)])).collect()
    held = [r for r in out if r.held_out]
    assert all(r.predicted == (r.score >= 0.3) for r in out)
    assert np.mean([r.predicted == (r.doc_id % 5 != 0) for r in held]) > 0.95


def test_field_is_learned_from_every_labelled_text(spark, monkeypatch):
    """The mean of the fields of all blocks, which hold each labelled text that isn't held out once."""
    monkeypatch.setattr(line_crf, "BLOCK_DOCS", 60)
    rows = [(i, page(i % 3 != 0)) for i in range(260)]
    label = labels(spark, [(i, int(i % 3 != 0), 0) for i in range(0, 260)])
    got = line_crf.train(docs(spark, rows), label)
    train = spark.range(260).selectExpr("id", "pmod(crc32(cast(id as string)), 5) as fifth", "xxhash64(id, 9) as h").where("fifth <> 0").collect()
    blocks = {}
    for r in sorted(train):
        blocks.setdefault(r.h % (len(train) // 60), []).append(r.id)
    assert len(blocks) == 3 and sum(map(len, blocks.values())) == len(train)
    fits = [line_crf.fit([rows[i][1].encode() for i in ids], np.array([int(i % 3 != 0) for i in ids])) for ids in blocks.values()]
    weights = [len(ids) for ids in blocks.values()]
    for i, found in enumerate((got.weights, got.pair)):
        assert np.allclose(found, np.average([f[i] for f in fits], axis=0, weights=weights))


def test_lines_are_described_in_bounded_memory():
    """Ten times the texts take little more than their features."""
    rng, most = random.Random(8), []
    some = ["\n".join(" ".join(rng.choices(PLAIN, k=60)) for _ in range(5)).encode() for _ in range(200)]
    for times in (1, 10):
        texts = some * times
        tracemalloc.start()
        x, length, lines = line_crf.line_features(texts)
        most.append(tracemalloc.get_traced_memory()[1] - 2 * x.nbytes)
        tracemalloc.stop()
    assert most[1] < 2 * most[0]


@pytest.mark.parametrize("size", [1, 70, 500])
def test_parts_of_texts_give_the_lines_of_the_whole(size, monkeypatch):
    texts = [b"", b"\n", b"one line", b"a a a\n\nB | c", "\u00e9 \u00df\n".encode(), b"", b"x " * 300, b"last\nof all"]
    want = line_crf.line_features(texts)
    monkeypatch.setattr(line_crf, "CHUNK_BYTES", size)
    assert all((a == b).all() and a.shape == b.shape for a, b in zip(line_crf.line_features(texts), want, strict=True))


@pytest.mark.parametrize("lines", [1, 2, 5])
def test_marginals_match_enumeration(lines):
    rng = np.random.default_rng(lines)
    emit, pair = rng.normal(size=lines), rng.normal(size=(2, 2))
    weight, good, seen = 0.0, np.zeros(lines), np.zeros((2, 2))
    for code in range(2**lines):
        y = [(code >> i) & 1 for i in range(lines)]
        p = np.exp(sum(emit[i] * y[i] for i in range(lines)) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False)))
        weight += p
        good += p * np.array(y)
        for a, b in zip(y, y[1:], strict=False):
            seen[a, b] += p
    got, expected = line_crf.marginals(np.r_[emit, emit[:1]], pair, np.array([lines, 1]), edges=True)
    assert np.allclose(got[:lines], good / weight) and np.allclose(expected, seen / weight)


@pytest.mark.parametrize("rows", [[], [(4, 1, 0)], [(4, 0, 1), (5, 1, 0), (6, None, None), (4, 1, 0)]])
def test_odd_rows(spark, rows):
    for f in (kneser_ney.toxicity, line_crf.quality):
        out = f(docs(spark, ODD), labels(spark, rows)).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
        assert f(docs(spark, []), labels(spark, rows)).count() == 0
