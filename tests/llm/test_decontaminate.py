import random

from codelattice.llm.decontaminate import contaminated

from .helpers import ODD, docs

RNG = random.Random(3)
WORDS = [f"t{i}" for i in range(300)]
QUESTION = "A train leaves with Amara and carries 120 kg of coal for 35 km before Amara stops to unload 60 kg near the old quiet station house"


def sentence(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(spark, texts, benchmark):
    return {(r.doc_id, r.item_id, r.exact) for r in contaminated(docs(spark, texts), items(spark, benchmark)).collect()}


def test_matches_brute_force(spark):
    benchmark = [(i, " ".join(sentence(n))) for i, n in enumerate([5, 12, 13, 14, 30, 60, 200])]
    texts = []
    for i in range(150):
        w = sentence(RNG.choice([3, 30, 200]))
        if i % 3 == 0:
            _, t = RNG.choice(benchmark)
            t = t.split()
            n = RNG.choice([8, 12, 13, len(t)])
            s = RNG.randrange(max(1, len(t) - n + 1))
            at = RNG.randrange(len(w) + 1)
            w[at:at] = t[s : s + n]
        texts.append((i, " ".join(w)))
    want = set()
    for d, t in texts:
        for i, b in benchmark:
            b = b.split()
            n = min(13, len(b))
            if any(f" {' '.join(b[s : s + n])} " in f" {t} " for s in range(len(b) - n + 1)):
                want.add((d, i, True))
    assert found(spark, texts, benchmark) == want and len(want) > 20


def test_other_numbers_and_names_are_caught(spark):
    asked = QUESTION.replace("120 kg", "80 lb").replace("35", "17.5").replace("Amara", "Bo").replace("60 kg", "40 lb")
    mixed = asked.replace("before Bo", "before Cy")
    texts = [(1, f"so. {QUESTION.lower()} then"), (2, f"so. {asked} then"), (3, f"so. {mixed} then"), (4, f"so. {QUESTION.upper()}"), (5, "A train leaves with Amara and carries nothing at all")]
    got = found(spark, texts, [(9, QUESTION)])
    assert (2, 9, False) in got and not any(d == 5 for d, _, _ in got)
    # Two names where the item has one: what stands in the slots doesn't map one to one over the whole passage.
    assert not any(r.n_words > 20 for r in contaminated(docs(spark, texts[2:3]), items(spark, [(9, QUESTION)])).collect())


def test_passages_with_contradicting_slots_keep_their_parts(spark):
    words = sentence(200)
    words[40], words[150] = "Tom", "Tom"
    item = " ".join(words)
    altered = " ".join([*words[:150], "Tim", *words[151:]])
    first = " ".join([*words[:40], "Tim", *words[41:]])
    got = {r.doc_id: r for r in contaminated(docs(spark, [(1, altered), (2, first)]), items(spark, [(9, item)])).collect()}
    assert {d: (r.first_word, r.n_words, r.exact) for d, r in got.items()} == {1: (0, 150, True), 2: (41, 159, True)}
    # Different values of the item become one, in the second half of a long passage.
    words = sentence(60)
    words[5], words[45] = "3", "5"
    merged = [*words[:5], "4", *words[6:45], "4", *words[46:]]
    words[20] = words[30] = "Amara"
    merged[20] = merged[30] = "Bo"
    got = contaminated(docs(spark, [(1, " ".join(merged))]), items(spark, [(9, " ".join(words))])).collect()
    assert [(r.first_word, r.n_words, r.exact) for r in got] == [(0, 45, True)]
    # Cut at the contradiction alone, no part would be long enough; the stretch after the first slot is.
    words = sentence(24)
    words[2], words[12] = "Tom", "Tom"
    other = [*words[:2], "Tim", *words[3:12], "Max", *words[13:]]
    got = contaminated(docs(spark, [(1, " ".join(other))]), items(spark, [(9, " ".join(words))])).collect()
    assert [(r.first_word, r.n_words, r.exact) for r in got] == [(3, 21, False)]


def test_contradicting_slots_of_short_passages_stay_out(spark):
    words = sentence(20)
    words[7], words[12] = "Tom", "Tom"
    other = [*words[:7], "Bo", *words[8:12], "Cy", *words[13:]]
    assert found(spark, [(1, " ".join(other))], [(9, " ".join(words))]) == set()


def test_names_that_open_questions_and_spelled_numbers(spark):
    benchmark = [(1, "Alice buys 3 apples for 2 dollars today"), (2, "What is the capital city of that old country?")]
    texts = [(1, "Bob buys 5 apples for 4 dollars today"), (2, "bob said: Carol buys five apples for ten euros today."), (3, "Bob buys 5 pears for 4 dollars today"), (4, "Where is the capital city of that old country?"), (5, "WHAT IS THE CAPITAL CITY OF THAT OLD COUNTRY?"), (6, "Alice buys 3 apples for 2 dollars today")]
    assert found(spark, texts, benchmark) == {(1, 1, False), (2, 1, False), (5, 2, True), (6, 1, True)}


PLACES = {"<name>": ["Amara", "Bo", "Cyra", "Dov"], "<num>": ["3", "17", "two", "2.5", "ninety"], "<unit>": ["miles", "grams", "km/h"]}


def template(w):
    """The rule again, word by word, for words of these tests alone."""
    bare = w.strip(".,?")
    return next((k for k, v in PLACES.items() if bare in v), bare)


def brute(doc, item):
    """Is there a stretch of PASSAGE words, or of a whole shorter item, alike in template words, whose slots map one to one? And one of equal words?"""
    d, b = doc.split(), item.split()
    n, any_, same = min(13, len(b)), False, False
    for s in range(len(b) - n + 1):
        for p in range(len(d) - n + 1):
            x, y = [w.strip(".,?") for w in d[p : p + n]], [w.strip(".,?") for w in b[s : s + n]]
            if list(map(template, x)) == list(map(template, y)):
                pairs = {(v, w) for v, w in zip(x, y, strict=True) if template(v).startswith("<")}
                if len(pairs) == len({v for v, _ in pairs}) == len({w for _, w in pairs}):
                    any_, same = True, same or x == y
    return any_, same


def test_slots_match_brute_force(spark):
    rng = random.Random(11)

    def question(n):
        w = [rng.choice(WORDS) for _ in range(n)]
        for i in range(rng.randrange(4), n - 1, 5):
            kind = rng.choice(["<name>", "<num>", "unit"])
            w[i] = rng.choice(PLACES["<num>" if kind == "unit" else kind])
            if kind == "unit":
                w[i + 1] = rng.choice(PLACES["<unit>"])
        return w

    benchmark = [(i, question(n)) for i, n in enumerate([9, 12, 13, 16, 20, 30, 45] * 3)]
    texts = []
    for i in range(240):
        _, w = rng.choice(benchmark)
        values = {v: rng.choice(PLACES[template(v)]) for v in w if template(v).startswith("<")}
        w = [values.get(v, v) if rng.random() < 0.97 else rng.choice(PLACES[template(v)]) if v in values else v for v in w]
        texts.append((i, " ".join([*sentence(6), *(w[: rng.choice([7, 12, 14, len(w)])] if i % 3 else w), *sentence(6)])))
    benchmark = [(i, " ".join(w)) for i, w in benchmark]
    want = {(d, i) for d, t in texts for i, b in benchmark if brute(t, b)[0]}
    verbatim = {(d, i) for d, t in texts for i, b in benchmark if brute(t, b)[1]}
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs(spark, texts), items(spark, benchmark)).collect()}
    assert set(got) == want and 60 < len(want) < 240 and len(verbatim) < len(want)
    # The longest passage is told; it may be another than that with the verbatim words.
    assert all(got[x].exact or got[x].n_words > 13 for x in verbatim)


def test_keys_of_other_kinds_and_clashing_columns(spark):
    d = spark.createDataFrame([("a", "x y z", 1, True)], "doc_id string, text string, item_id int, exact boolean")
    b = spark.createDataFrame([("i", "x y z", 2.0)], "item_id string, text string, coverage double")
    assert [tuple(r) for r in contaminated(d, b).collect()] == [("a", "i", 0, 3, 1.0, True)]


def test_odd_rows(spark):
    assert found(spark, ODD, [(1, None), (2, ""), (None, "a b c d e f"), (3, "tail")]) == {(None, None, True), (6, None, True), (8, 3, True)}
    assert found(spark, [], [(1, "x y")]) == set() and found(spark, ODD, []) == set()


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    from codelattice.llm import decontaminate

    benchmark = [(i, " ".join(sentence(40))) for i in range(30)]
    texts = [(i, " ".join(sentence(10)) + " " + benchmark[i][1]) for i in range(30)]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    assert found(spark, texts, benchmark) == {(i, i, True) for i in range(30)}
