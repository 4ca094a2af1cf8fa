import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codelattice.llm import byte_bpe, packing
from codelattice.llm.token_counts import token_counts

from .helpers import ODD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [t for _, t in ODD if t] + ["<|endoftext|>", "a<|endoftext|> b<|endoftext", "it's  \t don't\r\n\n x", "١٢٣ ½ ² ª ǅ", "՘ \U0001f600 \U000323af", "é́ \x85\xa0　x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_code_point_is_cut_as_by_the_library(library):
    bad = []
    for cp in range(0, 0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        s = f"a{c}1{c}!{c}  {c}{c}x"
        if byte_bpe.cut(s) != [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)]:
            bad.append(cp)
    assert not bad


def test_counts_and_ids_are_the_librarys(library):
    known = set(byte_bpe.proven(library))
    want = [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert byte_bpe.encoder(PATH, known).counts(TEXTS) == [len(i) for i in want]
    assert [byte_bpe.encoder(PATH).packed(t) for t in TEXTS] == [np.array(i, "<u4").tobytes() for i in want]


def test_proven_strings_are_one_token(library):
    some = byte_bpe.proven(library)
    assert len(some) > 40_000 and all(len(e.ids) == 1 for e in library.encode_batch(some, add_special_tokens=False))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(p.encode(t))
    else:
        t_ = Tokenizer.from_file(path)
        t_.no_truncation()
        count = lambda t: len(t_.encode(t, add_special_tokens=False).ids)
    got = token_counts(docs(spark, ODD), path, 3).collect()
    key = lambda r: (r[0] is None, r)
    want = sorted(((d, len((t or "").encode()), count(t or ""), count(t or "") > 3) for d, t in ODD), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert token_counts(docs(spark, []), path).count() == 0


def check(rows, texts, library, capacity=1024):
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for part in by.values():
        part.sort(key=lambda r: r.offset)
        assert [r.offset for r in part] == [sum(x.length for x in part[:k]) for k in range(len(part))]
        assert sum(r.length for r in part) <= capacity
    crc = {}
    for (d, _), i in zip(texts, ids, strict=True):
        n = len(i)
        at = [0] if n <= capacity else [*([0] if n % capacity else []), *range(n % capacity, n, capacity)]
        for k, (s, e) in enumerate(zip(at, [*at[1:], n], strict=True)):
            crc.setdefault((d, k, s, e - s, zlib.crc32(i[s:e].tobytes())), 0)
            crc[d, k, s, e - s, zlib.crc32(i[s:e].tobytes())] += 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == crc
    return len(by)


def test_packing(spark, library):
    texts = ODD + [(100 + i, "the quick brown fox " * (7 * i % 300)) for i in range(120)]
    rows = packing.pack(docs(spark, texts), PATH).collect()
    n = check(rows, texts, library)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 2
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_local_search_empties_sequences():
    plan = packing.Plan(10)
    plan.classes.update({((6, 1),): 2, ((4, 1), (3, 1)): 2, ((1, 3),): 2})
    plan.improve()
    assert sum(plan.classes.values()) == 4
    assert sum(plan.fill(p) * n for p, n in plan.classes.items()) == 32


def test_plans_hold_every_piece():
    rng = np.random.default_rng(0)
    for _ in range(20):
        h = {int(x): int(rng.integers(1, 2000)) for x in rng.choice(np.arange(1, 1025), 60, replace=False)}
        plan = packing.Plan(1024)
        plan.best_fit(h)
        before = sum(plan.classes.values())
        plan.improve()
        held = {}
        for p, n in plan.classes.items():
            assert plan.fill(p) <= 1024
            for x, k in p:
                held[x] = held.get(x, 0) + k * n
        assert held == h and sum(plan.classes.values()) <= before


def test_local_search_ends_where_no_exchange_helps():
    rng = np.random.default_rng(1)
    for _ in range(30):
        plan = packing.Plan(20)
        plan.best_fit({int(x): int(rng.integers(1, 6)) for x in rng.choice(np.arange(1, 21), 8, replace=False)})
        plan.improve()
        held = [list(x for x, k in p for _ in range(k)) for p, n in plan.classes.items() for _ in range(n)]
        if len(held) == -(-sum(map(sum, held)) // 20):
            continue  # no fewer sequences can hold the tokens
        for i, a in enumerate(held):
            for j, b in enumerate(held):
                for give in [g for k in (1, 2) for g in combinations(a, k)]:
                    for take in [g for k in range(4 - len(give) if len(give) == 1 else 2) for g in combinations(b, k)]:
                        if i == j or len(take) > 2:
                            continue
                        x, y = sum(a) - sum(give) + sum(take), sum(b) + sum(give) - sum(take)
                        assert max(x, y) > 20 or x * x + y * y <= sum(a) ** 2 + sum(b) ** 2
