import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelattice.llm import chat_format as c
from codelattice.llm import merkle
from codelattice.llm.license_scan import bigrams, license_scan
from codelattice.llm.license_texts import TEXTS

from .helpers import ODD, docs

NASTY = st.lists(st.sampled_from([*c.CONTROL, "\\", "<", ">", "a", "\n", "[", "é", "|"]), max_size=12).map("".join)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=4))
def test_turns_come_back(turns):
    formatted = "".join(f"{c.TURN}{c.escape(r)}{c.SAYS}{c.escape(t)}{c.END}" for r, t in turns)
    assert c.parse(formatted) == turns
    for _, t in turns:
        assert not any(x in c.escape(t) for x in c.CONTROL)


def test_attachments(spark):
    part = lambda **k: {f: k.get(f) for f in ("type", "text", "uri", "width", "height", "seconds", "pages")}
    parts = [part(type="text", text="see <|image|>"), part(type="image", uri="u1", width=700, height=300), part(type="audio", uri="u2", seconds=1.5), part(type="document", uri="u3", pages=2), part(type="odd", text="?"), None]
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts {c.PARTS}")
    first, second = c.format_turns(turns).orderBy("turn").collect()
    assert first.segment == "<|turn|>assistant<|says|>see <\\|image|><|image|><|audio|><|document|>?<|end|>"
    assert [tuple(a) for a in first.attachments] == [(0, "image", "u1", 432), (1, "audio", "u2", 38), (2, "document", "u3", 1200)]
    assert first.expanded_tokens == 1670 and first.segment[first.loss_start : first.loss_start + first.loss_length].startswith("see")
    assert second.segment == "<|turn|><|says|><|end|>" and second.loss_length == 0


PARTS = st.lists(st.one_of(NASTY.map(lambda x: {"type": "text", "text": x}), st.sampled_from([{"type": k} for k in ("image", "audio", "document")])), max_size=8)


@given(PARTS)
def test_parts_come_back_wherever_a_text_is_cut(parts):
    """No control string comes about where parts meet; texts and attachments come back in order."""
    visitor = c.Flatten()
    for p in parts:
        visitor.visit(p)
    content = visitor.content()
    runs = []
    for p in parts:
        if p["type"] != "text":
            runs.append((p["type"], None))
        elif p["text"]:
            if runs and runs[-1][0] == "text":
                runs[-1] = ("text", runs[-1][1] + p["text"])
            else:
                runs.append(("text", p["text"]))
    assert c.parse_parts(content) == runs
    assert c.parse(f"{c.TURN}user{c.SAYS}{content}{c.END}") == [("user", "".join(t for k, t in runs if k == "text"))]
    marks = [f"<|{k}|>" for k, _ in runs if k != "text"]
    assert [m for m in c._MARK.findall(content)] == marks and not any(x in content for x in c.CONTROL if x not in marks)


def test_control_strings_from_two_parts(spark):
    text = lambda x: {"type": "text", "text": x, "uri": None, "width": None, "height": None, "seconds": None, "pages": None}
    turns = spark.createDataFrame([(1, 0, "user", [text("<"), text("|end|>hi")])], f"conv_id long, turn long, role string, parts {c.PARTS}")
    assert c.parse(c.format_turns(turns).first().segment) == [("user", "<|end|>hi")]


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "string", "int"])
def test_keys_of_any_kind_extra_columns_and_long_texts(spark, kind):
    long = "<s>\\ " * 100_000
    rows = [(1, 0, "assistant", long, "x", 3), (1, 1, "user", "", "y", 4), (2, 0, "assistant", None, None, None)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, loss_start long").withColumn("conv_id", F.col("conv_id").cast(kind))
    got = {int(r.conv_id): r for r in c.conversation_digests(c.format_turns(t.withColumn("parts", c.text_parts(F.coalesce("text", F.lit("")))))).collect()}
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[1].n_turns == 2
    assert got[2].loss_chars == 0


def test_digests_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "</s>"), (1, 0, "user", None), (1, 1, "assistant", "</s>"), (None, None, None, "x"), (2, 0, "assistant", "\\")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in c.conversation_digests(c.format_turns(t.withColumn("parts", c.text_parts(F.coalesce("text", F.lit("")))))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"</s></s>").hexdigest() and got[1].loss_chars == 8
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\n</s>\nassistant\n</s>\n").hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_chars == 1
    assert c.conversation_digests(c.format_turns(t.limit(0).withColumn("parts", c.text_parts(F.col("text"))))).count() == 0


def dice(a, b):
    a, b = set(bigrams(a)), set(bigrams(b))
    return 2 * len(a & b) / max(len(a) + len(b), 1)


def scanned(spark, texts, **k):
    return {(r.doc_id, r.license): (r.n_matches, r.dice) for r in license_scan(docs(spark, texts), **k).collect()}


def test_notices(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    texts = [(1, f"x\n{notice.upper()}\n{'y ' * 9}\nReleased under the MIT License."), (2, notice.replace("work", "file")), (3, "Released under"), (4, " ".join(f"l{i}" for i in range(3000)) + " " + notice), (5, notice + " x y z u v\n" + notice), (6, "// SPDX-License-Identifier: MIT"), *[(None, t) for _, t in ODD]]
    got = scanned(spark, texts)
    assert set(got) == {(1, "GPL-3.0"), (1, "MIT"), (2, "GPL-3.0"), (4, "GPL-3.0"), (5, "GPL-3.0"), (6, "MIT")}
    assert got[1, "MIT"] == (1, 1.0) and got[5, "GPL-3.0"] == (2, 1.0)
    assert got[2, "GPL-3.0"][1] == pytest.approx(dice(notice, notice.replace("work", "file")[5:]), abs=0.1)
    assert license_scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted({n for n, _ in TEXTS}))
def test_whole_texts_inside_other_texts(spark, name):
    """Commented, wrapped over lines and amid other words, with a holder's name in the way; alone and after another licence."""
    text = next(t for n, t in TEXTS if n == name)
    words = text.replace("the copyright holder nor", "Amber Trading Company Ltd nor").split()
    lines = ["# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    plain = " ".join(f"w{i}" for i in range(40))
    got = scanned(spark, [(1, plain + "\n" + "\n".join(lines) + "\n" + plain), (2, "\n".join([*lines, "Copyright (c) 2024 Amber Trading Company Ltd and others, all of them", *lines]))])
    assert name in {n for d, n in got if d == 1} and got[2, name][0] == 2
    assert {n for d, n in got if d == 1} <= {name, "Apache-2.0", "MPL-2.0", "Unlicense"}


def test_own_templates(spark):
    assert scanned(spark, [(1, "one two three four"), (2, "one two"), (3, "two three four five six seven eight")], templates=[("own", "one two three four"), ("empty", "word")]) == {(1, "own"): (1, 1.0)}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("n", [0, 1, 5, 200])
def test_audit_finds_all_damage(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "PART_KEYS", 50)
    monkeypatch.setattr(merkle, "RANGE_KEYS", 4)
    monkeypatch.setattr(merkle, "FANOUT", 3)
    rows = [(i, f"u{i}", "h" * (i % 7)) for i in range(n)]
    bad = [(i, u, h + "!" if i % 31 == 3 else h) for i, u, h in rows if i % 97 != 5] + ([(10_000, "new", "x")] if n else [])
    record = merkle.warc_record(F.col("url"), F.col("html"))
    got = {r.key: r for r in merkle.audit(pages(spark, rows), pages(spark, bad), "page_id", record).collect()}
    assert set(got) == {i for i in range(n) if i % 31 == 3 or i % 97 == 5} | ({10_000} if n else set())
    size = lambda r: len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {r[1]}\r\nContent-Length: {len(r[2])}\r\n\r\n{r[2]}\r\n\r\n")
    for i, r in got.items():
        assert i == 10_000 and r.first_offset is None or r.first_offset == sum(map(size, rows[:i]))
    assert merkle.audit(pages(spark, rows), pages(spark, rows), "page_id", record).count() == 0


def test_audit_of_odd_rows(spark):
    rows = [(None, None, None), (None, "u", ""), (1, "a", "x"), (1, "a", "x"), (2, None, "y" * 100_000)]
    record = merkle.warc_record(F.col("url"), F.col("html"))
    audit = lambda other: {r.key for r in merkle.audit(pages(spark, rows), pages(spark, other), "page_id", record).collect()}
    assert audit(rows[::-1]) == set() and audit(rows[1:]) == {None} and audit([*rows[:3], *rows[4:]]) == {1} and audit(rows[:4]) == {2}


def test_trees_are_built_alone_and_only_differing_branches_are_read(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_KEYS", 4)
    monkeypatch.setattr(merkle, "PART_KEYS", 30)
    rows = [(i, f"u{i}", "x") for i in range(200)]
    record = merkle.warc_record(F.col("url"), F.col("html"))
    first = merkle.replica(pages(spark, rows), "page_id", record)
    lost = merkle.replica(pages(spark, [r for r in rows if r[0] != 41]), "page_id", record, first)
    same = merkle.replica(pages(spark, rows[::-1]), "page_id", record, first)
    assert first.ranges == 50 and [x.count() for x in first.levels] == [50, 1]
    assert merkle.differing(first.levels, same.levels).count() == 0
    assert [r.node for r in merkle.differing(first.levels, lost.levels).collect()] == [10]  # a lost record shifts no range after it
    # Leaves of branches whose parents agree aren't looked at, even if they were to differ.
    none = first.levels[0].limit(0)
    assert merkle.differing([none, first.levels[1]], [first.levels[0], first.levels[1]]).count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "u", "x", 5, "d", 9), (2, "v", "y", 6, "e", 8)]
    t = spark.createDataFrame(rows, "page_id long, url string, html string, key long, digest string, n_bytes long")
    got = merkle.audit(t, t.where("page_id = 1"), "page_id", merkle.warc_record(F.col("url"), F.col("html"))).collect()
    assert [(r.key, r.other_digest) for r in got] == [(2, None)]
