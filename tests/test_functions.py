import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelattice.functions import diff, edgekinds, html, render, spans, text
from codelattice.functions.uri import basename, clean_path, dirname, parse_ticket, ticket
from codelattice.model import vname


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ticket_parts(spark):
    assert one(spark, ticket(vname("s/i g#", "corp us", "r/t", "a/../b/c.h", "c++"))) == "graph://corp%20us?lang=c%2B%2B?path=b/c.h?root=r/t#s%2Fi%20g%23"
    assert one(spark, ticket(vname())) == "graph:"
    assert one(spark, ticket(F.lit(None).cast("struct<signature:string,corpus:string,root:string,path:string,language:string>"))) is None


@pytest.mark.parametrize("bad", ["other://c", "graph://c?color=red", "graph://c?lang=", "graph://c#%zz", "graph://c?path=%4"])
def test_bad_tickets(spark, bad):
    assert one(spark, parse_ticket(F.lit(bad))) is None


def test_tickets_come_back(spark):
    names = [("", "", "", "", ""), ("sig#/?%", "c/d", "", "p", "java"), ("é 漢字", "x", "r", "a b/ü", "c++"), ("*~-._", "", "", "", "")]
    df = spark.createDataFrame(names, "signature string, corpus string, root string, path string, language string")
    back = df.select("*", parse_ticket(ticket(F.struct(*df.columns))).alias("v"))
    assert [tuple(r.v) for r in back.collect()] == names


@pytest.mark.parametrize(("path", "want"), [("a//b/./c/..", "a/b"), ("../x", "../x"), ("/..", "/"), ("a/..", "."), ("", ""), ("a/../../b", "../b"), ("/a/../../b", "/b")])
def test_clean_path(spark, path, want):
    assert one(spark, clean_path(F.lit(path))) == want


def test_dir_and_base(spark):
    assert [one(spark, f(F.lit(p))) for p in ("a/b/c", "c") for f in (dirname, basename)] == ["a/b", "c", "", "c"]


def test_edge_kinds(spark):
    k = F.lit("%/e/param.12")
    assert one(spark, F.struct(edgekinds.mirror(k).alias("a"), edgekinds.ordinal(k).alias("b"), edgekinds.base_kind(k).alias("c"), edgekinds.is_reverse(k).alias("d"))) == ("/e/param.12", 12, "%/e/param", True)
    assert one(spark, edgekinds.is_variant(F.lit("/e/ref/call"), "/e/ref")) and not one(spark, edgekinds.is_variant(F.lit("/e/refs"), "/e/ref"))


TEXT = "añb\n\nxyz"


@pytest.mark.parametrize("offset", range(-1, 12))
def test_points(spark, offset):
    raw = TEXT.encode()
    at = min(max(offset, 0), len(raw))
    p = one(spark, spans.point(F.lit(TEXT), F.lit(offset)))
    assert tuple(p) == (at, raw[:at].count(b"\n") + 1, at - (raw[:at].rfind(b"\n") + 1))
    assert one(spark, spans.offset_of(F.lit(TEXT), F.lit(p.line_number), F.lit(p.column_offset))) == at


def test_snippets(spark):
    assert [one(spark, spans.line_text(F.lit(TEXT), F.lit(o))) for o in (0, 5, 7)] == ["añb", "", "xyz"]
    assert one(spark, spans.slice_text(F.lit(TEXT), F.lit(1), F.lit(3))) == "ñ"


@given(st.text("ab\n", max_size=30), st.text("ab\n", max_size=30))
def test_kept_stretches_are_equal(old, new):
    for k in diff.kept(old, new):
        n = k["old_end"] - k["old_start"]
        assert old.encode()[k["old_start"] : k["old_end"]] == new.encode()[k["new_start"] : k["new_start"] + n]


def test_spans_move(spark):
    texts = spark.createDataFrame([("f", "one\ntwo\nthree\n", "zero\none\nthree\n")], "file string, old string, new string")
    moved = spans.patched(spark.createDataFrame([("f", 0, 3), ("f", 4, 7), ("f", 8, 13)], "file string, start int, end int"), diff.edits(texts, "file", "old", "new"), "file")
    assert sorted((r.start, r.end) for r in moved.collect()) == [(5, 8), (9, 14)]


def test_byte_sizes(spark):
    assert [one(spark, text.byte_size(F.lit(s))) for s in ("64K", "1.5MiB", "7", "x")] == [65536, 1572864, 7, None]
    assert [one(spark, text.format_size(F.lit(n))) for n in (0, 1024, 1536, 1 << 20)] == ["0B", "1K", "1536B", "1M"]


def test_trigrams(spark):
    assert one(spark, text.trigrams(F.lit("abcabc"))) == ["abc", "bca", "cab"]
    assert text.required_trigrams("^kabx?abcd.*(foo)+z") == ["kab", "abc", "bcd"]
    assert text.required_trigrams("a|b") == []


def test_path_patterns(spark):
    m = text.match_path(F.lit("/a/b c/d/e"), "/a/:x/:rest*")
    assert one(spark, m) == {"x": "b c", "rest": "d/e"}
    assert one(spark, text.generate_path("/a/:x", {"x": F.lit("q")})) == "/a/q"


def test_markdown_links(spark):
    places = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("t").alias("target")))
    assert one(spark, text.markdown_links(F.lit("ab"), places, lambda t: F.concat(F.lit("/"), t))) == "[a](/t)b"


TREE = {"child": [{"kind": "CONTEXT", "post_child_text": "::", "child": [{"kind": "IDENTIFIER", "pre_text": "ns"}, {"kind": "IDENTIFIER", "pre_text": "C"}]}, {"kind": "IDENTIFIER", "pre_text": "f"}, {"kind": "PARAMETER", "pre_text": "(", "post_child_text": ", ", "post_text": ")", "child": [{"child": [{"kind": "TYPE", "pre_text": "int "}, {"kind": "IDENTIFIER", "pre_text": "x"}]}, {"kind": "IDENTIFIER", "pre_text": "y"}]}]}


def test_marked_source(spark):
    t = F.lit(json.dumps(TREE))
    assert one(spark, render.rendered(t, "qualified_name")) == "ns::C::f"
    assert one(spark, render.rendered(t, "base_name")) == "f"
    assert one(spark, render.rendered(t, "parameters")) == "x,y"
    assert one(spark, render.rendered(t, "call_site_signature")) == "f(int x, y)"
    assert [(n.node_id, n.parent_id, n.kind) for n in one(spark, render.flat(t))][:3] == [(0, None, "BOX"), (1, 0, "CONTEXT"), (2, 1, "IDENTIFIER")]
    assert one(spark, render.rendered(t)) == "ns::Cf(int x, y)"
    assert one(spark, render.rendered(F.lit(None).cast("string"))) is None


def test_html(spark):
    assert one(spark, html.plain_text(F.lit("<p>a &amp; <b>b</b></p>"))) == "a & b"
    assert html.decorated("<p>ab<b>cd</b></p>", [(1, 3, "x")]) == '<p>a<span class="x">b</span><b><span class="x">c</span>d</b></p>'


def test_lookups_are_filled_in():
    from codelattice.functions import marked_message, render

    own = {"kind": "IDENTIFIER", "pre_text": "f", "exclude_on_include": ["LOOKUP_BY_PARAM"]}
    assert marked_message.parse(marked_message.serialise(own)) == own
    known = {"param": {0: {"kind": "IDENTIFIER", "pre_text": "a"}, 2: {"child": [own, {"pre_text": "b"}]}}, "typed": {0: None}}
    show = lambda node: render.render(render.filled(node, known) or {})
    assert show({"kind": "PARAMETER_LOOKUP_BY_PARAM", "pre_text": "(", "post_child_text": ",", "post_text": ")"}) == "(a,fb)"
    assert show({"kind": "PARAMETER_LOOKUP_BY_PARAM", "lookup_index": 3, "pre_text": "("}) == "("
    assert show({"kind": "PARAMETER_LOOKUP_BY_PARAM", "lookup_index": 4}) == "???"
    assert show({"kind": "LOOKUP_BY_PARAM", "lookup_index": 2}) == "b"
    assert show({"kind": "LOOKUP_BY_PARAM", "lookup_index": 3}) == show({"kind": "LOOKUP_BY_TPARAM"}) == "???"
    assert show({"kind": "LOOKUP_BY_PARAM", "lookup_index": 1, "pre_text": "kept"}) == "kept"
    assert show({"kind": "LOOKUP_BY_TYPED"}) == ""


def test_the_span_of_an_empty_text_moves_behind_what_is_added(spark):
    from codelattice.functions import diff, spans

    t = spark.createDataFrame([(1, ""), (2, "a\n")], "doc_id int, old string").withColumn("new", F.concat(F.lit("ADDED\n"), F.col("old")))
    lines = spans.line_index(t, "doc_id", "old").select("doc_id", F.col("line_start").alias("start"), (F.col("line_start") + F.col("line_bytes")).alias("end"))
    got = {tuple(r) for r in spans.patched(lines, diff.edits(t, "doc_id", "old", "new"), "doc_id").select("doc_id", "start", "end").collect()}
    assert got == {(1, 6, 6), (2, 6, 7), (2, 8, 8)}
