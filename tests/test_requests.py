import pytest
from pyspark.sql import functions as F

from codelattice.functions import locations, marked_message
from codelattice.operators import requests, store
from codelattice.sources.lift import Lift


def test_tickets_and_tokens():
    assert requests.bounded(["a"], 1) == ["a"]
    with pytest.raises(requests.TooManyTickets):
        requests.bounded(["a", "b"], 1)
    with pytest.raises(ValueError, match="no tickets"):
        requests.bounded([], 1)
    assert requests.position(requests.token(17)) == 17 and requests.position("") == 0 and requests.position(None) == 0
    for bad in ("x", "eyJhdCI6IC0xfQ==", "e30="):
        with pytest.raises(ValueError, match="invalid page token"):
            requests.position(bad)


def test_location_texts(spark):
    rows = ["b7-b9", "3", "3:4", "1-2:5", "b7", "x", "1-2-3", "b1-", "", None]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(locations.span("t").alias("s")).collect()]
    plain = [None if s is None else (tuple(s.start), tuple(s.end)) for s in got]
    assert plain == [((7, 0, 0), (9, 0, 0)), ((0, 3, 0), (0, 4, 0)), ((0, 3, 4), (0, 4, 0)), ((0, 1, 0), (0, 2, 5)), *[None] * 6]


def test_utf16_and_charsets(spark):
    t = spark.createDataFrame([("a€😀b",)], "t string")
    r = t.select(*(locations.utf16_of_byte("t", F.lit(n)).alias(f"u{n}") for n in (0, 1, 4, 8, 99)), locations.byte_of_utf16("t", F.lit(4)).alias("back")).first()
    assert tuple(r) == (0, 1, 2, 4, 5, 8)
    raw = spark.createDataFrame([(bytearray("äß".encode("cp1252")), bytearray("日本".encode("shift_jis")))], "a binary, b binary")
    assert tuple(raw.select(locations.decoded("a", "windows-1252"), locations.decoded("b", "Shift_JIS")).first()) == ("äß", "日本")
    with pytest.raises(LookupError):
        locations.decoded("a", "no-such-charset")


def test_messages(spark):
    tree = {"kind": "CONTEXT", "pre_text": "é(", "post_text": ")", "child": [{"kind": "MODIFIER", "pre_text": "x", "post_child_text": ", "}, {"kind": "LOOKUP_BY_PARAM", "lookup_index": 300, "add_final_list_token": True}]}
    assert marked_message.parse(marked_message.serialise(tree)) == tree
    broken = spark.createDataFrame([(bytearray(b"\x12\x7fabc"),), (None,), (bytearray(b""),)], "m binary")
    assert [r[0] for r in broken.select(marked_message.trees("m")).collect()] == [None, None, "{}"]


def test_entry_keys_refuse_separators(spark):
    e = Lift(spark, "/root/testdata/sf0.001").places()
    bad = e.withColumn("edge_kind", F.when(F.col("edge_kind") != "", F.concat("edge_kind", F.lit("\n"))).otherwise(""))
    n = bad.select(store.entry_key().alias("key")).agg(F.count_if(F.col("key").isNull()).alias("n")).first().n
    assert n == e.where("edge_kind <> ''").count() > 0
    assert spark.range(1).select(store.parsed_key(F.lit("other:x"))).first()[0] is None


@pytest.mark.parametrize("value", ["", "a", "a\x00", "a\x00\x00b", "b"])
def test_ordered_keys(spark, value):
    others = ["", "a", "a\x00", "a\x00\x00b", "a\x00b", "aa", "b", "é"]
    rows = [(value, n, o, m) for o in others for n in (-3, 0, 2**62) for m in (-1, 5)]
    df = spark.createDataFrame(rows, "a string, b long, c string, d long")
    got = df.select("a", "b", "c", "d", store.ordered_key(F.col("a"), F.col("b"), F.col("c"), F.col("d"), kinds=["string", "long", "string", "long"]).alias("k"))
    own = [tuple(r)[:4] for r in got.orderBy("k").collect()]
    assert own == sorted(rows, key=lambda r: (r[0].encode(), r[1], r[2].encode(), r[3]))


def test_files_without_text(spark):
    from codelattice.operators.graph import Graph
    from codelattice.sources.lift import facts, file

    n = spark.range(3)
    rows = facts(n, file(F.col("id").cast("string")), {"/graph/node/kind": F.lit("file"), "/graph/text": F.when(F.col("id") > 0, "x")})
    assert requests.present_files(Graph(rows)).count() == 2 and requests.present_files(Graph(rows), missing=True).count() == 3


def test_references_over_lines_and_beyond_the_text(spark):
    """An anchor over several lines, one at a line's end, one at the end of a text without a newline, an empty one, and one beyond the text."""
    from codelattice.model import vname
    from codelattice.operators import refs
    from codelattice.operators.graph import Graph
    from codelattice.sources.lift import edges, facts, file

    text = "äb\ncd\nef"
    spots = [(1, 1, 6), (2, 3, 3), (3, 7, 9), (4, 0, 2), (5, 8, 10)]
    a = spark.createDataFrame(spots, "n int, s int, e int")
    own = vname(F.col("n").cast("string"), "", "", "f", "x")
    one = spark.range(1)
    rows = facts(one, file("f"), {"/graph/node/kind": F.lit("file"), "/graph/text": F.lit(text)})
    rows = rows.unionByName(facts(a, own, {"/graph/node/kind": F.lit("anchor"), "/graph/loc/start": F.col("s"), "/graph/loc/end": F.col("e")}))
    rows = rows.unionByName(edges(a, own, "/graph/edge/ref", vname("t", "c")))
    rows = rows.withColumn("source", F.col("source").withField("corpus", F.lit("tpch")))
    got = {r.start: (r.anchor_text, r.line, r.column, r.snippet) for r in refs.references(Graph(rows)).collect()}
    raw = text.encode()
    want = {s: raw[s:e].decode("utf-8", "replace") for _, s, e in spots if e <= len(raw)}
    assert {s: g[0] for s, g in got.items()} == want
    assert got[0][1:] == (1, 0, "äb") and got[3][1:] == (1, 3, "äb") and got[7][1:] == (3, 0, "ef")


def test_pages_of_sets_take_one_shuffle_and_one_sort(spark):
    from codelattice.operators import requests

    rows = [(s, k, o % 3, f"d{o:02d}") for s in ("a", "b") for k, n in (("k1", 5), ("k2", 2), ("k3", 4)) for o in range(n)]
    df = requests.paged_sets(spark.createDataFrame(rows, "src string, kind string, ordinal int, dst string"), 2)
    want, page = {}, 0
    for s in ("a", "b"):
        page = 0
        for k in ("k1", "k2", "k3"):
            mine = sorted(r for r in rows if r[:2] == (s, k))
            for i, r in enumerate(mine):
                want[r] = f"{s}.{page + i // 2:010d}"
            page += -(-len(mine) // 2)
    got = {(r.src, r.kind, r.ordinal, r.dst): r.page_key for r in df.collect()}
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("Initial Plan")]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Join" not in plan
