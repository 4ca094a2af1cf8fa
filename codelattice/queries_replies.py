"""Registered queries of composed replies: signatures, identifiers' links, an editor's requests, entry sets, shards, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import digests, marked_message
from .functions.uri import ticket
from .model import VNAME, vname
from .operators import content, editor, entryset, refs, signatures, xrefs
from .operators.graph import Graph
from .queries import CALLS_SQL, CATEGORY_SQL, DEFINITIONS_SQL, DEFS, ORACLES, QUERIES, V, XREF, query
from .sources.lift import SQL as LIFT
from .sources.lift import Lift, edges, facts, named, node

__all__ = ["ORACLES", "QUERIES"]


def _leaf(kind: str, column: str):
    return F.struct(F.lit(kind).alias("kind"), F.col(column).alias("pre_text"))


def signed(spark, d, *parts) -> Graph:
    """The lift with marked source: suppliers take nations, nations have the type of their region; messages and JSON facts alike."""
    x = Lift(spark, d)
    p, s, n, r = (x.table(t) for t in ("part", "supplier", "nation", "region"))
    code = lambda df, own, tree: facts(df, own, {V.fact("code/json"): tree})
    of_nation = F.concat(F.lit('{"child":[{"kind":"LOOKUP_BY_TYPED"},{"pre_text":" "},'), F.to_json(_leaf("IDENTIFIER", "n_name")), F.lit("]}"))
    stored = n.select(node(named("nation", n.n_nationkey)).alias("source"), F.lit("").alias("edge_kind"), F.lit(None).cast(VNAME).alias("target"), F.lit(V.fact("code")).alias("fact_name"), marked_message.messages(of_nation).alias("fact_value"))
    of_supplier = F.concat(F.lit('{"child":['), F.to_json(_leaf("IDENTIFIER", "s_name")), F.lit(',{"kind":"PARAMETER_LOOKUP_BY_PARAM","pre_text":"(","post_child_text":", ","post_text":")"},{"pre_text":" "},{"kind":"LOOKUP_BY_PARAM","lookup_index":7}]}'))
    codes = [
        code(p, node(named("part", p.p_partkey)), F.to_json(_leaf("IDENTIFIER", "p_name"))),
        code(s, node(named("supplier", s.s_suppkey)), of_supplier),
        code(r, node(named("region", r.r_regionkey)), F.to_json(_leaf("IDENTIFIER", "r_name"))),
        stored,
        edges(s, node(named("supplier", s.s_suppkey)), V.edge("param.0"), node(named("nation", s.s_nationkey))),
        edges(s, node(named("supplier", s.s_suppkey)), V.edge("param.1"), node(named("region", s.s_nationkey % 5))),
        edges(n, node(named("nation", n.n_nationkey)), V.edge("typed"), node(named("region", n.n_regionkey))),
    ]
    return Graph(reduce(DataFrame.unionByName, ([x.entries(*parts)] if parts else []) + codes), folder=d)


SIGNED_SQL = """, signed AS (SELECT 'graph://tpch?lang=tpch#part%2F' || p_partkey AS node, p_name AS signature FROM part
    UNION ALL SELECT 'graph://tpch?lang=tpch#region%2F' || r_regionkey, r_name FROM region
    UNION ALL SELECT 'graph://tpch?lang=tpch#nation%2F' || n_nationkey, r_name || ' ' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'graph://tpch?lang=tpch#supplier%2F' || s_suppkey, s_name || '(' || r.r_name || ' ' || n_name || ', ' || o.r_name || ') ???' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region r ON r.r_regionkey = n_regionkey JOIN region o ON o.r_regionkey = s_nationkey % 5)"""


@query(LIFT + SIGNED_SQL + "SELECT node, signature FROM signed", lift=False)
def marked_source_resolved(spark, d):
    of = signatures.resolved(signed(spark, d))
    return signatures.with_signature(of.select("node"), of, "node")


@query(LIFT + CATEGORY_SQL + SIGNED_SQL + ", t AS (SELECT target, count(*) AS n FROM categorised WHERE category IS NOT NULL GROUP BY 1) SELECT target, n, signature FROM t LEFT JOIN signed ON node = target", lift=False)
def xref_targets_signed(spark, d):
    x = signed(spark, d, *XREF)
    return signatures.cross_reference_targets(x, signatures.resolved(x))


@query(LIFT + CALLS_SQL + SIGNED_SQL + "SELECT callee, caller, definition, n_sites, signature FROM calls JOIN definitions ON definitions.node = caller LEFT JOIN signed ON signed.node = caller", lift=False)
def callers_signed(spark, d):
    x = signed(spark, d, *DEFS)
    return signatures.signed_callers(x, signatures.resolved(x))


@query(LIFT + SIGNED_SQL + """, d AS (SELECT dst AS node, min(src) AS doc FROM edges WHERE kind = '/graph/edge/documents' GROUP BY 1)
    SELECT d.node, d.doc, f.value AS text, 0::BIGINT AS n_children, signature FROM d JOIN facts f ON f.ticket = d.doc AND f.name = '/graph/text' LEFT JOIN signed ON signed.node = d.node""", lift=False)
def documents_signed(spark, d):
    x = signed(spark, d, "docs")
    return signatures.with_signature(content.documents(x), signatures.resolved(x), "node")


@query(LIFT + DEFINITIONS_SQL + """, i AS (SELECT 'graph://tpch?lang=tpch#part%2F' || p_partkey AS node, p_size > 25 AS full_ FROM part WHERE p_brand = 'Brand#1'), d AS (SELECT i.node, definition, full_ FROM i JOIN definitions d ON d.node = i.node)
    SELECT r.file, r."start" AS "start", string_agg(DISTINCT d.node, ',' ORDER BY d.node) AS nodes FROM d JOIN refs r ON r.anchor = d.definition AND r.target = d.node
    WHERE full_ OR NOT (SELECT bool_or(full_) FROM d) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1000""", XREF)
def link_of_identifier(x):
    p = x.entries.sparkSession.read.parquet(f"{x.folder}/part.parquet")
    own = F.concat(F.lit("graph://tpch?lang=tpch#part%2F"), F.col("p_partkey").cast("string"))
    names = p.select(F.col("p_brand").alias("qualified_name"), F.col("p_brand").alias("base_name"), own.alias("ticket"), own.alias("canonical_ticket"), F.lit("tpch").alias("corpus"), F.lit("tpch").alias("language"), F.lit("record/class").alias("kind"))
    return content.resolve_identifier(x, names, "Brand#1", corpora=["tpch"], kinds=["record"]).withColumn("nodes", F.array_join("nodes", ","))


# --- an editor's requests: a point of a file ---

POINT = ("graph://tpch?path=orders/7", 2, 2)
POINT_SQL = DEFINITIONS_SQL + """, here AS (SELECT DISTINCT target FROM refs WHERE kind <> '/graph/edge/tagged' AND file = 'graph://tpch?path=orders/7' AND "start" <= 12 AND "end" >= 12)"""


@query(LIFT + POINT_SQL + """SELECT target, w.file, w."start" AS "start", w."end" AS "end" FROM here JOIN definitions ON node = target JOIN (SELECT DISTINCT anchor, file, "start", "end" FROM refs) w ON w.anchor = definition""", XREF)
def editor_definition(x):
    return editor.definition(x, *POINT)


@query(LIFT + POINT_SQL + """SELECT target, kind, file, "start", "end" FROM refs SEMI JOIN here USING (target)""", XREF)
def editor_references(x):
    return editor.references(x, *POINT)


@query(LIFT + POINT_SQL + SIGNED_SQL + """, d AS (SELECT dst AS target, min(src) AS doc FROM edges WHERE kind = '/graph/edge/documents' GROUP BY 1)
    SELECT target, signature, f.value AS text FROM here LEFT JOIN signed ON node = target LEFT JOIN d USING (target) LEFT JOIN facts f ON f.ticket = d.doc AND f.name = '/graph/text'""", lift=False)
def editor_hover(spark, d):
    x = signed(spark, d, *XREF, "docs")
    return editor.hover(x, *POINT, signatures.resolved(x))


# --- totals that filters leave ---

EVEN = [{"corpus": "^tpch$", "path": "^(orders|suppliers)/.*[02468]$"}]
_EVEN_SQL = "regexp_matches({}, 'path=(orders|suppliers)/[0-9]*[02468](#|$)')"


@query(LIFT + CALLS_SQL + f"""SELECT callee AS target, count(*) FILTER ({_EVEN_SQL.format("definition")}) AS total, count(*) FILTER (NOT {_EVEN_SQL.format("definition")}) AS filtered FROM calls JOIN definitions ON node = caller GROUP BY 1""", DEFS)
def xref_caller_totals(x):
    return xrefs.caller_totals(refs.callers(x), EVEN)


RELATED_SQL = LIFT + DEFINITIONS_SQL + f""", own AS (SELECT * FROM edges WHERE NOT starts_with(src, 'graph://tpch?lang=tpch#conv') AND NOT starts_with(src, 'graph://tpch?lang=tpch#doc') AND kind <> '/graph/edge/tagged'), edges_all AS (SELECT src, kind, dst FROM own UNION ALL SELECT dst, '%' || kind, src FROM own),
    r AS (SELECT DISTINCT src AS node, kind, dst AS related, coalesce(definition, dst) AS place FROM edges_all LEFT JOIN definitions d ON d.node = dst WHERE NOT regexp_matches(kind, '^%?/graph/edge/(defines|documents|ref|completes)(/|$)'))
    SELECT node, kind, count(*) FILTER ({_EVEN_SQL.format("place")}) AS total, count(*) FILTER (NOT {_EVEN_SQL.format("place")}) AS filtered FROM r GROUP BY 1, 2"""


@query(RELATED_SQL, DEFS + ["places"])
def xref_related_totals(x):
    return xrefs.related_totals(x, EVEN)


@query(LIFT + CATEGORY_SQL + f"""SELECT target, scope, count(*) FILTER ({_EVEN_SQL.format("file")}) AS total, count(*) FILTER (NOT {_EVEN_SQL.format("file")}) AS filtered FROM categorised WHERE category = 'reference' GROUP BY 1, 2""", XREF)
def xref_scope_totals(x):
    return xrefs.scope_totals(xrefs.categorised(x), EVEN)


@query(LIFT + """, up AS (SELECT s_suppkey, 'class:' || p_brand AS parent FROM supplier JOIN part ON p_partkey = s_suppkey WHERE p_brand <> ''), n AS (SELECT ticket, value FROM facts WHERE name = '/graph/node/kind'), a AS (SELECT src, count(*) AS n FROM edges WHERE kind LIKE '/graph/edge/param.%' GROUP BY 1)
    SELECT n.ticket AS node, CASE n.value WHEN 'function' THEN 'f' WHEN 'package' THEN 'p' WHEN 'record' THEN 'c' WHEN 'variable' THEN 'v' END AS letter, CASE WHEN n.value = 'function' THEN 'arity:' || coalesce(a.n, 0) ELSE '' END AS arity, coalesce(parent, '') AS parents
    FROM n LEFT JOIN a ON a.src = n.ticket LEFT JOIN up ON n.ticket = 'graph://tpch?lang=tpch#supplier%2F' || s_suppkey""", lift=False)
def tag_fields(spark, d):
    """As a tag file writes them; suppliers stand as members of the part with their number."""
    x = Lift(spark, d)
    s, p = x.table("supplier"), x.table("part")
    within = edges(s.join(p, s.s_suppkey == p.p_partkey, "left_semi"), node(named("supplier", s.s_suppkey)), V.edge("childof"), node(named("part", s.s_suppkey)))
    fields = signatures.tag_fields(Graph(x.entries().unionByName(within), folder=d), "/tpch/brand")
    return fields.withColumn("arity", F.coalesce(F.concat(F.lit("arity:"), F.col("arity").cast("string")), F.lit("")))


# --- entry sets, shards, digests ---


@query(LIFT + """, e AS (SELECT '' AS edge_kind, ticket AS source, '' AS target, name AS fact_name, value FROM facts UNION ALL SELECT kind, src, dst, '/', '' FROM edges)
    SELECT DISTINCT * FROM e WHERE regexp_matches(source, '#(nation|region|customer|supplier|part|conv)%2F') OR regexp_matches(source, 'path=suppliers/')""", ["places", "suppliers", "parts_", "conversations"])
def entry_set_roundtrip(x):
    """Every entry given twice; encoded and decoded it is one set."""
    back = entryset.decoded(*entryset.encoded(x.entries.unionByName(x.entries)))
    return back.select("edge_kind", ticket("source").alias("source"), F.coalesce(ticket("target"), F.lit("")).alias("target"), "fact_name", F.col("fact_value").cast("string").alias("value"))


@query("""WITH t AS (SELECT p_name AS text FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part) SELECT text, row_number() OVER (ORDER BY encode(text)) - 1 AS id FROM t WHERE text IS NOT NULL""", lift=False)
def symbols_numbered(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    texts = p.select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("text")).where("text is not null").distinct()
    return entryset.numbered(texts, "text")


@query("SELECT (SELECT count(*) FROM lineitem) AS n, true AS even, 0::BIGINT AS overlapping", lift=False)
def key_shards(spark, d):
    """Orders by weight of their lines in 8 ranges: none holds over twice its share, and ranges follow one another."""
    key = F.concat(F.lit("o/"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    keyed = spark.read.parquet(f"{d}/lineitem.parquet").select(key.alias("key"), F.lit(1).alias("weight"))
    shards = keyed.withColumn("shard", entryset.shard_of(F.col("key"), entryset.shard_bounds(keyed, 8)))
    per = shards.groupBy("shard").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    crossed = per.alias("a").join(per.alias("b"), (F.col("a.shard") < F.col("b.shard")) & (F.col("a.high") >= F.col("b.low"))).agg(F.count("*").alias("overlapping"))  # 8 rows
    return per.agg(F.sum("n").alias("n"), (F.max("n") <= 2 * F.sum("n") / 8).alias("even")).join(crossed)


@query("""WITH i AS (SELECT l_orderkey, string_agg('RI' || chr(10) || chr(0) || 'tpch' || chr(0) || chr(0) || 'p/' || l_partkey || chr(0) || chr(0) || 'IN' || chr(10) || 'p/' || l_partkey || chr(0) || lpad(l_partkey::VARCHAR, 9, '0') || chr(0), '' ORDER BY l_partkey) AS inputs, string_agg('p/' || l_partkey || chr(0), '' ORDER BY 'p/' || l_partkey) AS sources FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1)
    SELECT o_orderkey, sha256('CU' || chr(10) || o_orderkey || chr(0) || 'tpch' || chr(0) || chr(0) || chr(0) || 'tpch' || chr(0) || coalesce(inputs, '') || 'ARG' || chr(10) || '-c' || chr(0) || o_orderstatus || chr(0) || 'OUT' || chr(10) || 'o' || chr(0) || 'SRC' || chr(10) || coalesce(sources, '') || 'CWD' || chr(10) || chr(0) || 'CTX' || chr(10) || chr(0)
    || 'ENV' || chr(10) || 'A' || chr(0) || '1' || chr(0) || 'ENV' || chr(10) || 'B' || chr(0) || o_orderpriority || chr(0) || 'DET' || chr(10) || 't' || chr(0) || 'v' || chr(0)) AS digest FROM orders LEFT JOIN i ON l_orderkey = o_orderkey""", lift=False)
def unit_digests(spark, d):
    """Orders as units, their parts as inputs (repeated and in any order)."""
    o, l = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")  # noqa: E741
    at = F.concat(F.lit("p/"), F.col("l_partkey").cast("string"))
    one = F.struct(F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("digest"), at.alias("path"), vname("", "tpch", "", at, "").alias("v_name"))
    inputs = l.groupBy("l_orderkey").agg(F.collect_list(one).alias("inputs"), F.collect_set(at).alias("sources"))
    u = o.join(inputs, o.o_orderkey == inputs.l_orderkey, "left")
    env = F.array(F.struct(F.lit("B").alias("name"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("A").alias("name"), F.lit("1").alias("value")))
    unit = F.struct(vname(F.col("o_orderkey"), "tpch", "", "", "tpch").alias("v_name"), F.col("inputs").alias("required_input"), F.array(F.lit("-c"), F.col("o_orderstatus")).alias("argument"), F.lit("o").alias("output_key"), F.col("sources").alias("source_file"), F.lit(None).cast("string").alias("working_directory"), F.lit("").alias("entry_context"), env.alias("environment"), F.array(F.struct(F.lit("t").alias("type_url"), F.lit("v").alias("value"))).alias("details"))
    return u.select("o_orderkey", digests.unit_digest(unit).alias("digest"))
