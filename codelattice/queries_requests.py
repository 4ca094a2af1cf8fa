"""Registered queries of requests: predicates, switches, filters and pages, keys of stores, places in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import locations, marked_message, render
from .functions.uri import ticket
from .model import vname
from .operators import content, requests, store, xrefs
from .queries import ALL_SQL, DEFINITIONS_SQL, DEFS, ORACLES, QUERIES, REFS_SQL, V, XREF, query
from .sources.lift import SQL as LIFT
from .sources.lift import facts

__all__ = ["ORACLES", "QUERIES"]

#: Kinds beside those of the lifted graph, for the predicates.
KINDS = [f"{V.prefix}/edge/{k}" for k in ("ref", "ref/call", "ref/call/thunk", "ref/implicit", "reference", "provides", "provides/x", "defines", "defines/x", "documents", "completes/uniquely", "childof", "typed")] + ["#internal/ref/call/direct", "#internal/ref/call/override", "#internal/ref/declare"]
KINDS += [f"%{k}" for k in KINDS]
_KINDS_SQL = ", ".join(f"('{k}')" for k in KINDS)


@query(LIFT + f""", k AS (SELECT DISTINCT kind FROM edges UNION SELECT * FROM (VALUES {_KINDS_SQL})), c AS (SELECT kind, ltrim(kind, '%') AS bare FROM k)
    SELECT kind, regexp_matches(bare, '^/graph/edge/ref(/|$)') AS all_refs, regexp_matches(bare, '^/graph/edge/ref/call(/|$)') AS call_refs,
    (regexp_matches(bare, '^/graph/edge/ref(/|$)') AND NOT regexp_matches(bare, '^/graph/edge/ref/call(/|$)')) OR bare = '/graph/edge/provides' AS non_call_refs,
    bare = '#internal/ref/call/direct' AS direct_callers, bare IN ('#internal/ref/call/direct', '#internal/ref/call/override') AS override_callers,
    kind LIKE '%/thunk' OR kind = '#internal/ref/call/override' AS speculative, NOT starts_with(kind, '#internal/') AND NOT regexp_matches(kind, '^%?/graph/edge/(defines|documents|ref|completes)(/|$)') AS related,
    regexp_matches(bare, '^/graph/edge/defines(/|$)') AS definition, bare = '/graph/edge/defines' AS full_definition, bare = '#internal/ref/declare' AS declaration FROM c""")
def reference_kind_predicates(x):
    kind = F.col("kind")
    kinds = x.entries.where("edge_kind <> ''").select(F.col("edge_kind").alias("kind")).union(x.entries.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")).distinct()
    columns = {"all_refs": xrefs.is_reference(kind), "call_refs": xrefs.is_reference(kind, "CALL"), "non_call_refs": xrefs.is_reference(kind, "NON_CALL"), "direct_callers": xrefs.is_caller(kind), "override_callers": xrefs.is_caller(kind, "OVERRIDE"), "speculative": xrefs.is_speculative(kind), "related": xrefs.is_related(kind), "definition": xrefs.is_definition(kind), "full_definition": xrefs.is_definition(kind, "FULL"), "declaration": xrefs.is_declaration(kind)}
    return kinds.select("kind", *(c.alias(n) for n, c in columns.items()))


@query(LIFT + DEFINITIONS_SQL + """, d AS (SELECT d.node, definition, f.value = 'definition' AS full_ FROM definitions d JOIN facts f ON f.ticket = d.node AND f.name = '/graph/complete')
    SELECT r.file, r."start" AS "start", string_agg(DISTINCT d.node, ',' ORDER BY d.node) AS nodes FROM d JOIN refs r ON r.anchor = d.definition AND r.target = d.node
    WHERE full_ AND regexp_matches(r.file, 'path=orders/[0-9]*[02468]$') AND NOT regexp_matches(r.file, 'path=orders/10') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1000""", XREF)
def link_resolve_filtered(x):
    nodes = x.wide().select(F.col("ticket").alias("node"))
    places = content.resolve(x, nodes, kinds=["record/class", "lookup"], include=[{"path": "^orders/.*[02468]$", "corpus": "tpch"}, {"path": "^none$"}], exclude=[{"path": "^orders/10"}])
    return places.withColumn("nodes", F.array_join("nodes", ","))


@query(LIFT + "SELECT ticket, name FROM facts WHERE name NOT IN ('/graph/text', '/graph/text/encoding')")
def facts_without_text(x):
    return requests.without_text(x.facts).select("ticket", "name")


@query(LIFT + DEFINITIONS_SQL + """SELECT file, "start", "end", r.kind, r.target, d.definition AS target_definition, scope FROM refs r LEFT JOIN definitions d ON d.node = r.target WHERE r.kind <> '/graph/edge/tagged'""", DEFS)
def decorations_reply(x):
    return requests.decorations_reply(x, targets=True, scope=True)


@query("SELECT 'graph://tpch?path=docs/' || lang || '/' || doc_id AS file FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'graph://tpch?path=suppliers/' || s_suppkey FROM supplier", ["docs", "suppliers"])
def files_present(x):
    return requests.present_files(x)


@query("SELECT p_type AS corpus, count(*) AS n_sources, p_type <> 'STANDARD' AS ok FROM part WHERE p_size % 3 <> 0 GROUP BY p_type UNION ALL SELECT '', count(*), false FROM nation", lift=False)
def corpora_checked(spark, d):
    p, n = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    of = lambda df, key, corpus, language: facts(df, vname(F.col(key).cast("string"), corpus, "", "", language), {"/graph/node/kind": F.lit("record"), "/x": F.lit("y")})
    entries = of(p, "p_partkey", F.col("p_type"), F.when(F.col("p_size") % 3 == 0, "usr").otherwise("tpch")).unionByName(of(n, "n_nationkey", "", "tpch"))
    allowed = [r[0] for r in p.select("p_type").distinct().collect() if r[0] != "STANDARD"]  # a request's list
    return store.corpora(entries, allowed)


@query(LIFT + ALL_SQL + """, o AS (SELECT regexp_replace(kind, '\\.\\d+$', '') AS kind FROM edges_all)
    SELECT CASE ltrim(kind, '%') WHEN '/graph/edge/childof' THEN CASE WHEN starts_with(kind, '%') THEN '%' ELSE '' END || '/other/within' WHEN '/graph/edge/typed' THEN CASE WHEN starts_with(kind, '%') THEN '%' ELSE '' END || '/other/is' ELSE kind END AS kind, count(*) AS n FROM o GROUP BY 1""")
def edges_relabelled(x):
    return requests.relabelled(x.edges_all(), {V.edge("childof"): "/other/within", V.edge("typed"): "/other/is"}).groupBy("kind").agg(F.count("*").alias("n"))


@query(LIFT + REFS_SQL + """SELECT file, "start", "end", kind, target, o_orderpriority AS revision FROM refs LEFT JOIN orders ON file = 'graph://tpch?path=orders/' || o_orderkey AND o_orderkey % 2 = 0""", DEFS)
def decorations_revisions(x):
    from .operators import refs

    spark, folder = x.entries.sparkSession, x.folder
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_orderkey % 2 = 0")
    info = orders.select(F.lit("tpch").alias("corpus"), F.lit("").alias("root"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderpriority").alias("revision"))
    return requests.with_revisions(refs.narrow_references(x).select("file", "start", "end", "kind", "target"), info)


PAGES_SQL = ALL_SQL + r""", o AS (SELECT src, regexp_replace(kind, '\.\d+$', '') AS kind, coalesce(try_cast(nullif(regexp_extract(kind, '\.(\d+)$', 1), '') AS INT), 0) AS ordinal, dst FROM edges_all),
    g AS (SELECT src, kind, count(*) AS n, ceil(count(*) / 20) AS pages FROM o GROUP BY 1, 2), f AS (SELECT *, sum(pages) OVER (PARTITION BY src ORDER BY kind) - pages AS first_page FROM g),
    p AS (SELECT o.*, src || '.' || lpad((first_page + (row_number() OVER (PARTITION BY src, kind ORDER BY ordinal, dst) - 1) // 20)::BIGINT::VARCHAR, 10, '0') AS page_key FROM o JOIN f USING (src, kind))"""
PAGED = ["anchor_edges", "suppliers", "places", "conversations"]


@query(LIFT + PAGES_SQL + "SELECT page_key, src, kind, count(*) AS n, min(dst) AS first_dst FROM p GROUP BY 1, 2, 3")
def edges_paged_sets(x):
    return requests.paged_sets(x.edges_all(), 20).groupBy("page_key", "src", "kind").agg(F.count("*").alias("n"), F.min("dst").alias("first_dst"))


@query(LIFT + PAGES_SQL + "SELECT page_key, kind, dst FROM p WHERE page_key IN ('graph://tpch?lang=tpch#supplier%2F3.0000000001', 'graph://tpch?lang=tpch#nation%2F3.0000000000')", PAGED)
def edges_of_pages(x):
    keys = x.entries.sparkSession.createDataFrame([("graph://tpch?lang=tpch#supplier%2F3.0000000001",), ("graph://tpch?lang=tpch#nation%2F3.0000000000",)], "page_key string")
    return requests.of_pages(requests.paged_sets(x.edges_all(), 20), keys).select("page_key", "kind", "dst")


@query("""WITH f AS (SELECT o_orderkey::VARCHAR AS name, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN o_orderstatus ELSE '' END AS build_configs FROM orders)
    SELECT 'tpch' AS corpus, '' AS root, 'orders' AS directory, name, 'FILE' AS kind, false AS generated, build_configs FROM f
    UNION ALL SELECT 'tpch', '', '', 'orders', 'DIRECTORY', false, (SELECT string_agg(DISTINCT build_configs, ',' ORDER BY build_configs) FROM f WHERE build_configs <> '')""", ["files", "anchors"])
def directory_entries(x):
    return content.directory_entries(x)


# --- keys of stores ---


@query("""SELECT hex('entry:nation/' || n_nationkey || chr(0) || 'tpch' || chr(0) || chr(0) || chr(0) || 'tpch' || chr(10) || '/graph/edge/childof' || chr(10) || '/' || chr(10) || 'region/' || n_regionkey || chr(0) || 'tpch' || chr(0) || chr(0) || chr(0) || 'tpch') AS key_hex,
    'graph://tpch?lang=tpch#nation%2F' || n_nationkey AS source, '/graph/edge/childof' AS edge_kind, 'graph://tpch?lang=tpch#region%2F' || n_regionkey AS target, true AS has_prefix FROM nation""", ["places"])
def entry_keys(x):
    e = x.entries.where(F.col("edge_kind") == V.edge("childof")).select("*", store.entry_key().alias("key"))
    back = e.select("key", store.parsed_key(F.col("key")).alias("e"), F.startswith("key", store.key_prefix(F.col("source"), V.edge("childof"))).alias("has_prefix"))
    return back.select(F.hex("key").alias("key_hex"), ticket("e.source").alias("source"), "e.edge_kind", ticket("e.target").alias("target"), "has_prefix")


@query(LIFT + "SELECT count(*) AS n FROM (SELECT ticket FROM facts WHERE ticket LIKE '%#nation%' UNION ALL SELECT src FROM edges WHERE src LIKE '%#nation%')", ["places"])
def entry_key_range(x):
    keyed = x.entries.select(store.entry_key().alias("key"))
    return store.keyed_range(keyed, low="entry:nation/", high="entry:nation0").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, 0::BIGINT AS out_of_order FROM part", lift=False)
def ordered_keys(spark, d):
    """Composite keys of two strings and two numbers sort as the columns do: neighbours by key never stand the other way round."""
    from pyspark.sql import Window

    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, F.lit("\x00")).otherwise(F.lit(""))).alias("a"), (F.col("p_size") - 25).cast("long").alias("b"), F.col("p_name").alias("c"), F.col("p_partkey").cast("long").alias("e"))
    keyed = p.select(F.struct("a", "b", "c", "e").alias("row"), store.ordered_key(F.col("a"), F.col("b"), F.col("c"), F.col("e"), kinds=["string", "long", "string", "long"]).alias("key"))
    w = Window.partitionBy(F.substring("key", 1, 6)).orderBy("key")
    return keyed.withColumn("before", F.lag("row").over(w)).agg(F.count("*").alias("n"), F.count_if(F.col("before") > F.col("row")).alias("out_of_order"))


@query(LIFT + "SELECT source, (count(*) - 1) // 3 + 1 AS n_batches, least(count(*), 3) AS largest FROM (SELECT ticket AS source FROM facts UNION ALL SELECT src FROM edges) GROUP BY source")
def entry_batches(x):
    b = store.batches(x.entries, 3).groupBy("source", "batch").agg(F.count("*").alias("n"))
    return b.groupBy(ticket("source").alias("source")).agg(F.count("*").alias("n_batches"), F.max("n").alias("largest"))


@query(LIFT + "SELECT (SELECT count(*) FROM facts) + (SELECT count(*) FROM edges) AS entries, (SELECT count(*) FROM (SELECT ticket FROM facts UNION SELECT src FROM edges)) AS sources, (SELECT count(DISTINCT name) FROM facts) + 1 AS fact_names, (SELECT count(DISTINCT kind) FROM edges) + 1 AS edge_kinds")
def entry_stats(x):
    return store.stats(x.entries)


# --- places in texts ---


@query(r"""WITH t AS (SELECT doc_id, text, left(text, length(text) // 2) AS head FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, strlen(head) AS byte_offset, (length(head) + length(regexp_replace(head, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::BIGINT AS utf16_offset, strlen(head) AS back FROM t""", lift=False)
def utf16_offsets(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", "text", F.octet_length(F.expr("left(text, cast(floor(length(text) / 2) as int))")).alias("byte_offset"))
    t = t.withColumn("utf16_offset", locations.utf16_of_byte("text", "byte_offset"))
    return t.select("doc_id", F.col("byte_offset").cast("long").alias("byte_offset"), F.col("utf16_offset").cast("long").alias("utf16_offset"), locations.byte_of_utf16("text", F.col("utf16_offset")).cast("long").alias("back"))


@query(r"""WITH t AS (SELECT doc_id, text, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, charset, CASE charset WHEN 'UTF-8' THEN strlen(text) WHEN 'UTF-32BE' THEN 4 * length(text) ELSE 2 * units END::BIGINT AS n_bytes, true AS same FROM t, (VALUES ('UTF-8'), ('UTF-16BE'), ('UTF-16LE'), ('UTF-32BE')) c(charset)""", lift=False)
def text_charsets(spark, d):
    """Texts written in several charsets and read back; the last by Python's codecs."""
    t = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", "text")
    wide = lambda c: F.encode(F.col("text"), c)
    of = lambda charset, raw: t.select("doc_id", F.lit(charset).alias("charset"), F.octet_length(raw).cast("long").alias("n_bytes"), (locations.decoded(raw, charset) == F.col("text")).alias("same"))
    # UTF-32 carries a byte order mark when it is written without one being named, so the last bytes are taken.
    utf32 = F.expr("encode(text, 'UTF-32')")
    return reduce(DataFrame.unionByName, [of("UTF-8", wide("UTF-8")), of("UTF-16BE", wide("UTF-16BE")), of("UTF-16LE", wide("UTF-16LE")), of("UTF-32BE", utf32)])


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size ELSE 0 END AS start_byte, CASE p_partkey % 4 WHEN 0 THEN 0 ELSE p_size END AS start_line, CASE p_partkey % 4 WHEN 1 THEN 7 ELSE 0 END AS start_column,
    CASE p_partkey % 4 WHEN 0 THEN p_size + 9 ELSE 0 END AS end_byte, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size + 1 WHEN 2 THEN p_size + 3 ELSE p_size + 1 END AS end_line FROM part""", lift=False)
def location_texts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size").cast("string")
    plus = lambda n: (F.col("p_size") + n).cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("b"), size, F.lit("-b"), plus(9))).when(k == 1, F.concat(size, F.lit(":7"))).when(k == 2, F.concat(size, F.lit("-"), plus(3), F.lit(":5"))).otherwise(size)
    s = p.select("p_partkey", locations.span(text).alias("s"))
    return s.select("p_partkey", F.col("s.start.byte_offset").alias("start_byte"), F.col("s.start.line_number").alias("start_line"), F.col("s.start.column_offset").alias("start_column"), F.col("s.end.byte_offset").alias("end_byte"), F.col("s.end.line_number").alias("end_line"))


@query("SELECT p_partkey, p_type || '(' || p_name || ')' AS signature, p_brand AS base_name FROM part", lift=False)
def marked_source_stored(spark, d):
    """Signatures from stored messages."""
    p = spark.read.parquet(f"{d}/part.parquet")
    leaf = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("pre_text"))
    whole = F.concat(F.lit('{"child":['), F.to_json(leaf("TYPE", "p_type")), F.lit(',{"kind":"PARAMETER","pre_text":"(","post_text":")","child":['), F.to_json(leaf("BOX", "p_name")), F.lit("]}]}"))
    name = F.concat(F.lit('{"child":['), F.to_json(leaf("IDENTIFIER", "p_brand")), F.lit("]}"))
    stored = p.select("p_partkey", marked_message.messages(whole).alias("code"), marked_message.messages(name).alias("own"))
    t = stored.select("p_partkey", marked_message.trees("code").alias("tree"), marked_message.trees("own").alias("name"))
    return t.select("p_partkey", render.rendered("tree", "signature").alias("signature"), render.rendered("name", "base_name").alias("base_name"))
