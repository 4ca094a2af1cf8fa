"""Registered queries: each operator over the lifted tables, with the same in SQL over the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import diff, edgekinds, html, render, spans, text
from .functions.uri import basename, clean_path, dirname, parse_ticket, ticket
from .model import VNAME, VOCABULARY, valid_entry, vname
from .operators import content, refs, store, units, xrefs
from .operators import graph as g
from .operators.graph import Graph
from .plans import patterns
from .sources import entries as entry_streams
from .sources.lift import SQL as LIFT
from .sources.lift import Lift, node
from .sources.lift import facts as lifted_facts

V = VOCABULARY
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS = ["files", "anchors", "anchor_edges"]
DEFS = [*ORDERS, "suppliers"]
REFS_SQL = """, refs AS (SELECT e.dst AS target, e.kind, e.src AS anchor, replace(split_part(e.src, '#', 1), '?lang=tpch', '') AS file, s.value::INT AS "start", f.value::INT AS "end",
    coalesce(b.value, '') AS build_config, (SELECT min(c.dst) FROM edges c WHERE c.src = e.src AND c.kind = '/graph/edge/childof') AS scope
    FROM edges e JOIN facts s ON s.ticket = e.src AND s.name = '/graph/loc/start' JOIN facts f ON f.ticket = e.src AND f.name = '/graph/loc/end'
    LEFT JOIN facts b ON b.ticket = e.src AND b.name = '/graph/build/config' WHERE e.kind <> '/graph/edge/childof')"""
DEFINITIONS_SQL = REFS_SQL + """, definitions AS (SELECT target AS node, min(anchor) AS definition FROM refs WHERE kind = '/graph/edge/defines' OR starts_with(kind, '/graph/edge/defines/') GROUP BY target)"""
ALL_SQL = ", edges_all AS (SELECT src, kind, dst FROM edges UNION ALL SELECT dst, '%' || kind, src FROM edges)"


def query(sql: str | None = None, parts: list[str] | None = None, lift: bool = True):
    """Registers a function of a Graph over some parts of the lift (or of the session and folder, without lift)."""

    def add(f):
        name = f.__name__
        QUERIES[name] = (lambda spark, d: f(Graph(Lift(spark, d).entries(*(parts or [])), folder=d))) if lift else f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- store ---


@query(LIFT + "SELECT '' AS edge_kind, count(*) AS n FROM facts UNION ALL SELECT kind, count(*) FROM edges GROUP BY kind")
def entries_count_by_kind(x):
    return store.counts_by_kind(x.entries)


def _rows(entries):
    return entries.select(ticket("source").alias("source"), "edge_kind", F.coalesce(ticket("target"), F.lit("")).alias("target"), F.when(F.col("edge_kind") == "", F.col("fact_name")).otherwise("").alias("fact_name"), F.col("fact_value").cast("string").alias("value"))


@query(LIFT + "SELECT ticket AS source, '' AS edge_kind, '' AS target, name AS fact_name, value FROM facts WHERE ticket = 'graph://tpch?lang=tpch#part%2F7'", ["parts_"])
def store_read_node_facts(x):
    return _rows(store.read(x.entries, node("part/7")))


@query(LIFT + "SELECT ticket AS source, '' AS edge_kind, '' AS target, name AS fact_name, value FROM facts WHERE ticket = 'graph://tpch?lang=tpch#supplier%2F3' UNION ALL SELECT src, kind, dst, '', '' FROM edges WHERE src = 'graph://tpch?lang=tpch#supplier%2F3'", ["suppliers"])
def store_read_all(x):
    return _rows(store.read(x.entries, node("supplier/3"), "*"))


@query(LIFT + "SELECT src AS source, kind AS edge_kind, dst AS target, '' AS fact_name, '' AS value FROM edges WHERE src = 'graph://tpch?lang=tpch#supplier%2F3' AND kind = '/graph/edge/childof'", ["suppliers"])
def store_read_kind(x):
    return _rows(store.read(x.entries, node("supplier/3"), V.edge("childof")))


@query(LIFT + "SELECT name AS fact_name, count(*) AS n, min(ticket) AS first_ticket FROM facts WHERE starts_with(name, '/graph/loc') GROUP BY name", ["anchors", "suppliers"])
def store_scan_fact_prefix(x):
    return store.scan(x.entries, fact_prefix="/graph/loc").groupBy("fact_name").agg(F.count("*").alias("n"), F.min(ticket("source")).alias("first_ticket"))


@query(LIFT + "SELECT src AS source, kind AS edge_kind FROM edges WHERE dst = 'graph://tpch?lang=tpch#nation%2F3'", ["suppliers", "places"])
def store_scan_target(x):
    return store.scan(x.entries, target=node("nation/3")).select(ticket("source").alias("source"), "edge_kind")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_linenumber <= 4 UNION SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_linenumber >= 3)", ["anchor_edges"])
def store_merge_dedup(x):
    e = x.entries.where(F.col("edge_kind") != V.edge("childof"))
    n = F.col("source.signature").cast("int")
    return store.merged(e.where(n <= 4), e.where(n >= 3)).agg(F.count("*").alias("n"))


@query(LIFT + "SELECT (SELECT count(*) FROM edges) + (SELECT count(*) FROM facts) AS n, 0::BIGINT AS split_groups")
def store_shard_counts(x):
    e = x.entries.select("source", "edge_kind", store.shard_of(16).alias("shard"))
    per = e.groupBy("source", "edge_kind").agg(F.count("*").alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b"))
    return per.agg(F.sum("n").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("split_groups"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey", lift=False)
def entries_unique_ignore_value(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    e = rows.select(F.struct(*keys).alias("source"), F.lit("").alias("edge_kind"), F.lit("/q").alias("fact_name"), F.lit("").alias("target"), F.col("l_quantity").alias("fact_value"))
    return store.first_of_key(e).select("source.*", F.col("fact_value").cast("double").alias("quantity"))


@query(LIFT + "SELECT (SELECT count(*) FROM facts) + (SELECT count(*) FROM edges) AS n, 0::BIGINT AS n_invalid")
def entries_valid(x):
    return x.entries.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(valid_entry(), F.lit(False))).alias("n_invalid"))


@query(LIFT + """SELECT '"' || ticket || '"' AS subject, '"' || name || '"' AS predicate, '"' || replace(replace(replace(replace(replace(value, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"' AS "object" FROM facts
    UNION ALL SELECT '"' || src || '"', '"' || kind || '"', '"' || dst || '"' FROM edges""")
def triples_export(x):
    return store.triples(x.entries)


# --- nodes ---


@query(LIFT + "SELECT coalesce(f.ticket, e.src) AS ticket, coalesce(n_facts, 0) AS n_facts, coalesce(n_edges, 0) AS n_edges FROM (SELECT ticket, count(*) AS n_facts FROM facts GROUP BY ticket) f FULL JOIN (SELECT src, count(*) AS n_edges FROM edges GROUP BY src) e ON f.ticket = e.src")
def nodes_assembled(x):
    return x.nodes()


@query("SELECT 'graph://tpch?lang=tpch#part%2F' || p_partkey AS ticket, '/tpch/brand' AS name, p_brand AS value FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT 'graph://tpch?lang=tpch#part%2F' || p_partkey, '/graph/complete', CASE WHEN p_size > 25 THEN 'definition' ELSE 'incomplete' END FROM part", ["parts_", "suppliers", "places"])
def nodes_filter_kind_facts(x):
    return x.filtered(kinds=["record"], subkinds=["class"], include_facts=["/tpch/brand", V.fact("complete")]).select("ticket", "name", F.col("value").cast("string").alias("value"))


@query(LIFT + "SELECT ticket, name, strlen(value) AS n_bytes FROM facts WHERE regexp_matches(name, '/graph/text') OR regexp_matches(name, '/tpch/[^/]*')")
def node_facts_glob(x):
    return g.node_facts(x, globs=["/graph/text", "/tpch/*"]).select("ticket", "name", F.octet_length("value").cast("long").alias("n_bytes"))


@query("SELECT 'graph://tpch?lang=tpch#part%2F' || l_partkey AS ticket, '/tpch/ship' AS name, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1", lift=False)
def wellformed_violations(spark, d):
    x = Lift(spark, d)
    rows = x.table("lineitem")
    return patterns.violations(Graph(lifted_facts(rows, node(F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))), {"/tpch/ship": rows.l_returnflag}).unionByName(x.parts_())))


# --- scalar functions ---


@query("SELECT p_partkey, 'graph://' || replace(url_encode(p_type), '%2F', '/') || '?lang=' || url_encode(p_brand) || '?path=a/' || replace(url_encode(p_name), '%2F', '/') || '#' || url_encode(p_brand || '/*+~ é') AS ticket FROM part", lift=False)
def tickets_encode(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    v = vname(F.concat("p_brand", F.lit("/*+~ é")), F.col("p_type"), "", F.concat(F.lit("./a//b/../"), F.col("p_name")), F.col("p_brand"))
    return p.select("p_partkey", ticket(v).alias("ticket"))


@query("SELECT p_partkey, p_name || '/+*~%41 é' AS signature, p_type AS corpus, 'r/' || p_size AS root, 'a/' || p_name AS path, p_brand AS language FROM part", lift=False)
def tickets_roundtrip(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    v = vname(F.concat("p_name", F.lit("/+*~%41 é")), F.col("p_type"), F.concat(F.lit("r/"), F.col("p_size")), F.concat(F.lit("a/"), F.col("p_name")), F.col("p_brand"))
    return p.select("p_partkey", parse_ticket(ticket(v)).alias("v")).select("p_partkey", "v.*")


@query(LIFT + ALL_SQL + r"""SELECT kind, count(*) AS n, starts_with(kind, '%') AS reverse, CASE WHEN starts_with(kind, '%') THEN kind[2:] ELSE '%' || kind END AS mirror, coalesce(try_cast(nullif(regexp_extract(kind, '^.+\.(\d+)$', 1), '') AS INT), 0) AS ordinal,
    regexp_replace(kind, '\.\d+$', '') AS base, regexp_matches(kind, '^/graph/edge/ref(/|$)') AS is_ref FROM edges_all GROUP BY kind""")
def edge_kind_algebra(x):
    e = x.entries.where("edge_kind <> ''").select("edge_kind")
    k = e.unionByName(e.select(edgekinds.mirror("edge_kind").alias("edge_kind"))).groupBy(F.col("edge_kind").alias("kind")).agg(F.count("*").alias("n"))
    return k.select("kind", "n", edgekinds.is_reverse("kind").alias("reverse"), edgekinds.mirror("kind").alias("mirror"), edgekinds.ordinal("kind").alias("ordinal"), edgekinds.base_kind("kind").alias("base"), edgekinds.is_variant("kind", V.edge("ref")).alias("is_ref"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)
    SELECT doc_id, line_number, (sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number) - strlen(line) - 1)::BIGINT AS line_start, strlen(line) AS line_bytes FROM l""", lift=False)
def line_index(spark, d):
    return spans.line_index(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").withColumn("line_number", F.col("line_number").cast("long"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number, strlen(text) // 2 AS middle FROM documents),
    s AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number) - strlen(line) - 1 AS line_start FROM l)
    SELECT doc_id, middle AS byte_offset, line_number, (middle - line_start)::BIGINT AS column_offset, middle AS back FROM s WHERE middle BETWEEN line_start AND line_start + strlen(line)""", lift=False)
def offset_to_point(spark, d):
    p = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", spans.point("text", F.floor(F.octet_length("text") / 2)).alias("p"))
    back = spans.offset_of("text", F.col("p.line_number"), F.col("p.column_offset"))
    return p.select("doc_id", *(F.col(f"p.{c}").cast("long").alias(c) for c in ("byte_offset", "line_number", "column_offset")), back.cast("long").alias("back"))


@query("SELECT n_nationkey, 'a/' || n_name AS cleaned, 'a' AS dir, n_name AS base, '../../' || n_name AS above FROM nation", lift=False)
def path_functions(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    p = clean_path(F.concat(F.lit("./a/b/..//./"), F.col("n_name")))
    return n.select("n_nationkey", p.alias("cleaned"), dirname(p).alias("dir"), basename(p).alias("base"), clean_path(F.concat(F.lit("a/../../../"), F.col("n_name"))).alias("above"))


@query(r"SELECT p_partkey, CASE WHEN p_name LIKE 'small %' THEN 'std' ELSE 'other' END AS corpus, CASE WHEN p_name LIKE 'small %' THEN 'out' ELSE '' END AS root, CASE WHEN p_name LIKE 'small %' THEN regexp_extract(p_name, '^(\w+) (\w+)$', 2) || '/' || regexp_extract(p_name, '^(\w+) (\w+)$', 1) ELSE p_name END AS path FROM part", lift=False)
def vname_rules(spark, d):
    rules = [{"pattern": r"(?P<size>small) (\w+)", "corpus": "std", "root": "out", "path": "@2@/@size@"}]
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.rewritten("p_name", rules, {"corpus": "other"}).alias("v"))
    return p.select("p_partkey", "v.*")


@query("SELECT p_partkey, p_size::BIGINT * 1024 AS n_bytes, p_size || 'K' AS shown FROM part", lift=False)
def byte_sizes(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    n = text.byte_size(F.concat(F.col("p_size").cast("string"), F.lit("KiB")))
    return p.select("p_partkey", n.alias("n_bytes"), text.format_size(n).alias("shown"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^small (ring|widget)$')", lift=False)
def trigram_prefilter(spark, d):
    pattern = "^small (ring|widget)$"
    need = text.required_trigrams("^small .*$")
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    near = p.where(F.size(F.array_intersect(text.trigrams("p_name"), F.array(*map(F.lit, need)))) == len(need))
    return near.where(F.regexp_like("p_name", F.lit(pattern)))


# --- references and decorations ---


@query(LIFT + REFS_SQL + """SELECT target, kind, anchor, file, "start", "end", build_config, scope, 'xxxxx' AS anchor_text, ("start" // 10 + 1)::INT AS line, ("start" % 10)::INT AS "column", 'xxxxxxxxx' AS snippet FROM refs""", DEFS)
def references(x):
    return refs.references(x)


@query(LIFT + REFS_SQL + 'SELECT file, "start", "end", kind, target, anchor, build_config FROM refs WHERE "start" >= 10 AND "end" <= 40', DEFS)
def decorations_within(x):
    return refs.decorations(x, 10, 40)


@query(LIFT + REFS_SQL + 'SELECT file, "start", "end", kind, target, anchor, build_config FROM refs WHERE "start" <= 22 AND "end" >= 22 AND build_config IN (\'O\', \'F\')', DEFS)
def decorations_around(x):
    return refs.decorations(x, 22, 22, "around", build_configs=["O", "F"])


@query(LIFT + DEFINITIONS_SQL + "SELECT node, definition FROM definitions", DEFS)
def definitions_first(x):
    return refs.definitions(x)


@query(LIFT + REFS_SQL + "SELECT DISTINCT file, target AS node, f.value AS kind FROM refs JOIN facts f ON f.ticket = target AND f.name = '/graph/node/kind'", [*DEFS, "parts_"])
def decoration_targets(x):
    return refs.target_nodes(x)


@query(LIFT + DEFINITIONS_SQL + "SELECT DISTINCT file, node, definition FROM refs JOIN definitions ON node = target", DEFS)
def decoration_definitions(x):
    return refs.target_definitions(x)


@query(LIFT + DEFINITIONS_SQL + "SELECT DISTINCT file, e.src AS overriding, e.dst AS overridden, e.kind AS kind, definition FROM edges e JOIN definitions d ON d.node = e.dst JOIN refs r ON r.target = e.src WHERE e.kind = '/graph/edge/overrides'", DEFS)
def decoration_overrides(x):
    return refs.overrides(x)


@query(LIFT + "SELECT e.src AS file, NULL::INT AS \"start\", NULL::INT AS \"end\", m.value AS message, d.value AS details FROM edges e JOIN facts m ON m.ticket = e.dst AND m.name = '/graph/message' LEFT JOIN facts d ON d.ticket = e.dst AND d.name = '/graph/details' WHERE e.kind = '/graph/edge/tagged'", ["files", "anchors", "diagnostics"])
def decoration_diagnostics(x):
    return refs.diagnostics(x)


# --- edges ---


@query(LIFT + ALL_SQL + r""", o AS (SELECT src, regexp_replace(kind, '\.\d+$', '') AS kind, coalesce(try_cast(nullif(regexp_extract(kind, '\.(\d+)$', 1), '') AS INT), 0) AS ordinal, dst FROM edges_all)
    SELECT src, kind, count(*) AS n, first(dst ORDER BY ordinal, dst) AS first_dst, last(dst ORDER BY ordinal, dst) AS last_dst FROM o GROUP BY src, kind""")
def edges_forward_reverse(x):
    return g.edge_groups(x)


@query(LIFT + ALL_SQL + r"SELECT regexp_replace(kind, '\.\d+$', '') AS kind, count(*) AS n FROM edges_all GROUP BY 1")
def edge_totals(x):
    return g.edge_totals(x)


@query(LIFT + ALL_SQL + """, mine AS (SELECT kind, 0 AS ordinal, dst FROM edges_all WHERE src = 'graph://tpch?lang=tpch#supplier%2F3'),
    ranked AS (SELECT *, (row_number() OVER (ORDER BY CASE WHEN regexp_matches(kind, '^%?/graph/edge/(defines|documents|ref|completes)(/|$)') THEN 0 ELSE 1 END, starts_with(kind, '%'),
    CASE WHEN kind LIKE '%/defines%' THEN 0 WHEN kind LIKE '%/documents%' THEN 1 WHEN kind LIKE '%/ref%' THEN 2 WHEN kind LIKE '%/named%' THEN 3 WHEN kind LIKE '%/typed%' THEN 4 ELSE 9 END, ltrim(kind, '%'), kind, ordinal, dst) - 1)::INT AS position FROM mine)
    SELECT position, kind, ordinal, dst FROM ranked WHERE position BETWEEN 5 AND 24""", ["anchor_edges", "suppliers"])
def edges_page(x):
    return g.edge_page(x, "graph://tpch?lang=tpch#supplier%2F3", 20, 5)


@query(LIFT + ALL_SQL + "SELECT DISTINCT src, dst, f.value AS dst_kind FROM edges_all LEFT JOIN facts f ON f.ticket = dst AND f.name = '/graph/node/kind'")
def edge_target_nodes(x):
    return g.edge_targets(x)


@query(LIFT + "SELECT src AS ticket, dst AS other, 'parent' AS side FROM edges WHERE kind = '/graph/edge/childof' UNION ALL SELECT dst, src, 'child' FROM edges WHERE kind = '/graph/edge/childof'", ["anchor_edges", "suppliers", "places"])
def parents_children(x):
    return g.neighbours(x, V.edge("childof")).withColumn("side", F.lit("parent")).unionByName(g.neighbours(x, V.edge("childof"), True).withColumn("side", F.lit("child")))


# --- call graph and cross-references ---


CALLS_SQL = DEFINITIONS_SQL + ", calls AS (SELECT scope AS caller, target AS callee, count(*) AS n_sites FROM refs WHERE kind = '/graph/edge/ref/call' AND scope IS NOT NULL GROUP BY 1, 2)"


@query(LIFT + CALLS_SQL + "SELECT callee, caller, definition, n_sites FROM calls JOIN definitions ON node = caller", DEFS)
def callgraph_callers(x):
    return refs.callers(x)


@query(LIFT + CALLS_SQL + "SELECT coalesce(i.node, o.node) AS node, coalesce(p, 0) AS n_predecessors, coalesce(s, 0) AS n_successors FROM (SELECT callee AS node, count(DISTINCT caller) AS p FROM calls GROUP BY 1) i FULL JOIN (SELECT caller AS node, count(DISTINCT callee) AS s FROM calls GROUP BY 1) o ON i.node = o.node", DEFS)
def callees(x):
    return content.call_sets(refs.call_edges(x))


@query(LIFT + DEFINITIONS_SQL + ALL_SQL + "SELECT DISTINCT src AS node, dst AS related, definition FROM edges_all JOIN definitions ON node = dst WHERE NOT regexp_matches(kind, '^%?/graph/edge/(defines|documents|ref|completes)(/|$)')", DEFS)
def related_definitions(x):
    return refs.related_definitions(x)


CATEGORY_SQL = REFS_SQL + """, categorised AS (SELECT r.*, CASE WHEN r.kind LIKE '/graph/edge/defines%' THEN CASE WHEN f.value = 'incomplete' THEN 'declaration' ELSE 'definition' END WHEN r.kind LIKE '/graph/edge/ref%' THEN 'reference' END AS category
    FROM refs r LEFT JOIN facts f ON f.ticket = r.target AND f.name = '/graph/complete')"""
XREF = [*DEFS, "parts_"]


@query(LIFT + CATEGORY_SQL + "SELECT target, category, kind, count(*) AS total FROM categorised WHERE category IS NOT NULL GROUP BY ALL", XREF)
def xref_counts_by_category(x):
    return xrefs.totals(xrefs.categorised(x))


@query(LIFT + CATEGORY_SQL + "SELECT target, category, count(*) FILTER (regexp_matches(file, 'path=orders/[0-9]*[02468]$')) AS total, count(*) FILTER (NOT regexp_matches(file, 'path=orders/[0-9]*[02468]$')) AS filtered FROM categorised WHERE category IS NOT NULL GROUP BY ALL", XREF)
def xref_filtered_totals(x):
    return xrefs.filtered_totals(xrefs.categorised(x), [{"corpus": "^tpch$", "path": "^orders/.*[02468]$"}, {"type": "EXCLUDE", "path": "^docs/"}])


@query(LIFT + CATEGORY_SQL + ', p AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY category, kind, file, "start", anchor, "end") - 1 AS position FROM categorised WHERE category IS NOT NULL) SELECT target, category, kind, anchor, position::INT AS position FROM p WHERE position BETWEEN 2 AND 6', XREF)
def xref_page(x):
    return xrefs.page(xrefs.categorised(x), 5, 2).select("target", "category", "kind", "anchor", "position")


@query("WITH RECURSIVE r AS (SELECT s_suppkey AS k, s_suppkey // 10 AS up FROM supplier WHERE s_suppkey // 10 <> s_suppkey UNION ALL SELECT r.k, r.up // 10 FROM r WHERE r.up // 10 <> r.up) SELECT 'graph://tpch?lang=tpch#supplier%2F' || k AS node, least(min('graph://tpch?lang=tpch#supplier%2F' || up), 'graph://tpch?lang=tpch#supplier%2F' || k) AS root FROM r GROUP BY k", ["suppliers"])
def xref_merge_closure(x):
    return xrefs.merged(x, [V.edge("overrides")])


# --- content ---


@query(LIFT + """, d AS (SELECT dst AS node, min(src) AS doc FROM edges WHERE kind = '/graph/edge/documents' GROUP BY 1), c AS (SELECT dst AS node, count(DISTINCT src) AS n FROM edges WHERE kind = '/graph/edge/childof' GROUP BY 1)
    SELECT d.node, d.doc, f.value AS text, coalesce(c.n, 0) AS n_children FROM d JOIN facts f ON f.ticket = d.doc AND f.name = '/graph/text' LEFT JOIN c ON c.node = d.node""", ["docs", "places", "suppliers"])
def documents_with_children(x):
    return content.documents(x)


@query("SELECT 'tpch' AS corpus, 1::BIGINT AS n_roots, '' AS roots, (SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS build_configs", [*DEFS, "docs"])
def corpus_roots(x):
    return content.corpus_roots(x)


@query(r"""WITH f AS (SELECT 'orders' AS directory, o_orderkey::VARCHAR AS name, 'FILE' AS kind FROM orders UNION ALL SELECT 'suppliers', s_suppkey::VARCHAR, 'FILE' FROM supplier UNION ALL SELECT 'docs/' || lang, doc_id::VARCHAR, 'FILE' FROM documents
    UNION ALL SELECT DISTINCT 'docs', lang, 'DIRECTORY' FROM documents UNION ALL SELECT '', 'orders', 'DIRECTORY' UNION ALL SELECT '', 'suppliers', 'DIRECTORY' UNION ALL SELECT '', 'docs', 'DIRECTORY')
    SELECT 'tpch' AS corpus, '' AS root, directory, name, kind FROM f""", ["files", "suppliers", "docs"])
def directories(x):
    return content.directories(x)


@query("SELECT DISTINCT lang AS name, 'DIRECTORY' AS kind FROM documents", ["docs"])
def directory_listing(x):
    return content.directory(x, "tpch", "", "docs")


@query("WITH i AS (SELECT p_brand AS q, p_partkey AS k, p_partkey - p_partkey % 4 AS c FROM part) SELECT q AS qualified_name, 'part/' || k AS ticket FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.q = i.q AND j.k = i.c AND i.c <> i.k)", lift=False)
def identifier_find_canonical(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    name = lambda k: F.concat(F.lit("part/"), k.cast("string"))
    i = p.select(F.col("p_brand").alias("qualified_name"), name(F.col("p_partkey")).alias("ticket"), name(F.col("p_partkey") - F.col("p_partkey") % 4).alias("canonical_ticket"), F.lit("tpch").alias("corpus"), F.lit("tpch").alias("language"))
    return content.find(i, F.col("qualified_name"), ["tpch"], canonical=True).select("qualified_name", "ticket")


@query("SELECT 'graph://tpch?lang=tpch#conv%2F' || conv_id AS node, (max(turn) + 1)::INT AS arity FROM conversations GROUP BY conv_id", ["conversations"])
def link_resolve_arity(x):
    return content.arity(x)


@query(LIFT + DEFINITIONS_SQL + """, d AS (SELECT d.node, definition, f.value = 'definition' AS full_ FROM definitions d JOIN facts f ON f.ticket = d.node AND f.name = '/graph/complete')
    SELECT r.file, r."start" AS "start", string_agg(DISTINCT d.node, ',' ORDER BY d.node) AS nodes FROM d JOIN refs r ON r.anchor = d.definition AND r.target = d.node WHERE full_ GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1000""", XREF)
def link_resolve(x):
    nodes = x.wide().where("kind = 'record'").select(F.col("ticket").alias("node"))
    return content.resolve(x, nodes).withColumn("nodes", F.array_join("nodes", ","))


@query("SELECT o_orderstatus AS corpus, o_orderpriority AS language, count(*) AS n_units, sum(n)::BIGINT AS n_inputs FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", lift=False)
def unit_info(spark, d):
    units = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("digest"), F.col("o_orderstatus").alias("corpus"), F.col("o_orderpriority").alias("language"))
    inputs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("digest"), F.col("l_partkey").cast("string").alias("path"))
    return content.unit_info(units, inputs)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)", lift=False)
def unused_inputs(spark, d):
    inputs = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("path"))
    used = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity >= 49").select(F.col("l_partkey").alias("path"))
    return content.required_inputs(inputs, used, missing=True).withColumnRenamed("path", "p_partkey")


# --- patterns ---


@query(LIFT + "SELECT DISTINCT c.src AS \"C\", n.src AS \"N\" FROM edges c JOIN edges n ON n.src = c.dst JOIN facts k ON k.ticket = c.src AND k.name = '/graph/node/kind' WHERE c.kind = '/graph/edge/childof' AND n.kind = '/graph/edge/childof' AND n.dst = 'graph://tpch?lang=tpch#region%2F1' AND k.value = 'function'", ["suppliers", "places"])
def pattern_positive(x):
    return patterns.solve(x, 'C childof N N childof vname("region/1", "tpch", "", "", "tpch") C .node/kind "function"')


@query(LIFT + "SELECT DISTINCT p.ticket AS \"P\" FROM facts p WHERE p.name = '/graph/node/kind' AND p.value = 'file' AND NOT starts_with(p.ticket, 'graph://tpch?path=docs/') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = p.ticket AND e.kind = '/graph/edge/tagged')", ["files", "diagnostics", "suppliers"])
def pattern_negated(x):
    return patterns.solve(x, 'P .node/kind "file" !{ P tagged D }')


@query(LIFT + "SELECT DISTINCT src AS \"C\", dst AS \"T\" FROM edges JOIN facts f ON f.ticket = dst AND f.name = '/tpch/role' WHERE kind = '/graph/edge/param.1' AND value = 'assistant'", ["conversations"])
def pattern_ordinal(x):
    return patterns.solve(x, 'T %param.1 C T ./tpch/role Role Role = "assistant"').select("C", "T")


# --- streams, tools and renderings ---


@query(LIFT + "SELECT '' AS edge_kind, count(*) AS n FROM facts UNION ALL SELECT kind, count(*) FROM edges GROUP BY kind")
def entries_wire_roundtrip(x):
    return store.counts_by_kind(entry_streams.decoded(entry_streams.encoded(x.entries)).distinct())


@query(LIFT + "SELECT ticket AS source, '' AS edge_kind, '' AS target, count(*)::INT AS n_properties FROM facts GROUP BY ticket UNION ALL SELECT src, kind, dst, 1 FROM edges")
def entries_aggregated(x):
    return store.aggregated(x.entries).select("source", "edge_kind", F.coalesce("target", F.lit("")).alias("target"), F.size("properties").alias("n_properties"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM nation", lift=False)
def store_upsert(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = lambda value, df: df.select(node(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"))).alias("source"), F.lit("").alias("edge_kind"), F.lit(None).cast(VNAME).alias("target"), F.lit("/v").alias("fact_name"), F.lit(value).cast("binary").alias("fact_value"))
    both = store.upserted(rows("old", n), rows("new", n.where("n_nationkey % 2 = 0")))
    return both.select(F.substring_index("source.signature", "/", -1).cast("long").alias("n_nationkey"), F.col("fact_value").cast("string").alias("value"))


@query(LIFT + DEFINITIONS_SQL + """SELECT r."start" AS "start", r."end" AS "end", r.kind, r.target, f.value AS target_kind, d.definition FROM refs r LEFT JOIN facts f ON f.ticket = r.target AND f.name = '/graph/node/kind' LEFT JOIN definitions d ON d.node = r.target
    WHERE r.file = 'graph://tpch?path=orders/7' AND r."start" <= 12 AND r."end" >= 12""", XREF)
def what_is_at(x):
    return refs.at_point(x, "graph://tpch?path=orders/7", 12)


@query(LIFT + REFS_SQL + """SELECT file, ("start" // 10 + 1)::INT AS line, target AS node, CASE f.value WHEN 'record' THEN 'c' ELSE 'f' END AS letter FROM refs JOIN facts f ON f.ticket = target AND f.name = '/graph/node/kind' WHERE kind = '/graph/edge/defines/binding'""", XREF)
def tag_export(x):
    return refs.tags(x)


@query("SELECT DISTINCT 'graph://tpch?lang=tpch#region%2F' || n_regionkey AS \"start\", 'graph://tpch?lang=tpch#nation%2F' || c_nationkey AS \"end\" FROM customer JOIN nation ON c_nationkey = n_nationkey", ["places"])
def path_query(x):
    regions = x.wide().where(F.contains("ticket", F.lit("region"))).select("ticket")
    return refs.path(x, regions, "%" + V.edge("childof"), "%" + V.edge("typed"), V.edge("typed"))


@query(LIFT + """, w AS (SELECT DISTINCT src AS anchor, "start", "end" FROM edges JOIN (SELECT ticket, value::INT AS "start" FROM facts WHERE name = '/graph/loc/start') s ON s.ticket = src JOIN (SELECT ticket, value::INT AS "end" FROM facts WHERE name = '/graph/loc/end') f ON f.ticket = src)
    SELECT anchor, 'node/kind' AS name, 'anchor' AS value FROM w UNION SELECT anchor, 'loc/start', "start"::VARCHAR FROM w UNION SELECT anchor, 'loc/end', "end"::VARCHAR FROM w UNION SELECT src, kind, dst FROM edges WHERE src IN (SELECT anchor FROM w) AND kind <> '/graph/edge/childof'""", DEFS)
def reply_atomised(x):
    return content.atomised(refs.narrow_references(x))


@query("SELECT DISTINCT kind, rank FROM (SELECT kind, row_number() OVER (ORDER BY k) AS rank FROM (VALUES ('/graph/edge/defines/binding', 0), ('/graph/edge/documents', 1), ('/graph/edge/ref', 2), ('/graph/edge/ref/call', 3), ('%/graph/edge/defines/binding', 4), ('%/graph/edge/documents', 5), ('%/graph/edge/ref', 6), ('%/graph/edge/ref/call', 7), ('/graph/edge/typed', 8), ('/graph/edge/childof', 9), ('/graph/edge/overrides', 10), ('/graph/edge/tagged', 12), ('/graph/edge/param', 11), ('%/graph/edge/typed', 13), ('%/graph/edge/childof', 14), ('%/graph/edge/overrides', 15), ('%/graph/edge/param', 16), ('%/graph/edge/tagged', 17)) v(kind, k))")
def edge_kind_order(x):
    kinds = g.edge_totals(x).select("kind")
    return kinds.select("kind", F.row_number().over(Window.orderBy(edgekinds.display_rank("kind"))).cast("long").alias("rank"))  # a row for each kind


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    s AS (SELECT *, (sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - strlen(line) - 1)::BIGINT AS line_start FROM l) SELECT doc_id, n AS line_number, line_start + 6 AS "start", line_start + 6 + strlen(line) AS "end" FROM s""", lift=False)
def spans_patched(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.concat(F.lit("ADDED\n"), F.col("text")).alias("new"))
    lines = spans.line_index(t, "doc_id", "text").select("doc_id", F.col("line_number").cast("long").alias("line_number"), F.col("line_start").alias("start"), (F.col("line_start") + F.col("line_bytes")).alias("end"))
    return spans.patched(lines, diff.edits(t, "doc_id", "text", "new"), "doc_id").select("doc_id", "line_number", "start", "end")


@query("SELECT p_partkey, p_type || '::' || p_brand || '(' || p_name || ')' AS signature, p_type || '.' || p_brand AS qualified_name, p_brand AS base_name FROM part", lift=False)
def marked_source(spark, d):
    leaf = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("pre_text"))
    p = spark.read.parquet(f"{d}/part.parquet")
    context = F.struct(F.lit("CONTEXT").alias("kind"), F.array(leaf("IDENTIFIER", "p_type")).alias("child"), F.lit("::").alias("post_text"))
    whole = F.concat(F.lit('{"child":['), F.to_json(context), F.lit(","), F.to_json(leaf("IDENTIFIER", "p_brand")), F.lit(',{"kind":"PARAMETER","pre_text":"(","post_text":")","child":['), F.to_json(leaf("IDENTIFIER", "p_name")), F.lit("]}]}"))
    t = p.select("p_partkey", whole.alias("tree"))
    return t.select("p_partkey", *(render.rendered("tree", how).alias(how) for how in ("signature", "qualified_name", "base_name")))


@query(lift=False)
def claim_assignment(spark, d):
    """Suppliers as units, parts as inputs, all pairs of them; the choice is sequential, so there is no SQL for it."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("input"))
    return units.claims(rows)


@query(lift=False)
def html_plain_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", html.plain_text("html").alias("text"))


# --- flagship ---


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """From entries to the decorations of a span: everything between lift and reply."""
    return refs.decorations(Graph(Lift(spark, d).entries(*DEFS)), 0, 40)

