"""Lift of the star-schema tables to entries: orders become files, line items anchors, parts, suppliers and the rest nodes.

Every table gives facts and edges row by row; only line items need a distinct, because their pairs repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import VNAME, VOCABULARY, Vocabulary, vname

CORPUS = "tpch"
LINE = "xxxxxxxxx\n"


def node(signature, language=CORPUS) -> Column:
    return vname(signature, CORPUS, "", "", language)


def file(path, signature="", language="") -> Column:
    return vname(signature, CORPUS, "", path, language)


def named(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), key.cast("string"))


def facts(df: DataFrame, source: Column, values: dict[str, Column]) -> DataFrame:
    """One entry for each name whose value isn't null."""
    pairs = F.array(*(F.struct(F.lit(n).alias("fact_name"), v.cast("string").cast("binary").alias("fact_value")) for n, v in values.items()))
    rows = df.select(source.alias("source"), F.explode(pairs).alias("f")).where("f.fact_value is not null")
    return rows.select("source", F.lit("").alias("edge_kind"), F.lit(None).cast(VNAME).alias("target"), "f.fact_name", "f.fact_value")


def edges(df: DataFrame, source: Column, kind: Column | str, target: Column) -> DataFrame:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return df.select(source.alias("source"), kind.alias("edge_kind"), target.alias("target"), F.lit("/").alias("fact_name"), F.lit(b"").alias("fact_value"))


class Lift:
    """The tables of one folder; parts() names the entries by what they are, so a query reads only what it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str, vocabulary: Vocabulary = VOCABULARY):
        self.spark, self.dir, self.v = spark, sf_dir, vocabulary

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self) -> DataFrame:
        v, o = self.v, self.table("orders")
        return facts(o, file(named("orders", o.o_orderkey)), {v.kind: F.lit("file"), v.fact("text"): F.lit(7 * LINE), v.fact("text/encoding"): F.lit("UTF-8")})

    def lines(self, *columns: Column | str) -> DataFrame:
        """Distinct line items by some columns; dealt once by order, which serves the distinct and a join with orders."""
        return self.table("lineitem").repartition("l_orderkey").select("l_orderkey", "l_linenumber", *columns).distinct()

    def anchor(self) -> Column:
        return vname(F.col("l_linenumber").cast("string"), CORPUS, "", named("orders", F.col("l_orderkey")), CORPUS)

    def anchors(self) -> DataFrame:
        v = self.v
        pairs = self.lines().join(self.table("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
        start = (F.col("l_linenumber") - 1) * 10
        return facts(pairs, self.anchor(), {v.kind: F.lit("anchor"), v.fact("loc/start"): start, v.fact("loc/end"): start + 5, v.fact("build/config"): F.col("o_orderstatus")})

    def anchor_edges(self) -> DataFrame:
        v, flag = self.v, F.col("l_returnflag")
        kind = F.when(flag == "R", v.edge("defines/binding")).when(flag == "A", v.edge("ref")).otherwise(v.edge("ref/call"))
        to_part = edges(self.lines("l_partkey", kind.alias("kind")), self.anchor(), F.col("kind"), node(named("part", F.col("l_partkey"))))
        return to_part.unionByName(edges(self.lines("l_suppkey"), self.anchor(), v.edge("childof"), node(named("supplier", F.col("l_suppkey")))))

    def parts_(self) -> DataFrame:
        v, p = self.v, self.table("part")
        return facts(p, node(named("part", p.p_partkey)), {v.kind: F.lit("record"), v.fact("subkind"): F.lit("class"), "/tpch/brand": p.p_brand, "/tpch/type": p.p_type, v.fact("complete"): F.when(p.p_size > 25, "definition").otherwise("incomplete")})

    def suppliers(self) -> DataFrame:
        v, s = self.v, self.table("supplier")
        own, path = node(named("supplier", s.s_suppkey)), named("suppliers", s.s_suppkey)
        site = vname("def", CORPUS, "", path, CORPUS)
        up = F.floor(s.s_suppkey / 10)
        return reduce(DataFrame.unionByName, [
            facts(s, own, {v.kind: F.lit("function")}),
            facts(s, file(path), {v.kind: F.lit("file"), v.fact("text"): F.lit(LINE), v.fact("text/encoding"): F.lit("UTF-8")}),
            facts(s, site, {v.kind: F.lit("anchor"), v.fact("loc/start"): F.lit(0), v.fact("loc/end"): F.lit(5)}),
            edges(s, site, v.edge("defines/binding"), own),
            edges(s, own, v.edge("childof"), node(named("nation", s.s_nationkey))),
            edges(s.where(up != s.s_suppkey), own, v.edge("overrides"), node(named("supplier", up))),
        ])

    def places(self) -> DataFrame:
        v, n, r, c = self.v, self.table("nation"), self.table("region"), self.table("customer")
        return reduce(DataFrame.unionByName, [
            facts(n, node(named("nation", n.n_nationkey)), {v.kind: F.lit("package")}),
            facts(r, node(named("region", r.r_regionkey)), {v.kind: F.lit("package")}),
            edges(n, node(named("nation", n.n_nationkey)), v.edge("childof"), node(named("region", n.n_regionkey))),
            facts(c, node(named("customer", c.c_custkey)), {v.kind: F.lit("variable")}),
            edges(c, node(named("customer", c.c_custkey)), v.edge("typed"), node(named("nation", c.c_nationkey))),
        ])

    def diagnostics(self) -> DataFrame:
        v, e = self.v, self.table("events").where("event_type = 'error'")
        orders = self.table("orders").select(F.count("*").alias("n_orders"))
        own = node(named("event", F.col("event_id")))
        tagged = edges(e.crossJoin(F.broadcast(orders)), file(named("orders", F.col("event_id") % F.col("n_orders"))), v.edge("tagged"), own)  # one row
        return facts(e, own, {v.kind: F.lit("diagnostic"), v.fact("message"): e.event_type, v.fact("details"): e.props}).unionByName(tagged)

    def docs(self) -> DataFrame:
        v, d = self.v, self.table("documents").select("doc_id", "lang", "text")
        parts = self.table("part").select(F.count("*").alias("n_parts"))
        path, own = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")), node(named("doc", F.col("doc_id")))
        return reduce(DataFrame.unionByName, [
            facts(d, file(path), {v.kind: F.lit("file"), v.fact("text"): d.text, v.fact("text/encoding"): F.lit("UTF-8")}),
            facts(d, own, {v.kind: F.lit("doc"), v.fact("text"): d.text}),
            edges(d.crossJoin(F.broadcast(parts)), own, v.edge("documents"), node(named("part", F.col("doc_id") % F.col("n_parts")))),  # one row
        ])

    def conversations(self) -> DataFrame:
        v, c = self.v, self.table("conversations").select("conv_id", "turn", "role")
        conv = named("conv", c.conv_id)
        turn = F.concat(conv, F.lit("/"), c.turn.cast("string"))
        return reduce(DataFrame.unionByName, [
            facts(c.select("conv_id").distinct(), node(named("conv", F.col("conv_id"))), {v.kind: F.lit("function")}),
            facts(c, node(turn), {v.kind: F.lit("variable"), "/tpch/role": c.role}),
            edges(c, node(conv), F.concat(F.lit(v.edge("param.")), c.turn.cast("string")), node(turn)),
        ])

    def entries(self, *parts: str) -> DataFrame:
        """All entries, or those of the named parts."""
        return reduce(DataFrame.unionByName, [getattr(self, p)() for p in parts or PARTS])


PARTS = ["files", "anchors", "anchor_edges", "parts_", "suppliers", "places", "diagnostics", "docs", "conversations"]

#: The same for DuckDB: facts(ticket, name, value) and edges(src, kind, dst) over the base tables.
SQL = """
WITH lines AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem),
anchor_rows AS (SELECT DISTINCT l_orderkey, l_linenumber, o_orderstatus FROM lines JOIN orders ON l_orderkey = o_orderkey),
facts_wide AS (
    SELECT 'graph://tpch?path=orders/' || o_orderkey AS ticket, ['/graph/node/kind', '/graph/text', '/graph/text/encoding'] AS names, ['file', repeat('xxxxxxxxx' || chr(10), 7), 'UTF-8'] AS vals FROM orders
    UNION ALL SELECT 'graph://tpch?lang=tpch?path=orders/' || l_orderkey || '#' || l_linenumber, ['/graph/node/kind', '/graph/loc/start', '/graph/loc/end', '/graph/build/config'], ['anchor', ((l_linenumber - 1) * 10)::VARCHAR, ((l_linenumber - 1) * 10 + 5)::VARCHAR, o_orderstatus] FROM anchor_rows
    UNION ALL SELECT 'graph://tpch?lang=tpch#part%2F' || p_partkey, ['/graph/node/kind', '/graph/subkind', '/tpch/brand', '/tpch/type', '/graph/complete'], ['record', 'class', p_brand, p_type, CASE WHEN p_size > 25 THEN 'definition' ELSE 'incomplete' END] FROM part
    UNION ALL SELECT 'graph://tpch?lang=tpch#supplier%2F' || s_suppkey, ['/graph/node/kind'], ['function'] FROM supplier
    UNION ALL SELECT 'graph://tpch?path=suppliers/' || s_suppkey, ['/graph/node/kind', '/graph/text', '/graph/text/encoding'], ['file', 'xxxxxxxxx' || chr(10), 'UTF-8'] FROM supplier
    UNION ALL SELECT 'graph://tpch?lang=tpch?path=suppliers/' || s_suppkey || '#def', ['/graph/node/kind', '/graph/loc/start', '/graph/loc/end'], ['anchor', '0', '5'] FROM supplier
    UNION ALL SELECT 'graph://tpch?lang=tpch#nation%2F' || n_nationkey, ['/graph/node/kind'], ['package'] FROM nation
    UNION ALL SELECT 'graph://tpch?lang=tpch#region%2F' || r_regionkey, ['/graph/node/kind'], ['package'] FROM region
    UNION ALL SELECT 'graph://tpch?lang=tpch#customer%2F' || c_custkey, ['/graph/node/kind'], ['variable'] FROM customer
    UNION ALL SELECT 'graph://tpch?lang=tpch#event%2F' || event_id, ['/graph/node/kind', '/graph/message', '/graph/details'], ['diagnostic', event_type, props::VARCHAR] FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'graph://tpch?path=docs/' || lang || '/' || doc_id, ['/graph/node/kind', '/graph/text', '/graph/text/encoding'], ['file', text, 'UTF-8'] FROM documents
    UNION ALL SELECT 'graph://tpch?lang=tpch#doc%2F' || doc_id, ['/graph/node/kind', '/graph/text'], ['doc', text] FROM documents
    UNION ALL SELECT DISTINCT 'graph://tpch?lang=tpch#conv%2F' || conv_id, ['/graph/node/kind'], ['function'] FROM conversations
    UNION ALL SELECT 'graph://tpch?lang=tpch#conv%2F' || conv_id || '%2F' || turn, ['/graph/node/kind', '/tpch/role'], ['variable', role] FROM conversations),
facts_all AS (SELECT ticket, unnest(names) AS name, unnest(vals) AS value FROM facts_wide),
facts AS (SELECT * FROM facts_all WHERE value IS NOT NULL),
edges AS (
    SELECT 'graph://tpch?lang=tpch?path=orders/' || l_orderkey || '#' || l_linenumber AS src, CASE l_returnflag WHEN 'R' THEN '/graph/edge/defines/binding' WHEN 'A' THEN '/graph/edge/ref' ELSE '/graph/edge/ref/call' END AS kind, 'graph://tpch?lang=tpch#part%2F' || l_partkey AS dst FROM lines
    UNION SELECT 'graph://tpch?lang=tpch?path=orders/' || l_orderkey || '#' || l_linenumber, '/graph/edge/childof', 'graph://tpch?lang=tpch#supplier%2F' || l_suppkey FROM lines
    UNION ALL SELECT 'graph://tpch?lang=tpch?path=suppliers/' || s_suppkey || '#def', '/graph/edge/defines/binding', 'graph://tpch?lang=tpch#supplier%2F' || s_suppkey FROM supplier
    UNION ALL SELECT 'graph://tpch?lang=tpch#supplier%2F' || s_suppkey, '/graph/edge/childof', 'graph://tpch?lang=tpch#nation%2F' || s_nationkey FROM supplier
    UNION ALL SELECT 'graph://tpch?lang=tpch#supplier%2F' || s_suppkey, '/graph/edge/overrides', 'graph://tpch?lang=tpch#supplier%2F' || (s_suppkey // 10) FROM supplier WHERE s_suppkey // 10 <> s_suppkey
    UNION ALL SELECT 'graph://tpch?lang=tpch#nation%2F' || n_nationkey, '/graph/edge/childof', 'graph://tpch?lang=tpch#region%2F' || n_regionkey FROM nation
    UNION ALL SELECT 'graph://tpch?lang=tpch#customer%2F' || c_custkey, '/graph/edge/typed', 'graph://tpch?lang=tpch#nation%2F' || c_nationkey FROM customer
    UNION ALL SELECT 'graph://tpch?path=orders/' || (event_id % (SELECT count(*) FROM orders)), '/graph/edge/tagged', 'graph://tpch?lang=tpch#event%2F' || event_id FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'graph://tpch?lang=tpch#doc%2F' || doc_id, '/graph/edge/documents', 'graph://tpch?lang=tpch#part%2F' || (doc_id % (SELECT count(*) FROM part)) FROM documents
    UNION ALL SELECT 'graph://tpch?lang=tpch#conv%2F' || conv_id, '/graph/edge/param.' || turn, 'graph://tpch?lang=tpch#conv%2F' || conv_id || '%2F' || turn FROM conversations)
"""
