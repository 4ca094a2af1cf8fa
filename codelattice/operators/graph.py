"""Entries assembled into normalised facts and edges, and the node and edge queries over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edgekinds
from ..functions.uri import ticket
from ..model import REVERSE, VOCABULARY, Vocabulary, is_fact

#: A column with the hash of a ticket beside it. All tickets begin alike, so sorts by them compare whole texts; sorts by (HASH, ticket) compare numbers.
HASH = "_hash"


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left.join(right, key, how) for a key of long texts: sorted by their hashes, the texts themselves are only compared where these are equal."""
    return left.withColumn(HASH, F.xxhash64(key)).join(right.withColumn(HASH, F.xxhash64(key)), [HASH, key], how).drop(HASH)


class Graph:
    """facts(ticket, vname, name, value) and edges(src, kind, ordinal, dst), both sets.

    A node that has one fact with several values keeps the smallest, so the result doesn't depend on an order. Edges are
    split from their ordinals. Both come from partial aggregates by key.
    """

    def __init__(self, entries: DataFrame, vocabulary: Vocabulary = VOCABULARY, folder: str | None = None):
        self.entries, self.v, self.folder = entries, vocabulary, folder

    @property
    def edges_by_source(self) -> DataFrame:
        """edges dealt by source once, with HASH of it: what joins or groups them by (HASH, src) needs no shuffle of its own. For sources with few edges each, as anchors."""
        e = self._raw_edges().withColumn(HASH, F.xxhash64("src")).repartition(HASH, "src").distinct()
        return e.select(HASH, "src", edgekinds.base_kind("label").alias("kind"), edgekinds.ordinal("label").alias("ordinal"), "dst")

    def _raw_edges(self) -> DataFrame:
        return self.entries.where(~is_fact()).select(ticket("source", self.v).alias("src"), F.col("edge_kind").alias("label"), ticket("target", self.v).alias("dst"))

    @property
    def raw_facts(self) -> DataFrame:
        return self.entries.where(is_fact()).select(ticket("source", self.v).alias("ticket"), F.col("source").alias("vname"), F.col("fact_name").alias("name"), F.col("fact_value").alias("value"))

    @property
    def facts(self) -> DataFrame:
        key = F.xxhash64("ticket", "name").alias(HASH)
        return self.raw_facts.groupBy(key, "ticket", "name").agg(F.min("value").alias("value"), F.min("vname").alias("vname")).select("ticket", "vname", "name", "value")

    @property
    def edges(self) -> DataFrame:
        e = self._raw_edges().distinct()
        return e.select("src", edgekinds.base_kind("label").alias("kind"), edgekinds.ordinal("label").alias("ordinal"), "dst")

    def wide(self, *names: str) -> DataFrame:
        """One row for each node: its ticket, VName, kind and the named facts as columns, in one aggregate."""
        return self.wide_by_hash(*names).drop(HASH)

    def wide_by_hash(self, *names: str) -> DataFrame:
        """wide, dealt by (HASH, ticket) and with that HASH."""
        wanted = {"kind": self.v.kind} | {n.rsplit("/", 1)[-1]: n for n in names}
        f = self.raw_facts.where(F.col("name").isin(list(wanted.values())))
        return f.groupBy(F.xxhash64("ticket").alias(HASH), "ticket").agg(F.min("vname").alias("vname"), *(F.min(F.when(F.col("name") == n, F.col("value"))).alias(c) for c, n in wanted.items())).withColumn("kind", F.col("kind").cast("string"))

    def conflicts(self) -> DataFrame:
        """(ticket, name, n_values) of facts with more than one value."""
        return self.raw_facts.groupBy("ticket", "name").agg(F.countDistinct("value").alias("n_values")).where("n_values > 1")

    def nodes(self) -> DataFrame:
        """One row for each node that is the source of anything: numbers of facts and edges."""
        f = self.facts.groupBy("ticket").agg(F.count("*").alias("n_facts"))
        e = self.edges.groupBy(F.col("src").alias("ticket")).agg(F.count("*").alias("n_edges"))
        return joined(f, e, "ticket", "full").select("ticket", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))

    def filtered(self, kinds: list[str] | None = None, subkinds: list[str] | None = None, include_facts: list[str] | None = None) -> DataFrame:
        """Facts of nodes of some kinds and subkinds. None doesn't restrict; an empty list lets nothing through."""
        f = self.facts
        for name, allowed in ((self.v.kind, kinds), (self.v.fact("subkind"), subkinds)):
            if allowed is not None:
                keep = self.raw_facts.where(F.col("name") == name).groupBy("ticket").agg(F.min("value").cast("string").alias("_v")).where(F.col("_v").isin(allowed) if allowed else F.lit(False))
                f = f.join(keep.select("ticket"), "ticket", "left_semi")
        return f if include_facts is None else f.where(F.col("name").isin(include_facts) if include_facts else F.lit(False))

    def edges_all(self) -> DataFrame:
        """Every edge and its mirror."""
        e = self.edges
        return e.unionByName(e.select(F.col("dst").alias("src"), edgekinds.mirror("kind").alias("kind"), "ordinal", F.col("src").alias("dst")))


def glob(pattern: str) -> str:
    """A fact glob as an unanchored regular expression: ** any text, * any text without a slash, ? one character that isn't a slash."""
    table = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(table.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", pattern))


def by_globs(name: Column | str, globs: list[str]) -> Column:
    """Whether any glob matches a part of the name. No globs: nothing; ** alone: everything."""
    if "**" in globs:
        return F.lit(True)
    out = F.lit(False)
    for g in globs:
        out = out | F.regexp_like(F.col(name) if isinstance(name, str) else name, F.lit(glob(g)))
    return out


def node_facts(graph: Graph, tickets: list[str] | DataFrame | None = None, globs: list[str] | None = None) -> DataFrame:
    """(ticket, name, value): the facts of nodes whose names match; a node without any is left out. tickets: all, a request, or a table of them."""
    f = graph.facts.select("ticket", "name", "value")
    if isinstance(tickets, list):
        f = f.where(F.col("ticket").isin(tickets))
    elif tickets is not None:
        f = f.join(tickets.select("ticket").distinct(), "ticket", "left_semi")
    return f.where(by_globs("name", globs)) if globs else f


def edge_groups(graph: Graph, kinds: list[str] | None = None) -> DataFrame:
    """(src, kind, n, first_dst, last_dst): edges and mirrors grouped by kind, targets in order of (ordinal, ticket)."""
    e = graph.edges_all()
    if kinds:
        e = e.where(F.col("kind").isin(kinds))
    order = F.struct("ordinal", "dst")
    return e.groupBy(F.xxhash64("src", "kind").alias(HASH), "src", "kind").agg(F.count("*").alias("n"), F.min(order)["dst"].alias("first_dst"), F.max(order)["dst"].alias("last_dst")).drop(HASH)


def edge_totals(graph: Graph) -> DataFrame:
    return graph.edges_all().groupBy("kind").agg(F.count("*").alias("n"))


def edge_page(graph: Graph, src: str, page_size: int, page_token: int = 0, kinds: list[str] | None = None) -> DataFrame:
    """One page of a node's edges in display order: (position, kind, ordinal, dst); page_token is the position to start from."""
    e = graph.edges_all().where(F.col("src") == src)
    if kinds:
        e = e.where(F.col("kind").isin(kinds))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(edgekinds.display_rank("kind", graph.v), "kind", "ordinal", "dst"))
    upto = e.withColumn("position", rank).where(F.col("position") <= page_token + page_size)
    return upto.select((F.col("position") - 1).alias("position"), "kind", "ordinal", "dst").where(F.col("position") >= page_token)


def edge_targets(graph: Graph) -> DataFrame:
    """(src, dst, dst_kind): distinct neighbours both ways with their node kind; a neighbour without facts has none."""
    kinds = graph.wide().select(F.col("ticket").alias("dst"), F.col("kind").alias("dst_kind"))
    return joined(graph.edges_all().select("src", "dst").distinct(), kinds, "dst", "left").select("src", "dst", "dst_kind")


def neighbours(graph: Graph, kind: str, reverse: bool = False) -> DataFrame:
    """(ticket, other) along one kind: childof gives parents, reversed children."""
    e = graph.edges.where(F.col("kind") == kind)
    return e.select(F.col("dst" if reverse else "src").alias("ticket"), F.col("src" if reverse else "dst").alias("other"))


def without_reverses(entries: DataFrame) -> DataFrame:
    return entries.where(~F.startswith("edge_kind", F.lit(REVERSE)))
