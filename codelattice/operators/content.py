"""Documents, file tree, identifiers, explorer, links, compilation units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edgekinds
from ..functions.uri import basename, dirname
from .graph import HASH, Graph, joined, neighbours
from .refs import anchors, definitions, narrow_references
from .requests import kind_matches, located


def documents(graph: Graph) -> DataFrame:
    """(node, doc, text, n_children): what documents a node; of several the smallest doc node. Children along childof."""
    v = graph.v
    text = graph.wide(v.fact("text")).where("kind = 'doc'").select(F.col("ticket").alias("doc"), F.col("text").cast("string").alias("text"))
    e = graph.edges.where(F.col("kind") == v.edge("documents")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("doc"))
    children = neighbours(graph, v.edge("childof"), reverse=True).groupBy(F.col("ticket").alias("node")).agg(F.countDistinct("other").alias("n_children"))
    return joined(joined(e, text, "doc"), children, "node", "left").select("node", "doc", "text", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def file_names(graph: Graph) -> DataFrame:
    return graph.wide().where("kind = 'file'").select(F.col("ticket").alias("file"), "vname.corpus", "vname.root", "vname.path")


def build_configs(graph: Graph) -> DataFrame:
    """(file, build_config) of files' anchors."""
    return anchors(graph).select("file", "build_config").distinct()


def corpus_roots(graph: Graph) -> DataFrame:
    """(corpus, n_roots, roots, build_configs): distinct roots and build configs of a corpus' files, joined in order."""
    joined = file_names(graph).join(build_configs(graph), "file", "left")
    return joined.groupBy("corpus").agg(F.countDistinct("root").alias("n_roots"), F.array_join(F.sort_array(F.collect_set("root")), ",").alias("roots"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("build_config") != "", F.col("build_config")))), ",").alias("build_configs"))


def directories(graph: Graph) -> DataFrame:
    """(corpus, root, directory, name, kind): the entries of every directory: FILE, or DIRECTORY for each ancestor."""
    f = file_names(graph).select("corpus", "root", "path")
    parts = F.split("path", "/")
    levels = f.select("corpus", "root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), F.when(i == F.size(parts), "FILE").otherwise("DIRECTORY").alias("kind")))).alias("x"))
    return levels.select("corpus", "root", dirname(F.col("x.path")).alias("directory"), basename(F.col("x.path")).alias("name"), F.col("x.kind").alias("kind")).distinct()


def directory_entries(graph: Graph) -> DataFrame:
    """directories with generated (a file under a root) and build_configs: those of the anchors of a file, or of all files below a directory."""
    f = file_names(graph).join(build_configs(graph), "file", "left").select("corpus", "root", "path", "build_config")
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), F.when(i == F.size(parts), "FILE").otherwise("DIRECTORY").alias("kind")))
    rows = f.select("corpus", "root", "build_config", F.explode(levels).alias("x"))
    rows = rows.groupBy("corpus", "root", "x").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("build_config") != "", F.col("build_config")))), ",").alias("build_configs"))
    return rows.select("corpus", "root", dirname(F.col("x.path")).alias("directory"), basename(F.col("x.path")).alias("name"), F.col("x.kind").alias("kind"), ((F.col("root") != "") & (F.col("x.kind") == "FILE")).alias("generated"), "build_configs")


def directory(graph: Graph, corpus: str, root: str = "", path: str = "") -> DataFrame:
    """One directory; an unknown one is empty."""
    return directories(graph).where((F.col("corpus") == corpus) & (F.col("root") == root) & (F.col("directory") == path)).select("name", "kind")


def call_sets(calls: DataFrame) -> DataFrame:
    """(node, n_predecessors, n_successors) of a call graph (caller, callee)."""
    c = calls.select("caller", "callee").distinct()
    into = c.groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("n_predecessors"))
    out = c.groupBy(F.col("caller").alias("node")).agg(F.count("*").alias("n_successors"))
    return into.join(out, "node", "full").select("node", F.coalesce("n_predecessors", F.lit(0)).alias("n_predecessors"), F.coalesce("n_successors", F.lit(0)).alias("n_successors"))


def find(identifiers: DataFrame, name: str | Column, corpora: list[str] | None = None, languages: list[str] | None = None, canonical: bool = False) -> DataFrame:
    """Matches of a qualified name. identifiers(qualified_name, base_name, ticket, canonical_ticket, corpus, language, kind).

    With canonical, a match goes if its canonical ticket is another one that matches too.
    """
    m = identifiers.where(F.col("qualified_name") == (name if isinstance(name, Column) else F.lit(name)))
    if corpora:
        m = m.where(F.col("corpus").isin(corpora))
    if languages:
        m = m.where(F.col("language").isin(languages))
    return canonical_only(m) if canonical else m


def canonical_only(matches: DataFrame) -> DataFrame:
    present = matches.select(F.col("qualified_name").alias("_q"), F.col("ticket").alias("_t")).distinct()
    other = (F.col("_q") == F.col("qualified_name")) & (F.col("_t") == F.col("canonical_ticket")) & (F.col("canonical_ticket") != F.col("ticket"))
    return matches.join(present, other, "left_anti")


def arity(graph: Graph) -> DataFrame:
    """(node, arity): parameters of a node, the largest ordinal plus one."""
    return graph.edges.where(edgekinds.is_variant("kind", graph.v.edge("param"))).groupBy(F.col("src").alias("node")).agg((F.max("ordinal") + 1).alias("arity"))


def resolve(graph: Graph, nodes: DataFrame, params: int | None = None, most: int = 1000, kinds: list[str] | None = None, include: list[dict] | None = None, exclude: list[dict] | None = None) -> DataFrame:
    """Links of nodes(node): where they are defined, complete definitions before others: (file, start, nodes), grouped by place, capped at `most` as the request does.

    kinds: kinds or kind/subkind of nodes (none: all but lookup nodes); include, exclude: places of definitions.
    """
    named = graph.wide(graph.v.fact("subkind")).select(F.col("ticket").alias("node"), "kind", F.col("subkind").cast("string").alias("subkind"))
    nodes = joined(nodes.select("node"), named, "node", "left").where(kind_matches(F.col("kind"), F.col("subkind"), kinds)).select("node")
    complete = graph.wide(graph.v.fact("complete")).select(F.col("ticket").alias("node"), (F.col("complete").cast("string") == "definition").alias("full"))
    d = joined(joined(nodes, definitions(graph), "node"), complete, "node", "left")
    if params is not None:
        d = d.join(arity(graph).where(F.col("arity") == params).select("node"), "node", "left_semi")
    best = d.agg(F.max(F.coalesce("full", F.lit(False))).alias("any_full"))
    d = d.crossJoin(F.broadcast(best)).where(F.coalesce("full", F.lit(False)) | ~F.col("any_full"))  # one row
    places = joined(d, anchors(graph).select(F.col("anchor").alias("definition"), "file", "start"), "definition")
    places = places.where(located("file", include, True, graph.v) & ~located("file", exclude, False, graph.v))
    return places.groupBy("file", "start").agg(F.sort_array(F.collect_set("node")).alias("nodes")).orderBy("file", "start").limit(most)


def resolve_identifier(graph: Graph, identifiers: DataFrame, name: str, corpora: list[str] | None = None, languages: list[str] | None = None, **limits) -> DataFrame:
    """Links of a qualified name: its matches (canonical ones alone), resolved with the limits of resolve()."""
    matches = find(identifiers, name, corpora, languages, canonical=True)
    return resolve(graph, matches.select(F.col("ticket").alias("node")).distinct(), **limits)


def unit_info(units: DataFrame, inputs: DataFrame) -> DataFrame:
    """Totals by (corpus, language) with grand totals: units(digest, corpus, language), inputs(digest, path)."""
    n = inputs.groupBy("digest").agg(F.count("*").alias("n_inputs"))
    return units.dropDuplicates(["digest"]).join(n, "digest", "left").rollup("corpus", "language").agg(F.count("*").alias("n_units"), F.coalesce(F.sum("n_inputs"), F.lit(0)).alias("n_inputs"))


def required_inputs(inputs: DataFrame, sources: DataFrame, missing: bool = False) -> DataFrame:
    """Inputs of units that are (or aren't) among source files."""
    return inputs.join(sources.select("path").distinct(), "path", "left_anti" if missing else "left_semi")


def atomised(refs: DataFrame, kind: str = "anchor") -> DataFrame:
    """A reply's references back as (source, name, value) facts and (source, kind, target) edges in one table, without repeated rows.

    References go by anchor, in order: one states what the reference before it didn't, so no task holds more than it sorts.
    Only anchors with several places, which an assembled graph doesn't have, take a distinct.
    """
    dealt = refs.select(F.xxhash64("anchor").alias(HASH), "anchor", "start", "end", "kind", "target")
    own = Window.partitionBy(HASH, "anchor")
    place, edge = F.struct("start", "end"), F.struct("kind", "target")
    rows = dealt.withColumns({"_several": F.min(place).over(own) != F.max(place).over(own), "_first": F.row_number().over(own.orderBy("kind", "target")) == 1, "_before": F.lag(edge).over(own.orderBy("kind", "target"))})
    pair = lambda name, value: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), value.cast("string").alias("value"))
    facts = [pair("node/kind", F.lit(kind)), pair("loc/start", F.col("start")), pair("loc/end", F.col("end"))]
    edges = [pair(F.col("kind"), F.col("target"))]
    said = F.when(F.col("_first"), F.array(*facts, *edges)).when(~F.col("_before").eqNullSafe(edge), F.array(*edges))
    once = rows.where(~F.col("_several")).select("anchor", F.inline(said))
    return once.unionByName(rows.where("_several").select("anchor", F.inline(F.array(*facts, *edges))).distinct())


def references_of(graph: Graph, node: str) -> DataFrame:
    return narrow_references(graph).where(F.col("target") == node)
