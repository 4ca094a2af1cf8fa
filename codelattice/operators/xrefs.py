"""Cross-references: categories of references, filters, totals, pages, merged nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edgekinds
from ..functions.uri import parse_ticket
from ..model import VOCABULARY, Vocabulary
from .graph import Graph, joined
from .refs import definitions, narrow_references
from .requests import position


def is_declaration(kind: Column, complete: Column | None = None, v: Vocabulary = VOCABULARY) -> Column:
    """A declaring reference, or a definition of a node that is incomplete."""
    incomplete = F.coalesce(complete == "incomplete", F.lit(False)) if complete is not None else F.lit(False)
    kind = canonical(kind)
    return (kind == "#internal/ref/declare") | (incomplete & edgekinds.is_variant(kind, v.edge("defines")))


def is_definition(kind: Column, which: str = "ALL", complete: Column | None = None, v: Vocabulary = VOCABULARY) -> Column:
    """which: NONE, ALL, FULL (defines alone) or BINDING. What is a declaration is no definition."""
    kind = canonical(kind)
    found = {"NONE": F.lit(False), "ALL": edgekinds.is_variant(kind, v.edge("defines")), "FULL": kind == v.edge("defines"), "BINDING": kind == v.edge("defines/binding")}[which]
    return found & ~is_declaration(kind, complete, v)


def canonical(kind: Column) -> Column:
    """The kind without the mark of a reverse edge."""
    return F.regexp_replace(kind, "^%", "")


def is_reference(kind: Column, which: str = "ALL", v: Vocabulary = VOCABULARY) -> Column:
    """which: NONE, ALL (variants of ref), CALL or NON_CALL. NON_CALL takes references that aren't calls, and what provides."""
    kind = canonical(kind)
    ref, call = edgekinds.is_variant(kind, v.edge("ref")), edgekinds.is_variant(kind, v.edge("ref/call"))
    return {"NONE": F.lit(False), "ALL": ref, "CALL": call, "NON_CALL": (~call & ref) | (kind == v.edge("provides"))}[which]


#: Kinds of groups that serving data has beside edge kinds.
INTERNAL = "#internal/"
DIRECT, OVERRIDE = f"{INTERNAL}ref/call/direct", f"{INTERNAL}ref/call/override"


def is_caller(kind: Column, which: str = "DIRECT") -> Column:
    """which: NONE, DIRECT or OVERRIDE, which includes direct callers. Callers stand in groups of internal kinds."""
    kind = canonical(kind)
    return {"NONE": F.lit(False), "DIRECT": kind == DIRECT, "OVERRIDE": kind.isin(DIRECT, OVERRIDE)}[which]


def is_speculative(kind: Column) -> Column:
    return F.endswith(kind, F.lit("/thunk")) | (kind == OVERRIDE)


def is_related(kind: Column, requested: list[str] | None = None, v: Vocabulary = VOCABULARY) -> Column:
    """Edges between nodes, both ways, that are no internal kinds and no anchors' edges, of the kinds asked for."""
    out = ~F.startswith(kind, F.lit(INTERNAL)) & ~edgekinds.is_anchor_edge(kind, v)
    return out & kind.isin(requested) if requested else out


def category(kind: Column, complete: Column | None = None, v: Vocabulary = VOCABULARY) -> Column:
    return F.when(is_declaration(kind, complete, v), "declaration").when(is_definition(kind, "ALL", complete, v), "definition").when(is_reference(kind, "ALL", v), "reference")


def categorised(graph: Graph) -> DataFrame:
    """narrow_references with a category; what has none isn't a cross-reference."""
    complete = graph.wide(graph.v.fact("complete")).select(F.col("ticket").alias("target"), F.col("complete").cast("string").alias("complete"))
    r = joined(narrow_references(graph), complete, "target", "left")
    return r.withColumn("category", category(F.col("kind"), F.col("complete"), graph.v)).where("category is not null")


def totals(refs: DataFrame) -> DataFrame:
    """(target, category, kind, total)."""
    return refs.groupBy("target", "category", "kind").agg(F.count("*").alias("total"))


def path_filter(ticket_column: str, filters: list[dict], v: Vocabulary = VOCABULARY) -> Column:
    """Conjunction of filters on a ticket's corpus, root and path.

    A filter: corpus, root, path (regular expressions, all of which must be found), type INCLUDE_ONLY (default) or EXCLUDE,
    corpus_specific (the filter only speaks about tickets of its corpus).
    """
    name, out = parse_ticket(ticket_column, v), F.lit(True)
    for f in filters:
        hit = F.lit(True)
        for field in ("corpus", "root", "path"):
            if f.get(field):
                hit = hit & F.regexp_like(name[field], F.lit(f[field]))
        allow = ~hit if f.get("type") == "EXCLUDE" else hit
        if f.get("corpus_specific"):
            allow = allow | (name["corpus"] != f["corpus_specific"])
        out = out & F.coalesce(allow, F.lit(False))
    return out


def filtered_totals(refs: DataFrame, filters: list[dict], v: Vocabulary = VOCABULARY) -> DataFrame:
    """(target, category, total, filtered): what the filters leave and what they take, zeros included."""
    keep = path_filter("file", filters, v)
    return refs.groupBy("target", "category").agg(F.count_if(keep).alias("total"), F.count_if(~keep).alias("filtered"))


def page(refs: DataFrame, page_size: int = 2048, page_token: int | str = 0) -> DataFrame:
    """One page of each target's references in the order of category, kind, file, start, anchor. At most 10000 rows a page.

    The filter on the row number comes first, so that Spark keeps no more rows of a target than the page's end before it sorts.
    """
    size, start = min(page_size, 10_000), position(page_token)
    w = Window.partitionBy("target").orderBy("category", "kind", "file", "start", "anchor", "end")
    upto = refs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= start + size)
    return upto.withColumn("position", F.col("position") - 1).where(F.col("position") >= start)


def merged(graph: Graph, kinds: list[str], most: int = 64) -> DataFrame:
    """(node, root): nodes that reach others along some kinds merge; the root is the smallest node reached, itself included.

    Pointer jumping doubles the distance each round, so `most` rounds reach any chain; a cycle takes its smallest member.
    """
    up = graph.edges.where(F.col("kind").isin(kinds)).select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    reach = checked(up)
    n = reach.count()
    for _ in range(most):
        longer = checked(reach.unionByName(reach.alias("a").join(reach.alias("b"), F.col("a.to") == F.col("b.node")).select("a.node", "b.to")).distinct())
        m = longer.count()
        reach, stop = longer, m == n
        n = m
        if stop:
            break
    return reach.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root"))


def checked(df: DataFrame) -> DataFrame:
    """Cuts the lineage where the session has a checkpoint folder; plain otherwise."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        return df
    return df.checkpoint()


def caller_totals(calls: DataFrame, filters: list[dict], v: Vocabulary = VOCABULARY) -> DataFrame:
    """(target, total, filtered): callers that the filters leave and take, by the anchors of their definitions. calls(callee, caller, definition, ...)."""
    keep = path_filter("definition", filters, v)
    one = calls.groupBy(F.col("callee").alias("target"), "caller").agg(F.min("definition").alias("definition"))
    return one.groupBy("target").agg(F.count_if(keep).alias("total"), F.count_if(~keep).alias("filtered"))


def related_totals(graph: Graph, filters: list[dict], kinds: list[str] | None = None) -> DataFrame:
    """(node, kind, total, filtered): related nodes that the filters leave and take, by their definition or else their own ticket."""
    e = graph.edges_all().where(is_related(F.col("kind"), kinds, graph.v)).select(F.col("src").alias("node"), "kind", F.col("dst").alias("related")).distinct()
    rows = joined(e, definitions(graph).withColumnRenamed("node", "related"), "related", "left").withColumn("at", F.coalesce("definition", "related"))
    keep = path_filter("at", filters, graph.v)
    return rows.groupBy("node", "kind").agg(F.count_if(keep).alias("total"), F.count_if(~keep).alias("filtered"))


def scope_totals(refs: DataFrame, filters: list[dict], v: Vocabulary = VOCABULARY) -> DataFrame:
    """(target, scope, total, filtered): references by the scope that they stand in; null for those in none."""
    keep = path_filter("file", filters, v)
    return refs.where("category = 'reference'").groupBy("target", "scope").agg(F.count_if(keep).alias("total"), F.count_if(~keep).alias("filtered"))
