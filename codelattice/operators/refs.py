"""References, decorations, definitions, overrides, diagnostics, call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import edgekinds, spans
from ..functions.uri import file_ticket
from .graph import HASH, Graph, joined


def anchors(graph: Graph) -> DataFrame:
    """(anchor, file, start, end, build_config): anchors with their file's ticket. Malformed offsets leave an anchor out, and no other."""
    return _anchors(graph).drop(HASH)


def _anchors(graph: Graph) -> DataFrame:
    v = graph.v
    a = graph.wide_by_hash(v.fact("loc/start"), v.fact("loc/end"), v.fact("build/config")).where("kind = 'anchor'")
    a = a.select(HASH, F.col("ticket").alias("anchor"), file_ticket("ticket").alias("file"), F.col("start").cast("string").try_cast("int").alias("start"), F.col("end").cast("string").try_cast("int").alias("end"), F.coalesce(F.col("config").cast("string"), F.lit("")).alias("build_config"))
    return a.where("start is not null and end is not null and start >= 0 and end >= start")


def files(graph: Graph) -> DataFrame:
    return _files(graph).drop(HASH)


def _files(graph: Graph) -> DataFrame:
    v = graph.v
    return graph.wide_by_hash(v.fact("text")).where("kind = 'file'").select(HASH, F.col("ticket").alias("file"), F.coalesce("text", F.lit(b"")).alias("text"))


def scopes(graph: Graph) -> DataFrame:
    """(anchor, scope): the smallest target among an anchor's childof edges."""
    return _scopes(graph).drop(HASH)


def _scopes(graph: Graph) -> DataFrame:
    return graph.edges_by_source.where(F.col("kind") == graph.v.edge("childof")).groupBy(HASH, F.col("src").alias("anchor")).agg(F.min("dst").alias("scope"))


def narrow_references(graph: Graph) -> DataFrame:
    """References without text: (target, kind, anchor, file, start, end, build_config, scope), one for each edge of an anchor but childof.

    Anchors, their edges and their scopes are all dealt by (HASH, anchor), so each is shuffled once.
    """
    return scopeless_references(graph, True).join(_scopes(graph), [HASH, "anchor"], "left").select("target", "kind", "anchor", "file", "start", "end", "build_config", "scope")


def scopeless_references(graph: Graph, hashed: bool = False) -> DataFrame:
    """narrow_references without the scope, which takes a join of its own."""
    e = graph.edges_by_source.where(F.col("kind") != graph.v.edge("childof")).select(HASH, F.col("src").alias("anchor"), "kind", F.col("dst").alias("target"))
    rows = _anchors(graph).join(e, [HASH, "anchor"])
    return rows if hashed else rows.select("target", "kind", "anchor", "file", "start", "end", "build_config")


def references(graph: Graph) -> DataFrame:
    """narrow_references joined with their files: text, points and snippet (the whole line).

    A file's text is cut into lines once, and anchors find theirs in one sort of lines and starts by file. Only an anchor that
    runs over several lines is joined with the text itself, so a text isn't copied to every anchor.
    """
    # Stated here, as the join below would ask it of one of the two uses alone, which would then not share their shuffles.
    f = _files(graph).where("file is not null")
    lines = spans.line_index(f, [HASH, "file"], "text", with_text=True)
    found = F.struct("line_number", "line_start", "line_bytes", "line", F.max(F.col("line_start") + F.col("line_bytes")).over(Window.partitionBy(HASH, "file")).alias("size"))
    lines = lines.select(HASH, "file", F.col("line_start").alias("at"), F.lit(0).alias("own"), found.alias("found"))
    rows = narrow_references(graph).where("file is not null").withColumns({HASH: F.xxhash64("file"), "at": F.col("start").cast("long"), "own": F.lit(1)})
    w = Window.partitionBy(HASH, "file").orderBy("at", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.unionByName(rows, allowMissingColumns=True).withColumn("found", F.last("found", True).over(w)).where("own = 1 and end <= found.size")
    column = (F.col("start") - F.col("found.line_start")).cast("int")
    to = (F.col("end") - F.col("found.line_start")).cast("int")
    whole = to <= F.col("found.line_bytes")
    kept = ["target", "kind", "anchor", "file", "start", "end", "build_config", "scope"]
    placed = placed.select(*kept, F.when(whole, spans.slice_text(F.col("found.line").cast("binary"), column, to)).alias("anchor_text"), F.col("found.line_number").cast("int").alias("line"), column.alias("column"), F.col("found.line").alias("snippet"))
    long = placed.where("anchor_text is null").drop("anchor_text").join(f.drop(HASH), "file").withColumn("anchor_text", spans.slice_text("text", "start", "end"))
    return placed.where("anchor_text is not null").unionByName(long.select(placed.columns))


def decorations(graph: Graph, low: Column | int | None = None, high: Column | int | None = None, mode: str = "within", file: str | None = None, build_configs: list[str] | None = None) -> DataFrame:
    """References of files, in a span (within or around it) or anywhere; tagged edges are no decorations. An empty build config list means all."""
    r = scopeless_references(graph).where(F.col("kind") != graph.v.edge("tagged"))
    if file is not None:
        r = r.where(F.col("file") == file)
    if build_configs:
        r = r.where(F.col("build_config").isin(build_configs))
    if low is not None:
        low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
        r = r.where((spans.within if mode == "within" else spans.around)("start", "end", low, high))
    return r.select("file", "start", "end", "kind", "target", "anchor", "build_config")


def definitions(graph: Graph) -> DataFrame:
    """(node, definition): of a node's defining anchors the smallest ticket."""
    r = scopeless_references(graph).where(edgekinds.is_variant("kind", graph.v.edge("defines"))).withColumnRenamed("target", "node")
    return r.groupBy(F.xxhash64("node").alias(HASH), "node").agg(F.min("anchor").alias("definition")).drop(HASH)


def files_of_targets(graph: Graph) -> DataFrame:
    return scopeless_references(graph).select(F.col("target").alias("node"), "file").distinct()


def target_nodes(graph: Graph) -> DataFrame:
    """(file, node, kind): the nodes that a file refers to, with their kind."""
    return joined(files_of_targets(graph), graph.wide().select(F.col("ticket").alias("node"), "kind"), "node").select("file", "node", "kind")


def target_definitions(graph: Graph) -> DataFrame:
    return joined(files_of_targets(graph), definitions(graph), "node").select("file", "node", "definition")


def overrides(graph: Graph) -> DataFrame:
    """(file, overriding, overridden, kind, definition): in files that refer to the overriding node; the overridden one needs a definition."""
    v = graph.v
    kinds = [v.edge(k) for k in ("overrides", "extends", "overrides/transitive", "satisfies")]
    e = graph.edges.where(F.col("kind").isin(kinds)).select(F.col("src").alias("overriding"), "kind", F.col("dst").alias("overridden"))
    e = joined(e, definitions(graph).withColumnRenamed("node", "overridden"), "overridden")
    return joined(e, files_of_targets(graph).withColumnRenamed("node", "overriding"), "overriding").select("file", "overriding", "overridden", "kind", "definition").distinct()


def diagnostics(graph: Graph) -> DataFrame:
    """(file, start, end, message, details): diagnostics tagged on files (no span) and on anchors."""
    v = graph.v
    d = graph.wide(v.fact("message"), v.fact("details")).where("kind = 'diagnostic'").select(F.col("ticket").alias("diagnostic"), F.col("message").cast("string").alias("message"), F.col("details").cast("string").alias("details"))
    tags = graph.edges.where(F.col("kind") == v.edge("tagged")).select("src", F.col("dst").alias("diagnostic")).join(d, "diagnostic")
    none = F.lit(None).cast("int")
    whole = tags.join(graph.wide().where("kind = 'file'").select(F.col("ticket").alias("src")), "src").select(F.col("src").alias("file"), none.alias("start"), none.alias("end"), "message", "details")
    spanned = tags.join(anchors(graph).withColumnRenamed("anchor", "src"), "src").select("file", "start", "end", "message", "details")
    return whole.unionByName(spanned)


def call_edges(graph: Graph) -> DataFrame:
    """(caller, callee, n_sites): scopes of ref/call anchors and what they call."""
    r = narrow_references(graph).where((F.col("kind") == graph.v.edge("ref/call")) & F.col("scope").isNotNull())
    return r.groupBy(F.col("scope").alias("caller"), F.col("target").alias("callee")).agg(F.count("*").alias("n_sites"))


def callers(graph: Graph) -> DataFrame:
    """call_edges whose caller has a definition: (callee, caller, definition, n_sites)."""
    return joined(call_edges(graph), definitions(graph).withColumnRenamed("node", "caller"), "caller").select("callee", "caller", "definition", "n_sites")


def related_definitions(graph: Graph) -> DataFrame:
    """(node, related, definition): nodes that an edge relates, either way, where the related one has a definition."""
    pairs = graph.edges_all().where(~edgekinds.is_anchor_edge("kind", graph.v)).select(F.col("src").alias("node"), F.col("dst").alias("related")).distinct()
    return joined(pairs, definitions(graph).withColumnRenamed("node", "related"), "related").select("node", "related", "definition")


def at_point(graph: Graph, file: str, offset: int) -> DataFrame:
    """What a point of a file refers to: (start, end, kind, target, target_kind, definition), innermost spans first."""
    d = decorations(graph, offset, offset, "around", file)
    kinds = graph.wide().select(F.col("ticket").alias("target"), F.col("kind").alias("target_kind"))
    known = definitions(graph).withColumnRenamed("node", "target")
    return d.join(kinds, "target", "left").join(known, "target", "left").select("start", "end", "kind", "target", "target_kind", "definition").orderBy(F.col("end") - F.col("start"), "start", "kind", "target")


#: The letter of a node kind in tag files.
TAG_LETTERS = {"record": "c", "function": "f", "variable": "v", "package": "p", "interface": "i", "constant": "d", "macro": "d", "sum": "g", "talias": "t"}


def tags(graph: Graph) -> DataFrame:
    """(file, line, node, letter): binding definitions as a tag file has them."""
    r = scopeless_references(graph).where(F.col("kind") == graph.v.edge("defines/binding"))
    kinds = graph.wide().select(F.col("ticket").alias("target"), F.col("kind").alias("node_kind"))
    letters = F.create_map(*(F.lit(x) for pair in TAG_LETTERS.items() for x in pair))
    placed = r.join(kinds, "target").join(files(graph), "file")
    return placed.select("file", spans.point("text", "start")["line_number"].alias("line"), F.col("target").alias("node"), F.coalesce(letters[F.col("node_kind")], F.lit("?")).alias("letter"))


def path(graph: Graph, start: DataFrame, *kinds: str) -> DataFrame:
    """(start, end): nodes reached from start(ticket) along one edge of each kind in turn, % turning an edge round."""
    e = graph.edges_all()
    at = start.select(F.col("ticket").alias("start"), F.col("ticket").alias("at"))
    for k in kinds:
        step = e.where(F.col("kind") == k).select(F.col("src").alias("at"), F.col("dst").alias("next"))
        at = at.join(step, "at").select("start", F.col("next").alias("at")).distinct()
    return at.select("start", F.col("at").alias("end"))
