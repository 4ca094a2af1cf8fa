"""Marked source of nodes: read from their facts, resolved along their parameters and types, joined to rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marked_message, render
from .graph import Graph, joined
from .refs import callers
from .xrefs import categorised, checked


def trees(graph: Graph) -> DataFrame:
    """(node, tree): marked source as JSON text, from the stored message or else the JSON fact."""
    v = graph.v
    w = graph.wide(v.fact("code"), v.fact("code/json")).where("code is not null or json is not null")
    return w.select(F.col("ticket").alias("node"), F.coalesce(marked_message.trees("code"), F.col("json").cast("string")).alias("tree"))


def _fill(tree: Column, known: Column) -> Column:
    @F.pandas_udf("string")
    def run(tree: pd.Series, known: pd.Series) -> pd.Series:
        def one(t, k):
            if t is None or k is None:
                return t
            table: dict[str, dict[int, dict | None]] = {}
            for row in json.loads(k):
                table.setdefault(row["role"], {})[row["ordinal"]] = json.loads(row["tree"]) if row.get("tree") else None
            return json.dumps(render.filled(json.loads(t), table))

        return pd.Series([one(t, k) for t, k in zip(tree, known, strict=True)], dtype=object)

    return run(tree, known)


def resolved(graph: Graph, most: int = render.DEPTH) -> DataFrame:
    """(node, tree): trees whose lookups are filled in with those of parameters, type parameters and types.

    Each round fills nodes in with what the round before made of their neighbours, so chains of lookups are whole after as
    many rounds as they are long; it ends when no tree changes. Cycles end after `most` rounds.
    """
    raw, v = trees(graph), graph.v
    e = graph.edges.where(F.col("kind").isin(v.edge("param"), v.edge("tparam"), v.edge("typed")))
    role = F.element_at(F.split("kind", "/"), -1)
    # Only nodes whose tree looks something up are filled in; the rest keep theirs.
    asking = raw.where(F.contains("tree", F.lit("LOOKUP_BY_"))).select(F.col("node").alias("src"))
    e = checked(e.join(asking, "src", "left_semi").select("src", role.alias("role"), F.when(F.col("kind") == v.edge("typed"), 0).otherwise(F.col("ordinal")).alias("ordinal"), "dst").groupBy("src", "role", "ordinal").agg(F.min("dst").alias("dst")))
    raw = checked(raw)
    now = raw
    for _ in range(most):
        known = e.join(now.withColumnRenamed("node", "dst"), "dst", "left")
        known = known.groupBy(F.col("src").alias("node")).agg(F.to_json(F.collect_list(F.struct("role", "ordinal", "tree"))).alias("known"))  # the parameters of one node
        asked = raw.withColumn("known", F.when(F.contains("tree", F.lit("LOOKUP_BY_")), F.lit("[]")))
        new = asked.join(known.withColumnRenamed("known", "k"), "node", "left").select("node", _fill(F.col("tree"), F.coalesce("k", "known")).alias("tree"))
        new = checked(new)
        changed = new.join(now.withColumnRenamed("tree", "old"), "node").where(~F.col("tree").eqNullSafe(F.col("old"))).limit(1).count()
        now = new
        if not changed:
            break
    return now


def with_signature(rows: DataFrame, of: DataFrame, column: str, how: str = "signature") -> DataFrame:
    """rows with the rendered marked source of a column's nodes, null where there is none. of(node, tree)."""
    signed = of.select(F.col("node").alias(column), render.rendered("tree", how).alias(how))
    return joined(rows, signed, column, "left").select(*rows.columns, how)


def cross_reference_targets(graph: Graph, of: DataFrame) -> DataFrame:
    """(target, n, signature): what has cross-references, how many, and its signature."""
    return with_signature(categorised(graph).groupBy("target").agg(F.count("*").alias("n")), of, "target")


def signed_callers(graph: Graph, of: DataFrame) -> DataFrame:
    return with_signature(callers(graph), of, "caller")


def tag_fields(graph: Graph, identifier: str) -> DataFrame:
    """(node, letter, arity, parents): a tag file's fields of nodes; parents name functions, classes and enums by an identifier fact."""
    v = graph.v
    w = graph.wide(v.fact("subkind"), identifier).withColumn("subkind", F.coalesce(F.col("subkind").cast("string"), F.lit("")))
    own = w.select("ticket", "kind", "subkind", F.col(identifier.rsplit("/", 1)[-1]).cast("string").alias("identifier"))
    what = F.concat_ws("|", "kind", "subkind")
    letters = F.create_map(*(F.lit(x) for pair in {"function|": "f", "sum|enumClass": "g", "package|": "p", "record|class": "c", "variable|": "v"}.items() for x in pair))
    kinds = F.create_map(*(F.lit(x) for pair in {"function|": "function", "record|class": "class", "sum|enumClass": "enum"}.items() for x in pair))
    n_params = graph.edges.where(F.col("kind") == v.edge("param")).groupBy(F.col("src").alias("ticket")).agg(F.count("*").alias("n"))
    above = own.where("identifier <> ''").select(F.col("ticket").alias("dst"), F.concat(kinds[what], F.lit(":"), F.col("identifier")).alias("parent")).where("parent is not null")
    up = graph.edges.where(F.col("kind") == v.edge("childof")).join(above, "dst").groupBy(F.col("src").alias("ticket")).agg(F.array_join(F.sort_array(F.collect_set("parent")), "\t").alias("parents"))  # the parents of one node
    rows = own.select("ticket", letters[what].alias("letter")).join(n_params, "ticket", "left").join(up, "ticket", "left")
    return rows.select(F.col("ticket").alias("node"), "letter", F.when(F.col("letter") == "f", F.coalesce("n", F.lit(0))).alias("arity"), F.coalesce("parents", F.lit("")).alias("parents"))
