"""Metadata of generated code: rules that tie spans of a generated file to the nodes they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import REVERSE, VNAME, VOCABULARY, Vocabulary

_RULES = f"type string, meta array<struct<type: string, begin: int, end: int, edge: string, vname: {VNAME}, semantic: int>>"


def rules(files: DataFrame, text: str = "text") -> DataFrame:
    """files(file, text as JSON) -> (file, begin, end, kind, reverse, vname); malformed files and rules that do nothing give no rows."""
    parsed = files.select("file", F.explode(F.from_json(F.col(text).cast("string"), _RULES)["meta"]).alias("m"))
    known = parsed.where("m.type <> 'nop' and m.begin is not null and m.end is not null and m.begin <= m.end")
    kind = F.regexp_replace("m.edge", f"^{REVERSE}", "")
    return known.select("file", F.col("m.begin").alias("begin"), F.col("m.end").alias("end"), kind.alias("kind"), F.startswith("m.edge", F.lit(REVERSE)).alias("reverse"), F.col("m.vname").alias("vname"))


def edges(rules_: DataFrame, anchors: DataFrame, refs: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """(src, kind, dst): for each rule whose span a definition fills, an edge between the node defined there and the rule's node.

    anchors(anchor, file, start, end); refs(anchor, kind, target): defining edges.
    """
    from ..functions.edgekinds import is_variant
    from ..functions.uri import ticket

    at = rules_.join(anchors, (rules_.file == anchors.file) & (F.col("begin") == F.col("start")) & (rules_["end"] == anchors["end"])).select("anchor", rules_.kind.alias("rule_kind"), "reverse", ticket("vname", vocabulary).alias("origin"))
    d = refs.where(is_variant("kind", vocabulary.edge("defines"))).select("anchor", F.col("target").alias("node"))
    both = at.join(d, "anchor")
    return both.select(F.when(F.col("reverse"), F.col("origin")).otherwise(F.col("node")).alias("src"), F.col("rule_kind").alias("kind"), F.when(F.col("reverse"), F.col("node")).otherwise(F.col("origin")).alias("dst")).distinct()
