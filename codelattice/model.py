"""The data model: VNames, entries, vocabulary.

A VName is five strings. An entry is a fact of a node (no edge kind, no target) or an edge between two nodes. Labels of
node kinds, facts and edges are open strings; those that operators know hang off one prefix and one URI scheme, both
parameters, so a graph with other names needs no other code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VNAME = "struct<signature: string, corpus: string, root: string, path: string, language: string>"
ENTRY = f"source {VNAME}, edge_kind string, target {VNAME}, fact_name string, fact_value binary"
FIELDS = ["signature", "corpus", "root", "path", "language"]


@dataclass(frozen=True)
class Vocabulary:
    prefix: str = "/graph"
    scheme: str = "graph"

    def fact(self, name: str) -> str:
        return f"{self.prefix}/{name}"

    def edge(self, name: str) -> str:
        return f"{self.prefix}/edge/{name}"

    @property
    def kind(self):
        return self.fact("node/kind")


VOCABULARY = Vocabulary()
#: Kinds of edges that hold a position in a file; the rest relate nodes.
ANCHOR_EDGES = ["defines", "documents", "ref", "completes"]
REVERSE = "%"


def vname(signature="", corpus="", root="", path="", language="") -> Column:
    """A VName from columns or plain strings."""
    values = [v if isinstance(v, Column) else F.lit(v) for v in (signature, corpus, root, path, language)]
    return F.struct(*(v.cast("string").alias(n) for v, n in zip(values, FIELDS, strict=True)))


def is_fact(edge_kind="edge_kind") -> Column:
    return F.col(edge_kind) == ""


def valid_entry() -> Column:
    """A fact has a name and no target; an edge has a kind, a target, and neither a fact name beyond "/" nor a value."""
    fact = (F.col("edge_kind") == "") & F.col("target").isNull() & (F.col("fact_name") != "")
    edge = (F.col("edge_kind") != "") & F.col("target").isNotNull() & F.col("fact_name").isin("", "/") & (F.coalesce(F.octet_length("fact_value"), F.lit(0)) == 0)
    return F.col("source").isNotNull() & (fact | edge)
