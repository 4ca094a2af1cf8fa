"""Serving tables: the assembled graph written once, clustered by the column that its queries ask by.

Every table is dealt by ranges of its key and sorted within its files, so that Parquet statistics let a point query read
the row groups of its key alone. Queries are plain filters on stored columns, which Catalyst pushes into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import edgekinds, spans
from ..model import VOCABULARY, Vocabulary
from ..operators import content, refs, xrefs
from ..operators.graph import Graph, by_globs

#: Table -> the columns it is clustered by.
CLUSTER = {"facts": ["ticket", "name"], "edges": ["src", "kind", "ordinal", "dst"], "decorations": ["file", "start", "end"], "xrefs": ["target", "category", "kind", "file", "start"], "definitions": ["node"], "callers": ["callee", "caller"], "documents": ["node"], "directories": ["corpus", "root", "directory", "name"]}


def tables(graph: Graph) -> dict[str, DataFrame]:
    return {
        "facts": graph.facts.select("ticket", "name", "value"),
        "edges": graph.edges_all(),
        "decorations": refs.decorations(graph),
        "xrefs": xrefs.categorised(graph).select("target", "category", "kind", "file", "start", "end", "anchor", "scope", "build_config"),
        "definitions": refs.definitions(graph),
        "callers": refs.callers(graph),
        "documents": content.documents(graph),
        "directories": content.directories(graph),
    }


def write(graph: Graph, path: str, only: list[str] | None = None, parts: int | None = None) -> None:
    """Writes the tables (or some); parts: files of each, else as many as the session shuffles to."""
    for name, df in tables(graph).items():
        if only is None or name in only:
            keys = CLUSTER[name]
            dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
            dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")


class Tables:
    """Queries over serving tables."""

    def __init__(self, spark: SparkSession, path: str, vocabulary: Vocabulary = VOCABULARY):
        self.spark, self.path, self.v = spark, path, vocabulary

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def nodes(self, tickets: list[str], globs: list[str] | None = None) -> DataFrame:
        """(ticket, facts): facts as a map; a node without a matching fact is left out."""
        f = self.table("facts").where(F.col("ticket").isin(tickets))
        f = f.where(by_globs("name", globs)) if globs else f
        return f.groupBy("ticket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("facts"))  # the facts of one node

    def edges(self, tickets: list[str], kinds: list[str] | None = None, page_size: int = 2048, page_token: int = 0) -> DataFrame:
        e = self.table("edges").where(F.col("src").isin(tickets))
        e = e.where(F.col("kind").isin(kinds)) if kinds else e
        return e.orderBy("src", edgekinds.display_rank("kind", self.v), "kind", "ordinal", "dst").offset(page_token).limit(page_size)

    def decorations(self, file: str, low: int | None = None, high: int | None = None, mode: str = "within") -> DataFrame:
        d = self.table("decorations").where(F.col("file") == file)
        if low is not None:
            d = d.where((spans.within if mode == "within" else spans.around)("start", "end", F.lit(low), F.lit(high)))
        return d.orderBy("start", "end", "kind", "target")

    def cross_references(self, tickets: list[str], categories: list[str] | None = None, filters: list[dict] | None = None, page_size: int = 2048, page_token: int = 0) -> DataFrame:
        r = self.table("xrefs").where(F.col("target").isin(tickets))
        r = r.where(F.col("category").isin(categories)) if categories else r
        r = r.where(xrefs.path_filter("file", filters, self.v)) if filters else r
        return xrefs.page(r, page_size, page_token)

    def callers(self, tickets: list[str]) -> DataFrame:
        return self.table("callers").where(F.col("callee").isin(tickets))

    def documentation(self, tickets: list[str]) -> DataFrame:
        return self.table("documents").where(F.col("node").isin(tickets))

    def directory(self, corpus: str, root: str = "", path: str = "") -> DataFrame:
        return self.table("directories").where((F.col("corpus") == corpus) & (F.col("root") == root) & (F.col("directory") == path)).select("name", "kind")
