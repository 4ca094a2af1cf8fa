"""What an editor asks of a point of a file: where things are defined, all references, and what to show beside them.

A point is a line from 1 and a column in UTF-16 units, as editors count. It is looked up in the index of the file's lines,
so only its line is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locations, spans
from .content import documents
from .graph import Graph
from .refs import anchors, decorations, definitions, files, scopeless_references
from .signatures import with_signature


def targets(graph: Graph, file: str, line: int, column: int) -> DataFrame:
    """(target, kind, start, end) of the innermost reference around a point; several where it has several targets."""
    lines = spans.line_index(files(graph).where(F.col("file") == file), "file", "text", with_text=True).where(F.col("line_number") == line)
    at = lines.select("file", (F.col("line_start") + F.coalesce(locations.byte_of_utf16("line", F.lit(column)), F.col("line_bytes"))).alias("at"))
    around = decorations(graph, file=file).join(at, "file").where((F.col("start") <= F.col("at")) & (F.col("end") >= F.col("at")))
    inner = F.rank().over(Window.partitionBy("file").orderBy(F.col("end") - F.col("start")))  # spans around one point
    return around.withColumn("_r", inner).where("_r = 1").select("target", "kind", "start", "end").distinct()


def definition(graph: Graph, file: str, line: int, column: int) -> DataFrame:
    """(target, file, start, end): where what stands at a point is defined."""
    at = targets(graph, file, line, column).select("target").distinct()
    places = anchors(graph).select(F.col("anchor").alias("definition"), "file", "start", "end")
    return at.join(definitions(graph).withColumnRenamed("node", "target"), "target").join(places, "definition").select("target", "file", "start", "end")


def references(graph: Graph, file: str, line: int, column: int) -> DataFrame:
    """(target, kind, file, start, end): every place that refers to what stands at a point, definitions included."""
    at = targets(graph, file, line, column).select("target").distinct()
    return scopeless_references(graph).join(at, "target", "left_semi").select("target", "kind", "file", "start", "end")


def hover(graph: Graph, file: str, line: int, column: int, of: DataFrame) -> DataFrame:
    """(target, signature, text): signature and documentation of what stands at a point. of(node, tree)."""
    at = targets(graph, file, line, column).select("target").distinct()
    docs = documents(graph).select(F.col("node").alias("target"), "text")
    return with_signature(at, of, "target").join(docs, "target", "left").select("target", "signature", "text")
