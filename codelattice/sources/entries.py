"""Entry streams as DataFrames: delimited files, JSON lines (plain or structured), text output, directories of files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import rewritten
from ..model import ENTRY, VNAME, VOCABULARY, Vocabulary, vname
from . import wire

_JSON = f"source {VNAME}, edge_kind string, target {VNAME}, fact_name string, fact_value string"


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Entries of delimited files. A file is a task's unit, as streams can only be read from their start."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for record in wire.records(bytes(content)):
                    rows.append(wire.decode_entry(record))
                    if len(rows) == 8192:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path).select("content")
    return files.mapInPandas(decode, ENTRY)


def encoded(entries: DataFrame) -> DataFrame:
    """(record): entries as delimited records, row by row. A name that many entries of a task have is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, labels = wire.Names(), {}

        def label(number: int, text: str | None) -> bytes:
            out = labels.get((number, text))
            if out is None:
                if len(labels) >= names.most:
                    labels.clear()
                out = labels[number, text] = wire._field(number, (text or "").encode())
            return out

        for b in batches:
            source, target = (zip(*(c.to_pylist() for c in b.column(n).flatten()), strict=True) for n in ("source", "target"))
            there = b.column("target").is_valid().to_pylist()
            rows = zip(source, b.column("edge_kind").to_pylist(), target, there, b.column("fact_name").to_pylist(), b.column("fact_value").to_pylist(), strict=True)
            out = [wire.delimited(b"".join((b"\x0a", names.encode(s), label(2, kind), b"\x1a" + names.encode(t) if has else b"", label(4, fact), wire._field(5, value or b"")))) for s, kind, t, has, fact, value in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return entries.select("source", "edge_kind", "target", "fact_name", "fact_value").mapInArrow(encode, "record binary")


def decoded(records: DataFrame) -> DataFrame:
    """The inverse of encoded."""
    blank = ("",) * len(wire.FIELDS)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = wire.Names()

        def entry(data: bytes) -> tuple:
            source, kind, target, fact, value = blank, "", None, "", b""
            for number, v in wire.fields(data):
                if number == 1:
                    source = names.decode(v)
                elif number == 2:
                    kind = v.decode()
                elif number == 3:
                    target = names.decode(v)
                elif number == 4:
                    fact = v.decode()
                elif number == 5:
                    value = v
            return source, kind, target, fact, value

        def struct(of: list) -> pa.Array:
            parts = zip(*(v or blank for v in of), strict=True)
            return pa.StructArray.from_arrays([pa.array(p, pa.string()) for p in parts], wire.FIELDS, mask=pa.array([v is None for v in of]))

        def batch(rows: list) -> pa.RecordBatch:
            source, kind, target, fact, value = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([struct(source), pa.array(kind, pa.string()), struct(target), pa.array(fact, pa.string()), pa.array(value, pa.binary())], list(wire.ENTRY_FIELDS))

        for b in batches:
            rows = []
            for blob in b.column("record").to_pylist():
                for r in wire.records(blob):
                    rows.append(entry(r))
                    if len(rows) == 8192:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return records.mapInArrow(decode, ENTRY)


def write_delimited(entries: DataFrame, path: str) -> None:
    """Delimited streams, one for each partition, by the data source of this module."""
    entries.sparkSession.dataSource.register(DelimitedSource)
    encoded(entries).write.format("delimited_entries").option("path", path).mode("append").save()


class DelimitedSource(DataSource):
    """Sink of delimited records: tasks write files of their own attempt, the commit keeps those of the attempts that succeeded."""

    @classmethod
    def name(cls):
        return "delimited_entries"

    def schema(self):
        return "record binary"

    def writer(self, schema, overwrite):
        return DelimitedWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    name: str


class DelimitedWriter(DataSourceWriter):
    def __init__(self, path: str):
        # pyarrow's file systems reach what tasks can reach: a shared folder, or a store by its URI.
        self.path = path

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        store, base = self._store()
        store.create_dir(base, recursive=True)
        c = TaskContext.get()
        name = f"part-{c.partitionId():05d}-{c.taskAttemptId()}.entries"
        with store.open_output_stream(f"{base}/_{name}") as out:
            for row in iterator:
                out.write(bytes(row.record))
        return Written(name)

    def commit(self, messages):
        store, base = self._store()
        for m in messages:
            if m is not None:
                store.move(f"{base}/_{m.name}", f"{base}/{m.name}")

    def abort(self, messages):
        store, base = self._store()
        for m in messages:
            if m is not None:
                store.delete_file(f"{base}/_{m.name}")


def _filled(v: str) -> Column:
    """A VName whose missing parts are empty."""
    return vname(*(F.coalesce(F.col(f"{v}.{f}"), F.lit("")) for f in wire.FIELDS))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with base64 values; parts that a line leaves out are empty."""
    rows = spark.read.schema(_JSON).json(path)
    return rows.select(_filled("source").alias("source"), F.coalesce("edge_kind", F.lit("")).alias("edge_kind"), F.when(F.col("target").isNotNull(), _filled("target")).alias("target"), F.coalesce("fact_name", F.lit("")).alias("fact_name"), F.coalesce(F.unbase64("fact_value"), F.lit(b"")).alias("fact_value"))


def to_json(entries: DataFrame) -> DataFrame:
    """(value): JSON lines, empty parts left out."""
    short = lambda v: F.struct(*(F.nullif(F.col(f"{v}.{f}"), F.lit("")).alias(f) for f in wire.FIELDS))
    value = F.when(F.octet_length("fact_value") > 0, F.base64("fact_value"))
    return entries.select(F.to_json(F.struct(short("source").alias("source"), F.nullif("edge_kind", F.lit("")).alias("edge_kind"), F.when(F.col("target").isNotNull(), short("target")).alias("target"), F.nullif("fact_name", F.lit("")).alias("fact_name"), value.alias("fact_value"))).alias("value"))


def structured_json(entries: DataFrame, decode_code: Column, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """(value): JSON lines in which the marked source fact is an object, as decode_code makes of fact_value; other values are text."""
    value = F.when(F.col("fact_name") == vocabulary.fact("code"), decode_code).otherwise(F.to_json(F.struct(F.col("fact_value").cast("string").alias("text"))))
    return entries.select(F.to_json(F.struct("source", "edge_kind", "target", "fact_name", F.parse_json(value).alias("fact_value"))).alias("value"))


def textproto(entries: DataFrame) -> DataFrame:
    """(value): one line of text format for each entry."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    part = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), q(c)))
    name = lambda v: F.concat_ws(" ", *(part(f, F.col(f"{v}.{f}")) for f in wire.FIELDS))
    source = F.concat(F.lit("source { "), name("source"), F.lit(" }"))
    target = F.when(F.col("target").isNotNull(), F.concat(F.lit("target { "), name("target"), F.lit(" }")))
    return entries.select(F.concat_ws(" ", source, part("edge_kind", F.col("edge_kind")), target, part("fact_name", F.col("fact_name")), part("fact_value", F.col("fact_value").cast("string"))).alias("value"))


def files_to_entries(spark: SparkSession, path: str, rules: list[dict] | None = None, corpus: str = "", vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """A directory tree as file nodes: path rewritten by rules, text, encoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.col("path"), "^.*?" + path.rstrip("/").replace(".", r"\.") + "/", "")
    named = files.select(rewritten(rel, rules or [], {"corpus": corpus}).alias("v"), "content")
    source = vname("", F.col("v.corpus"), F.col("v.root"), F.col("v.path"), "")
    pairs = F.array(F.struct(F.lit(vocabulary.kind).alias("n"), F.lit(b"file").alias("v")), F.struct(F.lit(vocabulary.fact("text")).alias("n"), F.col("content").alias("v")), F.struct(F.lit(vocabulary.fact("text/encoding")).alias("n"), F.lit(b"UTF-8").alias("v")))
    rows = named.select(source.alias("source"), F.explode(pairs).alias("f"))
    return rows.select("source", F.lit("").alias("edge_kind"), F.lit(None).cast(VNAME).alias("target"), F.col("f.n").alias("fact_name"), F.col("f.v").alias("fact_value"))
