"""Archives of compilation units: zip or tar files with unit records (JSON) and the files they need, named by digest."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = "archive string, digest string, corpus string, language string, target string, output string, sources array<string>, revision string"
INPUTS = "archive string, unit string, path string, digest string, corpus string"
FILES = "archive string, digest string, content binary"


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _everything(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the files of a zip, or of a tar (compressed or not)."""
    raw = io.BytesIO(bytes(content))
    if zipfile.is_zipfile(raw):
        with zipfile.ZipFile(raw) as z:
            yield from ((n, z.read(n)) for n in z.namelist() if not n.endswith("/"))
    else:
        raw.seek(0)
        with tarfile.open(fileobj=raw) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())


def _members(content: bytes, folder: str) -> Iterator[tuple[str, bytes]]:
    for name, raw in _everything(content):
        parts = name.strip("/").split("/")
        if len(parts) >= 2 and parts[-2] == folder and parts[-1]:
            yield parts[-1], raw


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content): every file of every archive, compilation units or not."""

    def decode(batches):
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                for name, raw in _everything(content):
                    yield pd.DataFrame({"archive": [archive], "name": [name], "content": [raw]})

    return _archives(spark, path).mapInPandas(decode, "archive string, name string, content binary")


#: What the clock says in every header, so that equal contents give equal archives (a fixed value).
STAMP = (1980, 1, 1, 0, 0, 0)


def archives(units: DataFrame, files: DataFrame) -> DataFrame:
    """(archive, content): zip files of units(archive, digest, record) and files(archive, content), each once, in order of names.

    record is the JSON of a unit. An archive is made by one task, so it should hold what one worker can.
    """
    own = units.select("archive", F.concat(F.lit("root/units/"), "digest").alias("name"), F.col("record").cast("binary").alias("content"))
    data = files.select("archive", F.concat(F.lit("root/files/"), F.sha2("content", 256)).alias("name"), "content")
    members = own.unionByName(data).groupBy("archive", "name").agg(F.min("content").alias("content"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows.sort_values("name").itertuples():
                z.writestr(zipfile.ZipInfo(r.name, STAMP), bytes(r.content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"archive": [rows["archive"].iloc[0]], "content": [out.getvalue()]})

    return members.groupBy("archive").applyInPandas(pack, "archive string, content binary")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """One row for each unit of each archive; an archive is a task's unit."""

    def decode(batches):
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for digest, raw in _members(content, "units"):
                    u = json.loads(raw)["unit"]
                    v = u.get("v_name", {})
                    rows.append({"archive": archive, "digest": digest, "corpus": v.get("corpus", ""), "language": v.get("language", ""), "target": v.get("signature", ""), "output": u.get("output_key", ""), "sources": u.get("source_file", []), "revision": json.loads(raw).get("revision", "")})
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNITS.split(", ")])

    return _archives(spark, path).mapInPandas(decode, UNITS)


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    def decode(batches):
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for digest, raw in _members(content, "units"):
                    for i in json.loads(raw)["unit"].get("required_input", []):
                        rows.append({"archive": archive, "unit": digest, "path": i.get("info", {}).get("path", ""), "digest": i.get("info", {}).get("digest", ""), "corpus": i.get("v_name", {}).get("corpus", "")})
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INPUTS.split(", ")])

    return _archives(spark, path).mapInPandas(decode, INPUTS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    def decode(batches):
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                for digest, raw in _members(content, "files"):
                    yield pd.DataFrame({"archive": [archive], "digest": [digest], "content": [raw]})

    return _archives(spark, path).mapInPandas(decode, FILES)


def merged(units: DataFrame, keep_first: bool = True) -> DataFrame:
    """Units of several archives, one for each digest (the one of the first archive by name)."""
    if not keep_first:
        return units
    return units.groupBy("digest").agg(F.min(F.struct(*units.columns)).alias("u")).select("u.*")


def wrong_digests(files: DataFrame) -> DataFrame:
    """Files whose content doesn't have the digest they are named by."""
    return files.where(F.sha2("content", 256) != F.col("digest"))


def find(units: DataFrame, revisions: list[str] | None = None, languages: list[str] | None = None, corpora: list[str] | None = None, targets: list[str] | None = None, sources: list[str] | None = None, outputs: list[str] | None = None) -> DataFrame:
    """Units by exact revision, language and corpus, and by regular expressions on target, sources and output; an empty list matches all."""
    out = units
    for column, allowed in (("revision", revisions), ("language", languages), ("corpus", corpora)):
        if allowed:
            out = out.where(F.col(column).isin(allowed))
    for column, wanted in (("target", targets), ("output", outputs)):
        if wanted:
            out = out.where(F.regexp_like(column, F.lit("|".join(f"(?:{w})" for w in wanted))))
    if sources:
        out = out.where(F.exists("sources", lambda s: F.regexp_like(s, F.lit("|".join(f"(?:{w})" for w in sources)))))
    return out


def by_digest_or_language(units: DataFrame, inputs: DataFrame, digests: list[str] | None = None, languages: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Units by digest or by language (one of the two), and their inputs."""
    if bool(digests) == bool(languages):
        raise ValueError("digests or languages, not both")
    kept = units.where(F.col("digest").isin(digests) if digests else F.col("language").isin(languages))
    return kept, inputs.join(kept.select(F.col("digest").alias("unit")).distinct(), "unit", "left_semi")


def revisions(units: DataFrame, pattern: str = "", corpus: str = "", since: str | None = None, until: str | None = None) -> DataFrame:
    """Revisions(revision, corpus, timestamp) by a pattern, a corpus and a span of time, both ends included."""
    out = units
    if pattern:
        out = out.where(F.regexp_like("revision", F.lit(pattern)))
    if corpus:
        out = out.where(F.col("corpus") == corpus)
    if since:
        out = out.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return out.where(F.col("timestamp") <= F.lit(until).cast("timestamp")) if until else out
