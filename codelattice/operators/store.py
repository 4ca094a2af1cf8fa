"""The graph store: a set of entries in Parquet, clustered by source, with reads, scans, shards, merges and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uri import ticket
from ..model import VOCABULARY, Vocabulary, valid_entry

KEY = ["source", "edge_kind", "fact_name", "target"]


def read(entries: DataFrame, source: Column, kind: str = "") -> DataFrame:
    """Entries of one source: its facts (kind ""), everything ("*"), or its edges of one kind. Equality on the struct's fields reaches the scan."""
    own = entries.where(reduce(lambda a, b: a & b, (F.col(f"source.{f}") == source[f] for f in ("signature", "corpus", "root", "path", "language"))))
    return own if kind == "*" else own.where(F.col("edge_kind") == kind)


def scan(entries: DataFrame, target: Column | None = None, kind: str = "", fact_prefix: str = "") -> DataFrame:
    """Entries with a target, an edge kind and a fact name prefix; what is left open matches everything."""
    out = entries
    if target is not None:
        out = out.where(reduce(lambda a, b: a & b, (F.col(f"target.{f}") == target[f] for f in ("signature", "corpus", "root", "path", "language"))))
    if kind:
        out = out.where(F.col("edge_kind") == kind)
    return out.where(F.startswith("fact_name", F.lit(fact_prefix))) if fact_prefix else out


def shard_of(n: int) -> Column:
    """Shard of an entry: entries of one source and kind stay together."""
    return F.pmod(F.xxhash64("source", "edge_kind"), F.lit(n)).cast("int")


def shard(entries: DataFrame, index: int, n: int) -> DataFrame:
    return entries.where(shard_of(n) == index)


def merged(*stores: DataFrame) -> DataFrame:
    """Union of stores as sets."""
    return reduce(DataFrame.unionByName, stores).distinct()


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both; where a key is in both, the new value stands. A write that repeats a key in itself keeps its largest value."""
    key = [F.col(k) for k in KEY]
    both = old.select("*", F.lit(0).alias("_age")).unionByName(new.select("*", F.lit(1).alias("_age")))
    return both.groupBy(*key).agg(F.max(F.struct("_age", "fact_value"))["fact_value"].alias("fact_value")).select(old.columns)


def first_of_key(entries: DataFrame) -> DataFrame:
    """One entry for each key, whatever its value: the smallest value stays."""
    return entries.groupBy(*KEY).agg(F.min("fact_value").alias("fact_value")).select(entries.columns)


def invalid(entries: DataFrame) -> DataFrame:
    return entries.where(~F.coalesce(valid_entry(), F.lit(False)))


def ordered(entries: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """Store order: source, edge kind, fact name, target."""
    return entries.orderBy(*KEY)


def clustered(entries: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes a store: dealt by ranges of the source and sorted within, so reads of a source prune by file statistics."""
    dealt = entries.repartitionByRange(parts, "source", "edge_kind") if parts else entries.repartitionByRange("source", "edge_kind")
    dealt.sortWithinPartitions(*KEY).write.mode("overwrite").parquet(path)


def counts_by_kind(entries: DataFrame) -> DataFrame:
    return entries.groupBy("edge_kind").agg(F.count("*").alias("n"))


def stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.countDistinct("source").alias("sources"), F.countDistinct("fact_name").alias("fact_names"), F.countDistinct("edge_kind").alias("edge_kinds"))


def aggregated(entries: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """(source, edge_kind, target, properties): one row for each node or edge, its facts as a map in order of their names."""
    rows = first_of_key(entries).select(ticket("source", vocabulary).alias("source"), "edge_kind", ticket("target", vocabulary).alias("target"), "fact_name", "fact_value")
    pairs = F.array_sort(F.collect_list(F.struct("fact_name", "fact_value")))
    return rows.groupBy("source", "edge_kind", "target").agg(F.map_from_entries(pairs).alias("properties"))


def triples(entries: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """(subject, predicate, object) quoted for N-Triples; reverse edges are left out, marked source goes as base64."""
    code = vocabulary.fact("code")
    value = F.when(F.col("fact_name") == code, F.base64("fact_value")).otherwise(F.col("fact_value").cast("string"))
    predicate = F.when(F.col("edge_kind") != "", F.col("edge_kind")).otherwise(F.col("fact_name"))
    rows = entries.where(~F.startswith("edge_kind", F.lit("%"))).distinct()
    plain = lambda text: F.concat(F.lit('"'), text, F.lit('"'))  # noqa: E731  tickets have nothing to escape
    return rows.select(plain(ticket("source", vocabulary)).alias("subject"), quoted(predicate).alias("predicate"), F.when(F.col("edge_kind") != "", plain(ticket("target", vocabulary))).otherwise(quoted(value)).alias("object"))


def quoted(text: Column) -> Column:
    """A string literal of N-Triples."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def numbered(entries: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Adjacent-duplicate removal in store order, as a window: rows that repeat the key before them go."""
    w = Window.partitionBy(*(key or KEY)).orderBy("fact_value")
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: What entry keys begin with, and what parts their fields and the fields of a VName.
KEY_PREFIX, KEY_SEPARATOR, NAME_SEPARATOR = "entry:", "\n", "\x00"
_NAME = ("signature", "corpus", "root", "path", "language")


def _name_text(v: Column) -> Column:
    return F.when(v.isNull(), "").otherwise(F.concat_ws(NAME_SEPARATOR, *(v[f] for f in _NAME)))


def entry_key(source: str = "source", edge_kind: str = "edge_kind", fact_name: str = "fact_name", target: str = "target") -> Column:
    """The key of an entry as text; null where a field holds the separator, or one of edge kind and target is missing."""
    fields = [_name_text(F.col(source)), F.col(edge_kind), F.col(fact_name), _name_text(F.col(target))]
    clean = F.lit(True)
    for f in fields:
        clean = clean & ~F.contains(f, F.lit(KEY_SEPARATOR))
    whole = F.col(source).isNotNull() & ((F.col(edge_kind) == "") == F.col(target).isNull())
    return F.when(clean & whole, F.concat(F.lit(KEY_PREFIX), F.concat_ws(KEY_SEPARATOR, *fields)))


def key_prefix(source: Column, edge_kind: str = "*") -> Column:
    """What the keys of a source begin with, those of one edge kind or ("*") all."""
    start = F.concat(F.lit(KEY_PREFIX), _name_text(source), F.lit(KEY_SEPARATOR))
    return start if edge_kind == "*" else F.concat(start, F.lit(edge_kind + KEY_SEPARATOR))


def parsed_key(key: Column) -> Column:
    """A key as struct(source, edge_kind, fact_name, target); null where it is none."""
    parts = F.split(F.substring(key, F.lit(len(KEY_PREFIX) + 1), F.length(key)), KEY_SEPARATOR, -1)

    def name(text: Column) -> Column:
        fields = F.split(text, NAME_SEPARATOR, -1)
        return F.when(text != "", F.struct(*(F.get(fields, F.lit(i)).alias(f) for i, f in enumerate(_NAME))))

    found = F.struct(name(F.get(parts, F.lit(0))).alias("source"), F.get(parts, F.lit(1)).alias("edge_kind"), F.get(parts, F.lit(2)).alias("fact_name"), name(F.get(parts, F.lit(3))).alias("target"))
    return F.when(F.startswith(key, F.lit(KEY_PREFIX)) & (F.size(parts) == 4), found)


def keyed_range(keyed: DataFrame, low: Column | str | None = None, high: Column | str | None = None, prefix: Column | str | None = None) -> DataFrame:
    """Rows of keyed(key, ...) in [low, high) or under a prefix: comparisons of the stored key, which reach the scan."""
    out = keyed
    for bound, test in ((low, lambda k, b: k >= b), (high, lambda k, b: k < b), (prefix, F.startswith)):
        if bound is not None:
            out = out.where(test(F.col("key"), bound if isinstance(bound, Column) else F.lit(bound)))
    return out


def ordered_key(*columns: Column, kinds: list[str]) -> Column:
    """Columns as one hexadecimal text that sorts as they do, one after another. kinds: string or long, for each column; no nulls."""
    out = []
    for c, kind in zip(columns, kinds, strict=True):
        if kind == "string":  # a zero byte is escaped, and what ends a string sorts before it
            pairs = F.regexp_replace(F.hex(c.cast("binary")), "(..)", "$1,")
            out.append(F.concat(F.replace(F.replace(pairs, F.lit("00,"), F.lit("00FF")), F.lit(",")), F.lit("0001")))
        else:  # two's complement with the sign turned round
            out.append(F.lpad(F.hex(F.bitwise_not(c.cast("long").bitwiseXOR(F.lit(2**63 - 1)))), 16, "0"))
    return F.concat(*out)


def batches(entries: DataFrame, most: int) -> DataFrame:
    """entries with batch: entries of one source in batches of at most `most`, numbered from 0 within the source."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("edge_kind", "fact_name", "target", "fact_value")) - 1
    return entries.withColumn("batch", F.floor(rank / most))


def corpora(entries: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(corpus, n_sources, ok) over the sources of entries, those in language usr left out; not ok: no corpus, or one that isn't allowed."""
    sources = entries.where(F.col("source.language") != "usr").select("source").distinct()
    ok = (F.col("corpus") != "") & (F.col("corpus").isin(allowed) if allowed else F.lit(True))
    return sources.groupBy(F.col("source.corpus").alias("corpus")).agg(F.count("*").alias("n_sources")).withColumn("ok", ok)
