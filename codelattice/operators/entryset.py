"""Entry sets in canonical form: every string once, numbered in order, entries as rows of numbers; shards by ranges of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIELDS
from .xrefs import checked

_ROW_BITS = 33  # monotonically_increasing_id counts rows of a partition in these


def numbered(df: DataFrame, column: str, number: str = "id") -> DataFrame:
    """df(column, ...) without repeated values, sorted by a column, with dense numbers from 0 in that order.

    Ranges of the column are sorted apart; a range starts where the counts of those before it end. The sorted rows are
    kept (in the checkpoint folder where there is one) between counting and numbering, so both see the same ranges.
    """
    kept = checked(df.orderBy(column).withColumn("_at", F.monotonically_increasing_id()))
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        kept = kept.persist()
    part = F.shiftright("_at", _ROW_BITS)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row for each partition
    first, before = [], 0
    for r in counts:
        first.append((r["_part"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(first, "_part long, _first long")
    rows = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row for each partition
    return rows.select(*df.columns, (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias(number))


def encoded(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols(id, text), rows(source, edge_kind, target, fact_name, fact_value)): names are arrays of numbers, texts numbers.

    Equal sets give equal tables, whatever order and repetitions their entries come in. Values stay bytes.
    A text that most entries have is a hot key of the join with the symbols, whose rows AQE splits.
    """
    e = entries.distinct()
    texts = [F.col(f"{n}.{f}") for n in ("source", "target") for f in FIELDS] + [F.col("edge_kind"), F.col("fact_name")]
    symbols = numbered(e.select(F.explode(F.array(*texts)).alias("text")).where("text is not null").distinct(), "text").select("id", "text")
    rows = e.withColumn("_row", F.struct(*e.columns))
    # One join of (entry, place of the text) pairs with the symbols, not one for each of the twelve texts.
    places = F.array(*(F.struct(F.lit(i).alias("i"), t.alias("text")) for i, t in enumerate(texts)))
    pairs = rows.select("_row", F.explode(places).alias("p")).join(symbols.withColumn("p_text", F.col("text")), F.col("p.text") == F.col("p_text"), "left")
    ids = pairs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("p.i", "id"))).alias("ids"))  # twelve
    n = len(FIELDS)
    name = lambda at: F.array(*(F.col("ids")[F.lit(at + i)] for i in range(n)))
    target = F.when(F.col("_row.target").isNotNull(), name(n))
    return symbols, ids.select(name(0).alias("source"), F.col("ids")[F.lit(2 * n)].alias("edge_kind"), target.alias("target"), F.col("ids")[F.lit(2 * n + 1)].alias("fact_name"), F.col("_row.fact_value").alias("fact_value"))


def decoded(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """The entries of an encoded set."""
    numbers = F.concat("source", F.array("edge_kind", "fact_name"), F.coalesce("target", F.array().cast("array<bigint>")))
    pairs = rows.select(F.struct(*rows.columns).alias("_row"), F.posexplode(numbers).alias("i", "id")).join(symbols, "id", "left")
    texts = pairs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("i", "text"))).alias("t"))  # twelve at most
    n = len(FIELDS)
    name = lambda at: F.struct(*(F.col("t")[F.lit(at + i)].alias(f) for i, f in enumerate(FIELDS)))
    return texts.select(name(0).alias("source"), F.col("t")[F.lit(n)].alias("edge_kind"), F.when(F.col("_row.target").isNotNull(), name(n + 2)).alias("target"), F.col("t")[F.lit(n + 1)].alias("fact_name"), F.col("_row.fact_value").alias("fact_value"))


def shard_bounds(keyed: DataFrame, shards: int, sample: int = 200) -> list[str]:
    """Keys that part keyed(key, weight) into about equally heavy ranges: quantiles of a sample in which a key's chance follows its weight.

    The sample has `shards * sample` keys at most, drawn by a hash of the key, so it is the same each time.
    """
    one = keyed.groupBy("key").agg(F.sum("weight").cast("double").alias("weight")).where("weight > 0")
    u = (F.pmod(F.xxhash64("key"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    drawn = one.select("key", (F.log(u) / F.col("weight")).alias("chance")).orderBy(F.desc("chance"), "key").limit(shards * sample)
    keys = sorted(r["key"] for r in drawn.collect())
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []


def shard_of(key: Column, bounds: list[str]) -> Column:
    """The number of the range that a key falls into, from 0."""
    return reduce(lambda a, b: a + b, ((key >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
