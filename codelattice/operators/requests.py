"""What a request switches, filters, bounds and pages, over assembled rows."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uri import parse_ticket
from ..model import VOCABULARY, Vocabulary
from .graph import HASH, Graph, joined
from .refs import definitions, narrow_references, scopeless_references


class TooManyTickets(ValueError):
    pass


def bounded(tickets: list[str], most: int) -> list[str]:
    """The tickets of a request, or an error where there are none or more than `most`."""
    if not tickets:
        raise ValueError("no tickets specified")
    if len(tickets) > most:
        raise TooManyTickets(f"{len(tickets)} tickets, at most {most} allowed")
    return tickets


def token(position: int) -> str:
    """An opaque page token."""
    return base64.urlsafe_b64encode(json.dumps({"at": position}).encode()).decode()


def position(page_token: str | int | None) -> int:
    """The position that a page token stands for; none is the start, a broken one an error."""
    if not page_token:
        return 0
    if isinstance(page_token, int):
        return page_token
    try:
        at = json.loads(base64.urlsafe_b64decode(page_token))["at"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"invalid page token: {page_token!r}") from e
    if not isinstance(at, int) or at < 0:
        raise ValueError(f"invalid page token: {page_token!r}")
    return at


def kind_matches(kind: Column, subkind: Column, kinds: list[str] | None) -> Column:
    """Whether a node's kind, or kind/subkind, is asked for; without a request all but lookup nodes are."""
    if not kinds:
        return F.coalesce(kind, F.lit("")) != "lookup"
    key = F.when(F.coalesce(subkind, F.lit("")) != "", F.concat_ws("/", kind, subkind)).otherwise(kind)
    return F.coalesce(kind.isin(kinds) | key.isin(kinds), F.lit(False))


def located(ticket: Column | str, places: list[dict] | None, default: bool, v: Vocabulary = VOCABULARY) -> Column:
    """Whether a ticket lies at any of some places (path and root: regular expressions, both found; corpus: one that any place names)."""
    if not places:
        return F.lit(default)
    name = parse_ticket(ticket, v)
    corpora = [p["corpus"] for p in places if p.get("corpus")]
    hit = F.lit(False)
    for p in places:
        one = F.lit(True)
        for field in ("path", "root"):
            if p.get(field):
                one = one & F.regexp_like(name[field], F.lit(p[field]))
        hit = hit | one
    return F.coalesce(hit & (name["corpus"].isin(corpora) if corpora else F.lit(True)), F.lit(False))


def without_text(facts: DataFrame, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Facts as they are embedded in replies: without texts and their encodings."""
    return facts.where(~F.col("name").isin(v.fact("text"), v.fact("text/encoding")))


def present_files(graph: Graph, missing: bool = False) -> DataFrame:
    """(file): files with a text; with `missing` the others too."""
    f = graph.wide(graph.v.fact("text")).where("kind = 'file'")
    return (f if missing else f.where("text is not null")).select(F.col("ticket").alias("file"))


def decorations_reply(graph: Graph, targets: bool = False, scope: bool = False) -> DataFrame:
    """(file, start, end, kind, target, target_definition, scope): decorations with what a request asks for, nulls for the rest."""
    r = (narrow_references if scope else scopeless_references)(graph).where(F.col("kind") != graph.v.edge("tagged"))
    none = F.lit(None).cast("string")
    r = joined(r, definitions(graph).withColumnRenamed("node", "target"), "target", "left") if targets else r.withColumn("definition", none)
    return r.select("file", "start", "end", "kind", "target", F.col("definition").alias("target_definition"), (F.col("scope") if scope else none).alias("scope"))


def relabelled(rows: DataFrame, labels: dict[str, str], column: str = "kind") -> DataFrame:
    """Rows whose edge kinds are rewritten as a request's mapping says, reverse kinds alike; others stay."""
    out = F.col(column)
    bare = F.regexp_replace(out, "^%", "")
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else F.create_map().cast("map<string,string>")
    new = table[bare]
    return rows.withColumn(column, F.when(new.isNull(), out).when(F.startswith(out, F.lit("%")), F.concat(F.lit("%"), new)).otherwise(new))


def with_revisions(rows: DataFrame, file_info: DataFrame, column: str = "file", v: Vocabulary = VOCABULARY) -> DataFrame:
    """Rows with the revision of their file, null where none is known. file_info(corpus, root, path, revision)."""
    info = file_info.groupBy("corpus", "root", "path").agg(F.max("revision").alias("revision"))
    named = rows.withColumn("_n", parse_ticket(column, v))
    on = (F.col("_n.corpus") == F.col("i.corpus")) & (F.col("_n.root") == F.col("i.root")) & (F.col("_n.path") == F.col("i.path"))
    return named.join(info.alias("i"), on, "left").select(*rows.columns, F.col("i.revision").alias("revision"))


def paged_sets(edges: DataFrame, most: int) -> DataFrame:
    """edges(src, kind, ordinal, dst) -> the same with page_key: a source's groups by kind, each cut into pages of at most `most`.

    Pages of a source are numbered through, group after group; the key is the source's ticket and the number in ten digits.
    Edges are shuffled once, by source, and sorted once: a page begins at every `most`-th row of a group, and its number is
    how many began before.
    """
    dealt = edges.repartition("src").withColumn(HASH, F.xxhash64("src"))
    rank = F.row_number().over(Window.partitionBy(HASH, "src", "kind").orderBy("ordinal", "dst")) - 1
    begun = F.sum((F.col("_rank") % most == 0).cast("long")).over(Window.partitionBy(HASH, "src").orderBy("kind", "ordinal", "dst").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    paged = dealt.withColumn("_rank", rank).withColumn("_page", begun - 1)
    return paged.withColumn("page_key", F.concat(F.col("src"), F.lit("."), F.lpad(F.col("_page").cast("string"), 10, "0"))).drop(HASH, "_rank", "_page")


def of_pages(paged: DataFrame, keys: DataFrame | None) -> DataFrame:
    """The rows of some pages, keys(page_key); None is all."""
    return paged if keys is None else paged.join(keys.select("page_key").distinct(), "page_key", "left_semi")
