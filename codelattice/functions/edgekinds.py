"""The algebra of edge kinds: direction, ordinals, variants, display order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ANCHOR_EDGES, REVERSE, VOCABULARY, Vocabulary


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def is_reverse(kind) -> Column:
    return F.startswith(_col(kind), F.lit(REVERSE))


def canonical(kind) -> Column:
    """The forward kind."""
    return F.regexp_replace(_col(kind), f"^{REVERSE}", "")


def mirror(kind) -> Column:
    return F.when(is_reverse(kind), canonical(kind)).otherwise(F.concat(F.lit(REVERSE), _col(kind)))


def base_kind(kind) -> Column:
    """Without the ordinal."""
    return F.regexp_replace(_col(kind), r"\.\d+$", "")


def ordinal(kind) -> Column:
    return F.coalesce(F.regexp_extract(_col(kind), r"^.+\.(\d+)$", 1).try_cast("int"), F.lit(0))


def has_ordinal(kind) -> Column:
    return F.regexp_like(_col(kind), F.lit(r"^.+\.\d+$"))


def is_variant(kind, of: str) -> Column:
    """kind is `of` or a refinement of it."""
    k = _col(kind)
    return (k == of) | F.startswith(k, F.lit(f"{of}/"))


def any_variant(kind, of: list[str]) -> Column:
    out = F.lit(False)
    for k in of:
        out = out | is_variant(kind, k)
    return out


def is_anchor_edge(kind, vocabulary: Vocabulary = VOCABULARY) -> Column:
    return any_variant(canonical(kind), [vocabulary.edge(k) for k in ANCHOR_EDGES])


def display_rank(kind, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """Sort key of kinds in replies: anchor edges before others, forward before reverse, then families, then the label."""
    base = canonical(kind)
    family = F.lit(9)
    for rank, name in reversed(list(enumerate(["defines", "documents", "ref", "named", "typed"]))):
        family = F.when(is_variant(base, vocabulary.edge(name)), rank).otherwise(family)
    return F.struct((~is_anchor_edge(kind, vocabulary)).cast("int").alias("a"), is_reverse(kind).cast("int").alias("b"), family.alias("c"), base.alias("d"))
