"""Licence scan, in DataFrame functions only.

A text is normalised (lower case, runs of other characters than letters and digits become one space), so neither line ends nor
comment signs matter. The places of word bigrams that occur in any licence template are looked up in a hash set; they make
runs, whose gaps are small. A run reaches from its first such bigram to its last and is compared with templates by the
Dice coefficient of their sets of word bigrams. 2 * common >= t * (a + b) needs sizes within a factor of (2 - t) / t and two
thirds of the template (at t = 0.8) in the run, so a run meets only the templates in that range and most runs none.

Short templates (below LONG bigrams) are compared with tight runs, in which single words differ; long ones with loose runs,
in which some words in a row do, such as the name of a holder. One pass; the only shuffle is of the matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

DICE = 0.8
#: Bigrams from which a template is long; steps between neighbouring places within a run, for short and long templates.
LONG, STEPS = 30, (3, 8)


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, by the rule of normalised()."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def known(templates: list[tuple[str, str]] | None) -> list[tuple[str, list[str]]]:
    found = sorted((name, bigrams(text)) for name, text in (TEMPLATES if templates is None else templates))
    return [(name, grams) for name, grams in found if grams]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigram(words: Column, i: Column) -> Column:
    """The i-th bigram of an array of words, from 1."""
    return F.concat_ws(" ", F.get(words, i - 1), F.get(words, i))


def _runs(at: Column, step: int, long: bool, least: int) -> Column:
    """Places in order -> (long, first, last) of the runs that hold `least` of them."""
    places = F.size(at)
    firsts = F.filter(F.sequence(F.lit(0), places - 1), lambda i: (i == 0) | (F.get(at, i) - F.get(at, i - 1) > step))
    ends = lambda k: F.coalesce(F.get(firsts, k + 1), places) - 1
    runs = F.transform(firsts, lambda i, k: F.struct(i.alias("i"), ends(k).alias("j")))
    kept = F.filter(runs, lambda r: r["j"] - r["i"] + 1 >= least)
    return F.transform(kept, lambda r: F.struct(F.lit(long).alias("long"), F.get(at, r["i"]).alias("first"), F.get(at, r["j"]).alias("last")))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, dice: float = DICE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, license, n_matches, dice): for each document the licences that its runs match.

    A run counts for its best template (the first by name where several tie). Null and empty texts match nothing; rows
    with the same doc_id (null too) are counted together.
    """
    found = known(templates)
    every = ", ".join(sorted({f"'{g}'" for _, grams in found for g in grams}))
    # A match needs dice * (n + m) / 2 common bigrams of a run's m >= n * dice / (2 - dice).
    least = [min((int(-(-len(g) * dice / (2 - dice) // 1)) for _, g in found if (len(g) >= LONG) == long), default=0) for long in (False, True)]
    literal = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n")) for name, g in found))
    # Each step is one generator over what the step before made, so Catalyst evaluates words, places, bigrams and matches once.
    words = docs.select("doc_id", F.explode(F.array(F.split(normalised(F.col("text")), " "))).alias("words")).where("size(words) > 1")
    places = words.select("doc_id", "words", F.explode(F.array(F.expr(f"filter(sequence(1, size(words) - 1), i -> concat_ws(' ', words[i - 1], words[i]) in ({every}))"))).alias("at"))
    places = places.where(F.size("at") >= min(x for x in least if x))
    runs = F.concat(*(_runs(F.col("at"), step, long, n) for step, long, n in zip(STEPS, (False, True), least, strict=True) if n))
    runs = places.select("doc_id", "words", F.explode(runs).alias("run"))
    distinct = F.array_distinct(F.transform(F.sequence("run.first", "run.last"), lambda i: _bigram(F.col("words"), i)))
    grams = runs.select("doc_id", "run.long", F.explode(F.array(distinct)).alias("grams"))
    near = F.filter(literal, lambda t: ((t["n"] >= LONG) == F.col("long")) & (t["n"] * dice <= F.size("grams") * (2 - dice)) & (F.size("grams") * dice <= t["n"] * (2 - dice)))
    scored = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect("grams", t["grams"])) / (F.size("grams") + t["n"])).alias("less"), t["name"].alias("license")))
    best = grams.select("doc_id", F.explode(F.filter(F.array(F.array_min(scored)), lambda s: s["less"] <= F.lit(-dice))).alias("best"))
    return best.groupBy("doc_id", F.col("best.license").alias("license")).agg(F.count("*").alias("n_matches"), F.round(F.max(-F.col("best.less")), 6).alias("dice"))


def sql(templates: list[tuple[str, str]] | None = None, dice: float = DICE) -> str:
    """The same for DuckDB, without the bounds."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(g) for g in grams)}])" for name, grams in known(templates))
    return f"""
WITH t(license, grams) AS (VALUES {rows}),
every AS (SELECT DISTINCT unnest(grams) AS gram FROM t),
texts AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT row_id, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM texts),
hits AS (SELECT row_id, i, step FROM pairs SEMI JOIN every USING (gram), (VALUES {", ".join(f"({s})" for s in STEPS)}) s(step)),
cut AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY row_id, step ORDER BY i) <= step THEN 0 ELSE 1 END AS new FROM hits),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY row_id, step ORDER BY i) AS run FROM cut),
runs AS (SELECT row_id, step, run, min(i) AS a, max(i) AS b FROM numbered GROUP BY row_id, step, run),
grams AS (SELECT r.row_id, step, run, doc_id, list_distinct(list_transform(range(a, b + 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM runs r JOIN texts USING (row_id)),
scored AS (SELECT row_id, step, run, doc_id, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grams, t
    WHERE (step = {STEPS[1]}) = (len(grams) >= {LONG})),
best AS (SELECT *, row_number() OVER (PARTITION BY row_id, step, run ORDER BY dice DESC, license) AS k FROM scored WHERE dice >= {dice})
SELECT doc_id, license, count(*) AS n_matches, round(max(dice), 6) AS dice FROM best WHERE k = 1 GROUP BY doc_id, license
"""
