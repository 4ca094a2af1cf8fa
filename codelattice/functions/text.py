"""Text helpers: trigrams, path rules, byte sizes, markdown links, paths by pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def trigrams(text) -> Column:
    """The distinct trigrams of a text."""
    t = _col(text)
    return F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))))


def required_trigrams(pattern: str) -> list[str]:
    """Trigrams that any text matching a regular expression must hold: those of its literal stretches outside groups, classes, and what may repeat or be left out."""
    if "|" in pattern or "(?" in pattern:
        return []
    out, run, depth, i = [], "", 0, 0

    def close():
        nonlocal run
        out.extend(run[k : k + 3] for k in range(len(run) - 2))
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            if pattern[i + 1].isalnum() or depth:
                close()
            else:
                run += pattern[i + 1]
            i += 2
        elif c == "[":
            close()
            i = pattern.index("]", i + 2) + 1
        elif c in "*?{":
            run = run[:-1]
            close()
            i = pattern.index("}", i) + 1 if c == "{" else i + 1
        elif c == "+":
            close()
            i += 1
        elif c in "()":
            close()
            depth += 1 if c == "(" else -1
            i += 1
        elif c in ".^$":
            close()
            i += 1
        else:
            run = run if depth else run + c
            i += 1
    close()
    return list(dict.fromkeys(out))


def rewritten(path, rules: list[dict], default: dict | None = None) -> Column:
    """Path -> VName parts by the first rule whose pattern matches the whole path.

    A rule: pattern (anchored), and templates corpus, root, path in which @group@ or @N@ stands for a group. The
    language of a template is not used. Without a match: the default's templates, the path as it is.
    """
    p = _col(path)

    def part(rule, name):
        template = rule.get(name)
        if template is None:
            return p if name == "path" else F.lit("")
        names = {n: k for n, k in re.compile(rule.get("pattern", "")).groupindex.items()}
        pieces = re.split(r"@(\w+)@", template)
        cols = [F.lit(x) if k % 2 == 0 else F.regexp_extract(p, "^(?:" + re.sub(r"\(\?P<", "(?<", rule["pattern"]) + ")$", int(x) if x.isdigit() else names[x]) for k, x in enumerate(pieces)]
        return F.concat(*cols)

    out = F.struct(*(part(default or {}, n).alias(n) for n in ("corpus", "root", "path")))
    for rule in reversed(rules):
        hit = F.regexp_like(p, F.lit("^(?:" + re.sub(r"\(\?P<", "(?<", rule["pattern"]) + ")$"))
        out = F.when(hit, F.struct(*(part(rule, n).alias(n) for n in ("corpus", "root", "path")))).otherwise(out)
    return out


#: Suffixes of byte sizes, each 1024 times the one before.
SIZES = ["B", "K", "M", "G", "T", "P"]


def byte_size(text) -> Column:
    """"64K" -> bytes; also "64KB", "64KiB", lower case and fractions. Null where it is none."""
    t = F.upper(F.trim(_col(text)))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*(B|[KMGTP](?:I?B)?)?$", 1)
    unit = F.substring(F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*(B|[KMGTP](?:I?B)?)?$", 2), 1, 1)
    scale = F.lit(1).cast("double")
    for k, s in enumerate(SIZES):
        scale = F.when(unit == s, F.lit(float(1024**k))).otherwise(scale)
    return F.when(number != "", F.floor(number.cast("double") * scale).cast("long"))


def format_size(n) -> Column:
    """Bytes in the largest unit that divides them."""
    n = _col(n)
    out = F.concat(n.cast("string"), F.lit("B"))
    for k in range(1, len(SIZES)):
        out = F.when((n != 0) & (n % 1024**k == 0), F.concat((n / 1024**k).cast("long").cast("string"), F.lit(SIZES[k]))).otherwise(out)
    return out


def markdown_links(text, places, link) -> Column:
    """Text with [label](target) at places: array<struct<start, end, target>> in order, offsets in characters."""
    t, places = _col(text), _col(places)
    step = lambda acc, p: F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, p["start"] - acc["at"]), F.lit("["), F.substring(t, p["start"] + 1, p["end"] - p["start"]), F.lit("]("), link(p["target"]), F.lit(")")).alias("out"), p["end"].cast("int").alias("at"))
    done = F.aggregate(places, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return F.concat(done["out"], F.substring(t, done["at"] + 1, F.length(t)))


def path_pattern(pattern: str) -> tuple[str, list[str]]:
    """/a/:name/b -> a regular expression with groups, and the names. A segment ends at a slash; a last one may run on with *."""
    names = re.findall(r":(\w+)\*?", pattern)
    body = re.sub(r":(\w+)(\*?)", lambda m: "(.+)" if m[2] else "([^/]+)", re.sub(r"[.+?()\[\]{}^$|]", lambda m: "\\" + m[0], pattern))
    return f"^{body}$", names


def match_path(path, pattern: str) -> Column:
    """Named segments of a path as a map; null where it doesn't match."""
    regex, names = path_pattern(pattern)
    p = _col(path)
    pairs = [x for k, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(p, regex, k + 1))]
    return F.when(F.regexp_like(p, F.lit(regex)), F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))


def generate_path(pattern: str, values: dict[str, Column]) -> Column:
    pieces = re.split(r":(\w+)\*?", pattern)
    return F.concat(*(F.lit(x) if k % 2 == 0 else values[x].cast("string") for k, x in enumerate(pieces)))
