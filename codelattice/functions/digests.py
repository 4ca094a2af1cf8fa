"""Digests of compilation units, whatever the order of their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FIELDS, VNAME

#: A unit as a struct of columns.
UNIT = f"struct<v_name: {VNAME}, required_input: array<struct<digest: string, path: string, v_name: {VNAME}>>, argument: array<string>, output_key: string, source_file: array<string>, working_directory: string, entry_context: string, environment: array<struct<name: string, value: string>>, details: array<struct<type_url: string, value: string>>>"


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _each(items: Column, f) -> Column:
    return F.coalesce(F.array_join(F.transform(items, f), ""), F.lit(""))


def _put(tag: str, *texts: Column) -> Column:
    """A fixed format: the tag and a line end, each text and a zero byte."""
    return F.concat(F.lit(tag + "\n"), *(x for t in texts for x in (F.coalesce(t, F.lit("")), F.lit("\x00"))))


def canonical(unit: Column) -> Column:
    """The unit with its inputs in order of digests and without repetitions, its sources, environment and details in order."""
    ordered = {"required_input": F.array_sort(F.array_distinct(unit["required_input"])), "source_file": F.array_sort(unit["source_file"]), "environment": F.array_sort(unit["environment"]), "details": F.array_sort(unit["details"])}
    out = unit
    for name, c in ordered.items():
        out = out.withField(name, c)
    return out


def unit_digest(unit: Column) -> Column:
    """Hexadecimal SHA-256 of a canonical unit."""
    u = canonical(unit)
    name = lambda v: [v[f] for f in FIELDS]
    strings = lambda tag, c: F.concat(F.lit(tag + "\n"), _each(_list(c), lambda s: F.concat(s, F.lit("\x00"))))
    text = F.concat(
        _put("CU", *name(u["v_name"])),
        _each(u["required_input"], lambda i: F.concat(_put("RI", *name(i["v_name"])), _put("IN", i["path"], i["digest"]))),
        strings("ARG", u["argument"]),
        _put("OUT", u["output_key"]),
        strings("SRC", u["source_file"]),
        _put("CWD", u["working_directory"]),
        _put("CTX", u["entry_context"]),
        _each(u["environment"], lambda e: _put("ENV", e["name"], e["value"])),
        _each(u["details"], lambda d: _put("DET", d["type_url"], d["value"])),
    )
    return F.sha2(text.cast("binary"), 256)
