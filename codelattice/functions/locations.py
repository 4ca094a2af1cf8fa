"""Places in texts as people and editors write them: location texts, UTF-16 offsets, charsets."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Charsets that Spark decodes itself; others go through Python's codecs, a batch at a time.
NATIVE = {"utf-8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE", "utf-32": "UTF-32"}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def point(text) -> Column:
    """b123 (a byte offset), 12 or 12:3 (line, column) -> struct(byte_offset, line_number, column_offset); null for anything else."""
    text = _col(text)
    number = lambda pattern, group: F.expr("null").cast("int") if pattern is None else F.regexp_extract(text, pattern, group).try_cast("int")
    line = r"^([0-9]+)(?::([0-9]+))?$"
    zero = F.lit(0)
    found = F.when(F.regexp_like(text, F.lit("^b[0-9]+$")), F.struct(number("^b([0-9]+)$", 1).alias("byte_offset"), zero.alias("line_number"), zero.alias("column_offset")))
    return found.when(F.regexp_like(text, F.lit(line)), F.struct(zero.alias("byte_offset"), number(line, 1).alias("line_number"), F.coalesce(number(line, 2), zero).alias("column_offset")))


def span(text) -> Column:
    """POINT-POINT, or a line alone, which reaches to the start of the next -> struct(start, end); null for anything else."""
    text = _col(text)
    parts = F.split(text, "-")
    start, end = point(F.get(parts, F.lit(0))), point(F.get(parts, F.lit(1)))
    next_line = F.struct(F.lit(0).alias("byte_offset"), (start["line_number"] + 1).alias("line_number"), F.lit(0).alias("column_offset"))
    whole = F.when(start["line_number"] > 0, F.struct(start.alias("start"), next_line.alias("end")))
    both = F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))
    return F.when(F.size(parts) == 1, whole).when(F.size(parts) == 2, both)


def utf16_units(text) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    text = _col(text)
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_of_byte(text, offset) -> Column:
    """A byte offset of UTF-8 as an offset in UTF-16 units, clamped to the text."""
    raw = _col(text).cast("binary")
    at = F.greatest(F.lit(0), F.least(_col(offset).cast("int"), F.octet_length(raw)))
    return utf16_units(F.make_valid_utf8(F.substring(raw, F.lit(1), at).cast("string")))


def byte_of_utf16(text, offset) -> Column:
    """An offset in UTF-16 units as a byte offset of UTF-8."""
    text = _col(text)
    units = F.encode(text, "UTF-16BE")
    return F.octet_length(F.decode(F.substring(units, F.lit(1), 2 * _col(offset).cast("int")), "UTF-16BE"))


def decoded(raw, charset: str | None) -> Column:
    """Bytes in a named charset as text; no name is UTF-8, an unknown one an error."""
    raw, name = _col(raw), (charset or "UTF-8").lower()
    if name in NATIVE:
        return F.decode(raw, NATIVE[name])
    codecs.lookup(name)

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else bytes(b).decode(name, "replace"))

    return decode(raw)
