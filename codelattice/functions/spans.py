"""Byte offsets, lines and columns. Offsets and columns count bytes of UTF-8, lines from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def line_index(files: DataFrame, key: str | list[str], text: str, with_text: bool = False) -> DataFrame:
    """(key, line_number, line_start, line_bytes), and the line on demand: one row for each line of each file. key: a column or several."""
    key = [key] if isinstance(key, str) else key
    lines = files.select(*key, F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("i", "line"))
    size = F.octet_length("line")
    before = F.sum(size + 1).over(Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size - 1
    return lines.select(*key, (F.col("i") + 1).alias("line_number"), before.cast("long").alias("line_start"), size.cast("long").alias("line_bytes"), *(["line"] if with_text else []))


def point(text, offset) -> Column:
    """(byte_offset, line_number, column_offset) of an offset, clamped to the text. One pass over the bytes before it."""
    raw, offset = _col(text).cast("binary"), _col(offset)
    at = F.greatest(F.lit(0), F.least(offset.cast("int"), F.octet_length(raw)))
    before = F.decode(F.substring(raw, F.lit(1), at), "ISO-8859-1")  # one character a byte
    column = F.length(F.substring_index(before, "\n", -1))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
    return F.struct(at.cast("int").alias("byte_offset"), line.cast("int").alias("line_number"), column.cast("int").alias("column_offset"))


def offset_of(text, line, column) -> Column:
    """The offset of a line and column, each clamped."""
    raw = F.decode(_col(text).cast("binary"), "ISO-8859-1")
    lines = F.split(raw, "\n", -1)
    line = F.greatest(F.lit(1), F.least(_col(line), F.size(lines)))
    start = F.length(F.array_join(F.slice(lines, F.lit(1), line - 1), "\n")) + F.when(line > 1, 1).otherwise(0)
    return (start + F.least(F.greatest(_col(column), F.lit(0)), F.length(F.get(lines, line - 1)))).cast("int")


def slice_text(text, start, end) -> Column:
    """Bytes [start, end) as text; characters that the span cuts become replacement characters."""
    raw = _col(text).cast("binary")
    return F.make_valid_utf8(F.substring(raw, _col(start).cast("int") + 1, (_col(end) - _col(start)).cast("int")).cast("string"))


def line_text(text, offset) -> Column:
    """The whole line around an offset (a last line without a newline too, in full)."""
    raw, offset = _col(text).cast("binary"), _col(offset).cast("int")
    before = F.substring_index(F.decode(F.substring(raw, F.lit(1), offset), "ISO-8859-1"), "\n", -1)
    after = F.substring_index(F.decode(F.substring(raw, offset + 1, F.octet_length(raw)), "ISO-8859-1"), "\n", 1)
    return F.make_valid_utf8(F.encode(F.concat(before, after), "ISO-8859-1").cast("string"))


def within(start, end, low, high) -> Column:
    """Span [start, end] lies in [low, high]."""
    return (_col(start) >= _col(low)) & (_col(end) <= _col(high))


def around(start, end, low, high) -> Column:
    """Span [start, end] covers [low, high]."""
    return (_col(start) <= _col(low)) & (_col(end) >= _col(high))


def patched(spans: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Spans of an old text -> their place in the new one; spans that an edit touches are left out.

    edits(key, old_start, old_end, new_start, new_end): the kept stretches of a diff, sorted or not. A span survives if it
    lies in one kept stretch.
    """
    e = edits.select(F.col(key).alias("_k"), "old_start", "old_end", "new_start")
    shift = F.col("new_start") - F.col("old_start")
    found = spans.join(e, (F.col(key) == F.col("_k")) & within("start", "end", "old_start", "old_end"))
    return found.withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift}).drop("_k", "old_start", "old_end", "new_start").dropDuplicates()
