"""Line diffs between two texts as kept stretches in bytes, to move spans from an old text to a new one."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEPT = "array<struct<old_start: int, old_end: int, new_start: int>>"


def kept(old: str, new: str) -> list[dict]:
    """Stretches that both texts share: whole lines first, then the characters of lines that changed. Neighbours are joined.

    An empty text is kept too: its one place, the end, is the end of the new text.
    """
    if not old:
        return [{"old_start": 0, "old_end": 0, "new_start": len(new.encode())}]
    a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
    x = [0]
    for line in a:
        x.append(x[-1] + len(line.encode()))
    y = [0]
    for line in b:
        y.append(y[-1] + len(line.encode()))
    out = []

    def add(s, e, t):
        if e > s:
            if out and out[-1]["old_end"] == s and out[-1]["new_start"] + s - out[-1]["old_start"] == t:
                out[-1]["old_end"] = e
            else:
                out.append({"old_start": s, "old_end": e, "new_start": t})

    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            add(x[i1], x[i2], y[j1])
        elif tag == "replace":
            p, q = "".join(a[i1:i2]), "".join(b[j1:j2])
            for i, j, n in SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks():
                s, t = x[i1] + len(p[:i].encode()), y[j1] + len(q[:j].encode())
                add(s, s + len(p[i : i + n].encode()), t)
    return out


def kept_stretches(old: Column, new: Column) -> Column:
    @F.pandas_udf(_KEPT)
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([kept(a or "", b or "") for a, b in zip(old, new, strict=True)])

    return run(old, new)


def edits(texts: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, old_start, old_end, new_start) rows for spans.patched."""
    return texts.select(key, F.explode(kept_stretches(F.col(old), F.col(new))).alias("k")).select(key, "k.*")
