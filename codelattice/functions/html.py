"""HTML text: plain text, slices of text nodes, decoration of ranges. Offsets count characters of the plain text."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Pieces(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        self.pieces.append(("tag", self.get_starttag_text() or f"<{tag}>"))

    def handle_startendtag(self, tag, attrs):
        self.pieces.append(("tag", self.get_starttag_text() or f"<{tag}/>"))

    def handle_endtag(self, tag):
        self.pieces.append(("tag", f"</{tag}>"))

    def handle_data(self, data):
        self.pieces.append(("text", data))


def pieces(html: str) -> list[tuple[str, str]]:
    p = _Pieces()
    p.feed(html)
    p.close()
    return p.pieces


def plain(html: str) -> str:
    return "".join(t for kind, t in pieces(html) if kind == "text")


def sliced(html: str, start: int, end: int) -> str:
    """The plain text of a range."""
    return plain(html)[start:end]


def decorated(html: str, ranges: list[tuple[int, int, str]]) -> str:
    """HTML whose ranges of text are wrapped in <span class=..>; a range that crosses tags is wrapped piece by piece."""
    out, at = [], 0
    for kind, t in pieces(html):
        if kind == "tag":
            out.append(t)
            continue
        cuts = sorted({0, len(t), *(min(max(x - at, 0), len(t)) for s, e, _ in ranges for x in (s, e))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            names = [n for s, e, n in ranges if s <= at + a and at + b <= e]
            text = escape(t[a:b], quote=False)
            for n in names:
                text = f'<span class="{escape(n)}">{text}</span>'
            out.append(text)
        at += len(t)
    return "".join(out)


def plain_text(html: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else plain(x))

    return run(html if isinstance(html, Column) else F.col(html))
