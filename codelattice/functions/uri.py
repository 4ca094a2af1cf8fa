"""Tickets: the URI text of a VName, made and taken apart by native expressions. Also paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FIELDS, VOCABULARY, Vocabulary, vname


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def escape(text: Column, slashes: bool = False) -> Column:
    """Percent-encodes all but letters, digits and -._~ (and / on demand)."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((("%2F", "/"),) if slashes else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def clean_path(path: Column) -> Column:
    """Drops empty and "." parts, and resolves ".."; above a root it vanishes, above a relative path it stays."""
    absolute = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    keeps = lambda acc: (F.size(acc) == 0) | (F.element_at(acc, -1) == "..")
    step = lambda acc, p: F.when((p == "..") & keeps(acc) & absolute, acc).when((p == "..") & ~keeps(acc), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, p))
    done = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), done)).when(path == "", path).when(done == "", F.lit(".")).otherwise(done)


def dirname(path: Column) -> Column:
    """Up to the last slash; "" for a path without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ticket(v: Column | str, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """VName -> canonical ticket: scheme://corpus?lang=..?path=..?root=..#signature; unset parts are left out. Null for null.

    A name of plain characters with a clean path, as nearly all are, is put together as it is; escapes and paths to clean
    take many times as long.
    """
    v = _col(v)
    path = F.when(v["path"] == "", "").otherwise(clean_path(v["path"]))
    whole = _joined(vocabulary, escape(v["corpus"], True), escape(v["language"]), path, escape(path, True), v["root"], escape(v["root"], True), escape(v["signature"]), v)
    slashes = lambda c: F.replace(c, F.lit("/"), F.lit("%2F"))
    quick = _joined(vocabulary, v["corpus"], slashes(v["language"]), v["path"], v["path"], v["root"], v["root"], slashes(v["signature"]), v)
    around = F.concat(F.lit("/"), v["path"], F.lit("/"))
    clean = (v["path"] == "") | ~(F.contains(around, F.lit("//")) | F.contains(around, F.lit("/./")) | F.contains(around, F.lit("/../")))
    text = F.replace(F.concat_ws("", *(v[f] for f in FIELDS)), F.lit("/"), F.lit("."))
    plain = (F.url_encode(text) == text) & ~F.contains(text, F.lit("*"))
    return F.when(v.isNotNull(), F.when(clean & plain, quick).otherwise(whole))


def _joined(vocabulary: Vocabulary, corpus: Column, language: Column, clean: Column, path: Column, bare: Column, root: Column, signature: Column, v: Column) -> Column:
    out = [F.lit(f"{vocabulary.scheme}:"), F.when(v["corpus"] != "", F.concat(F.lit("//"), corpus)).otherwise("")]
    for name, value, text in (("lang", v["language"], language), ("path", clean, path), ("root", bare, root)):
        out.append(F.when(value != "", F.concat(F.lit(f"?{name}="), text)).otherwise(""))
    return F.concat(*out, F.when(v["signature"] != "", F.concat(F.lit("#"), signature)).otherwise(""))


def file_ticket(t: Column | str) -> Column:
    """Ticket -> that of the file it lies in (see file_vname): without language and signature. Tickets escape ? and #, so both are found in the text."""
    return F.regexp_replace(F.substring_index(_col(t), "#", 1), r"\?lang=[^?]*", "")


def parse_ticket(t: Column | str, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """Ticket -> VName; null where it isn't well formed: another scheme, an unknown or empty attribute, a bad escape."""
    t = _col(t)
    scheme = vocabulary.scheme
    shape = rf"^(?:{scheme}:)?(?://[^?#%]*(?:%[0-9A-Fa-f]{{2}}[^?#%]*)*)?(?:\?(?:lang|path|root)=[^?#%]*(?:%[0-9A-Fa-f]{{2}}[^?#%]*)*)*(?:#[^#%]*(?:%[0-9A-Fa-f]{{2}}[^#%]*)*)?$"
    part = lambda name: unescape(F.regexp_extract(t, rf"^[^#]*?\?{name}=([^?#]*)", 1))
    found = vname(unescape(F.regexp_extract(t, r"#(.*)$", 1)), unescape(F.regexp_extract(t, rf"^(?:{scheme}:)?//([^?#]*)", 1)), part("root"), part("path"), part("lang"))
    return F.when(F.regexp_like(t, F.lit(shape)) & ~F.regexp_like(t, F.lit(r"^[^#]*\?(?:lang|path|root)=(?:[?#]|$)")), found)


def file_vname(v: Column | str) -> Column:
    """The file that an anchor lies in: same corpus, root and path."""
    v = _col(v)
    return vname("", v["corpus"], v["root"], v["path"], "")
