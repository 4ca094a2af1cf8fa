"""Benchmark decontamination by template canonicalisation.

Words lose their case and the signs around them; numbers (spelled ones too), names and units become typed placeholders. A name
is a capitalised word, wherever it stands, that the benchmark never has in lower case and that is no common opener of
sentences; so a name that opens a question is one, and "The" or a text in capitals is not. Windows of WINDOW template words of a document are looked up among those of the benchmark by hash.
Hits on one diagonal (document place less item place) make a passage; it counts if it is long enough and if what stands
in its placeholders on both sides maps one to one. Where it doesn't, the passage is cut, from its first word on, at each
slot that contradicts the part before, and the parts that are long enough count. If none is, every other stretch that
agrees is tried, so a part is found wherever there is one; a part may be shorter than the longest stretch that agrees.
A passage whose slots hold the same values, or with PASSAGE words in a row that are the same, is an exact leak, one with
other values a re-parameterised question.

The benchmark's windows are broadcast, in blocks of at most BLOCK_WORDS words, so their size is bounded however large the
benchmark is; documents are read once for each block, and never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Memo, hashed, mix, slices, utf8

#: Words to a window, and words that a passage needs (an item shorter than that must be there whole).
WINDOW, PASSAGE = 8, 13
#: Ordinary words that a window needs: one of placeholders alone says nothing.
LEAST_PLAIN = 4
#: Words of the benchmark that are broadcast at once: about 40 bytes each.
BLOCK_WORDS = 400_000
#: Units of measure.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "l", "s", "sec", "min", "h", "hr", "hrs", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "meters", "metres", "kilometers", "miles", "feet", "inches", "kilograms", "grams", "pounds", "liters", "litres", "percent", "%", "$", "€", "£", "usd", "eur", "dollars", "euros", "cents", "mph", "kmh", "km/h", "°c", "°f", "degrees", "volts", "watts", "kw", "hz"]
#: Numbers as words. Those for one are articles too and stay words.
NUMBERS = {
    "en": ["zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million"],
    "de": ["null", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn", "achtzehn", "neunzehn", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig", "hundert", "tausend"],
    "es": ["cero", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "veinte", "treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa", "cien", "mil"],
    "fr": ["zéro", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt", "trente", "quarante", "cinquante", "soixante", "cent", "mille"],
}
#: Words that open sentences and questions and are no names.
OPENERS = {
    "en": ["a", "all", "an", "and", "are", "as", "at", "but", "by", "can", "do", "does", "each", "every", "find", "for", "from", "given", "has", "have", "he", "her", "his", "how", "i", "if", "in", "is", "it", "let", "of", "on", "one", "or", "she", "so", "some", "that", "the", "their", "then", "there", "they", "this", "to", "we", "what", "when", "where", "which", "who", "why", "will", "with", "you"],
    "de": ["am", "an", "auf", "aus", "bei", "das", "der", "die", "ein", "eine", "er", "es", "für", "ich", "im", "in", "ist", "mit", "sie", "und", "von", "wann", "warum", "was", "wenn", "wer", "wie", "wir", "wo", "zu"],
    "es": ["al", "como", "con", "cuando", "de", "del", "dónde", "el", "ella", "en", "es", "ese", "esta", "la", "las", "los", "para", "pero", "por", "qué", "quién", "se", "si", "su", "un", "una", "y"],
    "fr": ["au", "aux", "avec", "ce", "cette", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "je", "la", "le", "les", "nous", "on", "ou", "où", "par", "pour", "quand", "que", "qui", "si", "sur", "un", "une", "à"],
}
_UNITS = {u.encode() for u in UNITS} - {b"in", b"m", b"t", b"l", b"s", b"g", b"h", b"min", b"second", b"day"}
_AFTER_NUMBER = {u.encode() for u in UNITS}
_NUMBERS, _OPENERS = ({w.encode() for ws in x.values() for w in ws} for x in (NUMBERS, OPENERS))
_SIGNS = "\"'`.,;:!?()[]{}<>*_~|«»„“”‘’…—–-"
_NUM, _NAME, _UNIT = (U64(xxhash.xxh64_intdigest(x) & ~3) for x in (b"<num>", b"<name>", b"<unit>"))
_NUMBER = 1


def _strip(word: bytes) -> str:
    return word.decode(errors="replace").strip(_SIGNS)


def _canonical(lower_case: frozenset):
    """A function: word -> hash of its template word, its low bit: number. Two words count as one: 5km is a number."""

    def canonical(word: bytes) -> int:
        bare = _strip(word)
        low = bare.lower().encode()
        digits = sum(c in "0123456789" for c in bare)
        if low in _NUMBERS or bare.lstrip("+-$€£")[:1].isdigit() and 2 * digits >= len(bare.encode()):
            return int(_NUM) | _NUMBER
        if low in _UNITS:
            return int(_UNIT)
        if bare[:1].isupper() and low not in _OPENERS and low not in lower_case:
            return int(_NAME)
        return xxhash.xxh64_intdigest(low) & ~3

    return canonical


class Canonical:
    """Template words and slots of texts. lower_case: the words that the benchmark has in lower case. Memory: two memos of words."""

    def __init__(self, lower_case: frozenset):
        self.memo = Memo(_canonical(lower_case))
        self.units = Memo(lambda w: _strip(w).lower().encode() in _AFTER_NUMBER)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word of a text: the hash of its template word, and whether it is a slot."""
        h = hashed(words, self.memo)
        t = h & ~U64(3)
        for i in np.flatnonzero(h[:-1] & U64(_NUMBER)):
            if self.units[words[i + 1]]:
                t[i + 1] = _UNIT
        return t, (t == _NUM) | (t == _NAME) | (t == _UNIT)


_POWERS = np.array([pow(0x9E3779B97F4A7C15 | 1, k, 2**64) for k in range(64)], U64)


def windows(t: np.ndarray, width: int) -> np.ndarray:
    n = len(t) - width + 1
    if n < 1:
        return t[:0]
    with np.errstate(over="ignore"):
        return mix(sum((t[k : n + k] * _POWERS[k] for k in range(1, width)), t[:n] * _POWERS[0]), width)


class Index:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple]):
        self.lower_case = frozenset(b.encode() for b in {_strip(w) for _, text in items for w in set(text.split())} if b[:1].islower() and b == b.lower())
        canonical = Canonical(self.lower_case)
        self.items, places = {}, defaultdict(list)
        self.widths = set()
        for key, (item_id, text) in enumerate(items):
            words = text.split()
            t, slot = canonical(words)
            width = min(WINDOW, len(t))
            if not width:
                continue
            self.items[key] = item_id, words, slot
            plain = np.convolve(~slot, np.ones(width, int), "valid")
            for q, w in enumerate(windows(t, width).tolist()):
                if plain[q] >= min(LEAST_PLAIN, width):
                    places[w].append((key, q))
                    self.widths.add(width)
        self.places = dict(places)
        self.keys = np.sort(np.array(list(places), U64))
        bits = 1 << max(16, (64 * max(len(self.keys), 1)).bit_length())
        self.mask, self.filter = U64(bits - 1), np.zeros(bits, bool)
        self.filter[(self.keys & self.mask).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of windows that are in the index: a bitmap first, then the sorted hashes."""
        at = np.flatnonzero(self.filter[(h & self.mask).astype(np.int64)])
        if not len(at):
            return at
        found = self.keys[np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)] == h[at]
        return at[found]


def _bare(words: list[bytes]) -> list[str]:
    return [_strip(w).lower() for w in words]


def _agreeing(doc: list[str], item: list[str], slot: np.ndarray, disjoint: bool) -> list[tuple[int, int]]:
    """Stretches [start, end) whose slots map one to one both ways. disjoint: cut at each slot that contradicts the
    stretch before; else all stretches that can't be made longer."""
    out, start, there, back = [], 0, {}, {}
    for k in np.flatnonzero(slot).tolist():
        x, y = doc[k], item[k]
        # The last place in the stretch where either side stands with something else.
        clash = max((p for v, p in there.get(y, {}).items() if v != x), default=-1)
        clash = max(clash, max((p for v, p in back.get(x, {}).items() if v != y), default=-1))
        if clash >= start:
            out.append((start, k))
            start = k if disjoint else clash + 1
        there.setdefault(y, {})[x] = k
        back.setdefault(x, {})[y] = k
    return [*out, (start, len(doc))]


def _verbatim(doc: list[str], item: list[str], least: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of equal words, of that length at least."""
    edges = np.flatnonzero(np.diff(np.r_[0, [x == y for x, y in zip(doc, item, strict=True)], 0]))
    return [(s, e) for s, e in edges.reshape(-1, 2).tolist() if e - s >= least]


def _parts(doc: list[bytes], item: list[bytes], slot: np.ndarray, hits: np.ndarray, width: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, exact) of the passages in a run of hits, whose windows start at hits."""
    doc, item = _bare(doc), _bare(item)

    def windowed(s: int, e: int) -> tuple[int, int]:
        """A stretch from the first to the last of its windows."""
        inside = hits[(hits >= s) & (hits + width <= e)]
        return (int(inside[0]), int(inside[-1]) + width) if len(inside) else (s, s)

    least = min(PASSAGE, len(doc))
    same = _verbatim(doc, item, least)
    parts = _agreeing(doc, item, slot, True)
    if len(parts) > 1:
        for disjoint in (True, False):
            kept = [(s, e) for s, e in (windowed(*x) for x in _agreeing(doc, item, slot, disjoint)) if e - s >= least]
            kept += [x for x in same if np.ptp(windowed(*x))]
            if kept:
                break
        parts = kept
    for s, e in parts:
        equal = all(x == y for x, y, k in zip(doc[s:e], item[s:e], slot[s:e], strict=True) if k)
        yield s, e, equal or any(min(e, y) - max(s, x) >= least for x, y in same)


def passages(words: list[bytes], t: np.ndarray, found: dict[int, np.ndarray], index: Index) -> Iterator[tuple]:
    """(item_id, first word, words, coverage of the item, exact) of a document: for each item its longest passage."""
    diagonals = defaultdict(set)
    for h, at in found.values():
        for p in at.tolist():
            for key, q in index.places[int(h[p])]:
                diagonals[key, p - q].add(q)
    spans = defaultdict(list)
    for (key, shift), marks in diagonals.items():
        item_id, item, slot = index.items[key]
        width = min(WINDOW, len(item))
        marks = np.array(sorted(marks))
        for hits in np.split(marks, np.flatnonzero(np.diff(marks) >= 2 * width) + 1):
            start, end = int(hits[0]), int(hits[-1]) + width
            if end - start >= min(PASSAGE, len(item)):
                for s, e, exact in _parts(words[start + shift : end + shift], item[start:end], slot[start:end], hits - start, width):
                    spans[item_id].append((e - s, exact, -(start + s + shift), round((e - s) / len(item), 6)))
    for item_id, found_spans in spans.items():
        n, same, start, coverage = max(found_spans)
        yield item_id, -start, n, coverage, same


class Matcher:
    """Finds the passages of a block of items in whole texts."""

    def __init__(self, index: Index):
        self.index, self.canonical = index, Canonical(index.lower_case)

    def __call__(self, text: bytes) -> list[tuple]:
        words = text.split()
        if not len(self.index.keys):
            return []
        t, _ = self.canonical(words)
        found = {w: (h, at) for w in self.index.widths if len(at := self.index.hits(h := windows(t, w)))}
        return list(passages(words, t, found, self.index)) if found else []


def matchers(spark, benchmark: DataFrame) -> Iterator:
    """For each block of the benchmark a function that makes a Matcher, on an executor too."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_WORDS))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        index = spark.sparkContext.broadcast(Index(list(zip(part.column(0).to_pylist(), utf8(part.column(1).combine_chunks()), strict=True))))
        yield lambda index=index: Matcher(index.value)


def leak_tests(spark, benchmark: DataFrame) -> Iterator:
    """For each block of the benchmark a function: texts -> whether each holds a passage."""
    for matcher in matchers(spark, benchmark):

        def leaks(texts: list[bytes], matcher=matcher, held=[]) -> list[bool]:  # noqa: B006  one matcher, and its memo, for a task
            if not held:
                held.append(matcher())
            return [bool(held[0](t)) for t in texts]

        yield leaks


_FOUND = "first_word long, n_words long, coverage double, exact boolean"
_KINDS = pa.int64(), pa.int64(), pa.float64(), pa.bool_()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> (doc_id, item_id, first_word, n_words, coverage, exact).

    One row for each document row and item that shares a passage: the longest, counted in words of the document's
    whole text; of passages of one length an exact one, then the first. Null and empty texts match nothing; items of the same text each give a row; a null item_id is an item, a
    null doc_id stays null.
    """
    names, out = ["doc_id", "item_id", *(c.split()[0] for c in _FOUND.split(", "))], None
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, {_FOUND}"
    item_kind = pa.schema(benchmark.select("item_id").limit(0).toArrow().schema).field(0).type
    for matcher in matchers(docs.sparkSession, benchmark):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            match = matcher()
            for b in slices(batches):
                rows = [(doc_id, *x) for doc_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True) for x in match(text)]
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (b.schema.field(0).type, item_kind, *_KINDS), strict=True)], names)

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
