"""Exact ids and counts of a byte-level BPE tokenizer, pre-token by pre-token.

A byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in a row. Most pre-tokens
are whole vocabulary strings. Which vocabulary strings encode alone as their one token is proven offline, with the
library itself (a rank order can make a string unreachable); these count as one without any merging. The rest is
merged once for each distinct pre-token that a process remembers: by rank, where the file's merges come in the order
of their ids (that is checked), else by the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

from .common import MEMO_WORDS

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same cuts by the faster `re`, for texts in which both agree on letters, numbers and spaces (tests cover each code point).
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_NOT_FAST = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


_LIBRARY = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def cut(text: str) -> list[str]:
    """Pre-tokens. Characters that are newer than this Python's Unicode tables, on which libraries differ, go to the library."""
    if not _NOT_FAST.search(text):
        return _FAST.findall(text)
    if any(unicodedata.category(c) == "Cn" for c in set(text)):
        return [text[a:b] for _, (a, b) in _LIBRARY.pre_tokenize_str(text)]
    return PATTERN.findall(text)


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def proven(tokenizer) -> list[str]:
    """The vocabulary strings that are one pre-token and encode alone as their own single id."""
    letters, special = byte_letters(), {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    found = []
    for token, own in tokenizer.get_vocab().items():
        if token in special or not all(c in letters for c in token):
            continue
        try:
            found.append((bytes(letters[c] for c in token).decode(), own))
        except UnicodeDecodeError:
            continue  # part of a character; no text holds it alone
    found = [(s, own) for s, own in found if cut(s) == [s]]
    ids = tokenizer.encode_batch([s for s, _ in found], add_special_tokens=False)
    return [s for (s, own), e in zip(found, ids, strict=True) if e.ids == [own]]


def ranked(tokenizer) -> tiktoken.Encoding | None:
    """The same merges by rank; None where the merges aren't in the order of the ids or the model has options."""
    letters, model = byte_letters(), json.loads(tokenizer.to_str())["model"]
    merges = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merges != sorted(merges) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Whole texts -> counts of tokens, or packed ids (little-endian, 32 bits each). Special strings keep their own id, as by the library's default."""

    def __init__(self, path: str, known: set | None = None):
        self.tokenizer = load(path)
        self.by_rank = ranked(self.tokenizer)
        self.known = dict.fromkeys(known or (), 1)
        self.memo = dict(self.known)
        added = self.tokenizer.get_added_tokens_decoder()
        assert all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values()), "special tokens with options"
        self.special = {t.content: i for i, t in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]

    def merged(self, piece: str) -> list[int]:
        if self.by_rank is not None:
            return self.by_rank._encode_single_piece(piece.encode())
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text: one for each special string and each proven pre-token, merges for the rest."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = dict(self.known)
        memo, out = self.memo, []
        for text in texts:
            n = 0
            for part in self.split(text):
                if part in self.special:
                    n += 1
                    continue
                pieces = cut(part)
                for p in set(pieces).difference(memo):
                    memo[p] = len(self.merged(p))
                n += sum(map(memo.__getitem__, pieces))
            out.append(n)
        return out

    def packed(self, text: str) -> bytes:
        out = []
        for part in self.split(text):
            if part in self.special:
                out.append(packed([self.special[part]]))
            elif self.by_rank is not None and not _NOT_FAST.search(part):
                out.append(self.by_rank.encode_to_numpy(part, disallowed_special=()).tobytes())
            else:
                out += [packed(self.merged(p)) for p in cut(part)]
        return b"".join(out)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_ENCODERS: dict = {}


def encoder(path: str, known: set | None = None) -> Encoder:
    """One encoder for a process and file; its memo serves all tasks that run there."""
    if (path, known is None) not in _ENCODERS:
        _ENCODERS[path, known is None] = Encoder(path, known)
    return _ENCODERS[path, known is None]
