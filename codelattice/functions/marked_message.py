"""Marked source as it is stored: a protocol-buffer message, to and from the JSON trees that functions.render reads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.wire import delimited, fields, varint

#: Field numbers, and the kinds by number.
TEXTS = {2: "pre_text", 4: "post_child_text", 5: "post_text"}
NUMBERS = {6: "lookup_index", 7: "default_children_count", 10: "add_final_list_token"}
KIND, CHILD, EXCLUDED = 1, 3, 12
KINDS = ["BOX", "TYPE", "PARAMETER", "IDENTIFIER", "CONTEXT", "INITIALIZER", "PARAMETER_LOOKUP_BY_PARAM", "LOOKUP_BY_PARAM", "PARAMETER_LOOKUP_BY_PARAM_WITH_DEFAULTS", "LOOKUP_BY_TYPED", "PARAMETER_LOOKUP_BY_TPARAM", "LOOKUP_BY_TPARAM", "MODIFIER"]


def parse(message: bytes) -> dict:
    """A message as a tree; fields that trees don't have are left out."""
    node: dict = {}
    for number, value in fields(message):
        if number == KIND and isinstance(value, int) and 0 < value < len(KINDS):
            node["kind"] = KINDS[value]
        elif number in TEXTS and isinstance(value, bytes):
            node[TEXTS[number]] = value.decode("utf-8", "replace")
        elif number in NUMBERS and isinstance(value, int):
            node[NUMBERS[number]] = bool(value) if number == 10 else value
        elif number == EXCLUDED:
            node.setdefault("exclude_on_include", []).extend(KINDS[k] for k in (value if isinstance(value, bytes) else [value]) if k < len(KINDS))  # kinds are below 128, one byte each
        elif number == CHILD and isinstance(value, bytes):
            node.setdefault("child", []).append(parse(value))
    return node


def serialise(node: dict) -> bytes:
    """A tree as a message."""
    out = b""
    if node.get("kind", "BOX") != "BOX":
        out += varint(KIND << 3) + varint(KINDS.index(node["kind"]))
    for number, name in TEXTS.items():
        if node.get(name):
            out += varint(number << 3 | 2) + delimited(node[name].encode())
    for child in node.get("child", []):
        out += varint(CHILD << 3 | 2) + delimited(serialise(child))
    for number, name in NUMBERS.items():
        if node.get(name):
            out += varint(number << 3) + varint(int(node[name]))
    if node.get("exclude_on_include"):
        out += varint(EXCLUDED << 3 | 2) + delimited(bytes(KINDS.index(k) for k in node["exclude_on_include"]))
    return out


def trees(messages: Column | str) -> Column:
    """Stored messages as JSON trees; null where one is broken."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else json.dumps(parse(bytes(b)))
            except (ValueError, IndexError):
                return None

        return column.map(one)

    return run(messages if isinstance(messages, Column) else F.col(messages))


def messages(tree: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else serialise(json.loads(t)))

    return run(tree if isinstance(tree, Column) else F.col(tree))
