"""Marked source: signatures as trees, kept as JSON text, and their renderings.

A node: {kind, pre_text, child: [..], post_child_text, post_text, lookup_index, add_final_list_token, link: [..]}. Trees
recurse, so these are Pandas UDFs over Arrow batches; everything else in this library is native.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds whose text is left out of a short signature, and kinds that make up a call site's, an initializer's.
_PARAMETERS = ("PARAMETER", "PARAMETER_LOOKUP_BY_PARAM", "PARAMETER_LOOKUP_BY_TPARAM", "PARAMETER_LOOKUP_BY_PARAM_WITH_DEFAULTS")
#: Depth beyond which a tree is cut, so a malformed cycle ends.
DEPTH = 20


def render(node: dict, keep=lambda kind: True, link=lambda text, node: text, depth: int = DEPTH) -> str:
    """The whole text of a tree; subtrees whose kind isn't kept vanish with their separators."""
    if depth == 0 or not keep(node.get("kind", "BOX")):
        return ""
    out = node.get("pre_text", "")
    parts = [p for c in node.get("child", []) if (p := render(c, keep, link, depth - 1))]
    between = node.get("post_child_text", "")
    out += between.join(parts)
    if parts and node.get("add_final_list_token"):
        out += between
    out += node.get("post_text", "")
    return link(out, node) if node.get("link") else out


def find(node: dict, kind: str, depth: int = DEPTH, outside: tuple = ()):
    """Nodes of a kind, outermost first, not looking inside one that is found, nor inside kinds that it should stand outside of."""
    if depth == 0:
        return
    if node.get("kind") == kind:
        yield node
        return
    if node.get("kind") not in outside:
        for c in node.get("child", []):
            yield from find(c, kind, depth - 1, outside)


#: Kinds whose identifiers aren't the node's own.
_OTHERS = ("CONTEXT", "TYPE", "INITIALIZER", *_PARAMETERS)


def signature(node: dict) -> str:
    return render(node)


def call_site_signature(node: dict) -> str:
    """Identifier and parameters alone."""
    names = [render(n) for n in find(node, "IDENTIFIER", outside=_OTHERS)]
    lists = [render(n) for k in _PARAMETERS for n in find(node, k)]
    return (names[0] if names else "") + ("(" + "".join(lists).strip("()") + ")" if lists else "")


def initializer(node: dict) -> str:
    return "".join(render(n) for n in find(node, "INITIALIZER"))


def simple_identifier(node: dict) -> str:
    return "".join(render(n) for n in find(node, "IDENTIFIER", outside=_OTHERS))


def qualified_name(node: dict, include_identifier: bool = True) -> str:
    """Context and identifier, with the separator that the context names."""
    contexts = list(find(node, "CONTEXT"))
    if not contexts:
        return simple_identifier(node) if include_identifier else ""
    context = contexts[0]
    between = context.get("post_child_text", "") or "."
    names = [simple_identifier(c) or render(c) for c in context.get("child", [])]
    if include_identifier:
        own = list(find(node, "IDENTIFIER", outside=_OTHERS))
        names += [render(n) for n in own[:1]]
    return between.join(n for n in names if n)


def parameters(node: dict) -> list[str]:
    """The identifiers of the parameters, in order."""
    out = []
    for k in _PARAMETERS:
        for p in find(node, k):
            out += [simple_identifier(c) or render(c) for c in p.get("child", [])]
    return out


def _udf(f):
    @F.pandas_udf(StringType())
    def run(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: None if t is None else f(json.loads(t)))

    return run


def rendered(tree: Column | str, how: str = "signature") -> Column:
    """how: signature, call_site_signature, initializer, simple_identifier, qualified_name, base_name or parameters (joined by commas)."""
    table = {"signature": signature, "call_site_signature": call_site_signature, "initializer": initializer, "simple_identifier": simple_identifier, "base_name": simple_identifier, "qualified_name": qualified_name, "parameters": lambda n: ",".join(parameters(n))}
    return _udf(table[how])(tree if isinstance(tree, Column) else F.col(tree))


def as_kind(tree: dict | None, kind: str) -> dict:
    """A tree as one of a kind: a box takes the kind on, another tree is put inside."""
    if tree is not None and tree.get("kind", "BOX") in ("BOX", kind):
        return {**tree, "kind": kind}
    return {"kind": kind, "child": [] if tree is None else [tree]}


def without_excluded(tree: dict | None, kind: str) -> dict | None:
    """A tree as it is included by a lookup of some kind: nodes that shun the kind go."""
    if tree is None or kind in tree.get("exclude_on_include", []):
        return None
    return {**tree, "child": [k for c in tree["child"] if (k := without_excluded(c, kind))]} if tree.get("child") else tree


#: What stands for a lookup of a parameter that isn't there (a fixed value).
UNKNOWN = {"kind": "PARAMETER", "pre_text": "???"}


def filled(node: dict, known: dict[str, dict[int, dict | None]], depth: int = DEPTH) -> dict | None:
    """A tree whose lookups are filled in. known: param, tparam and typed -> ordinal -> tree (None: a node without one)."""
    kind, at = node.get("kind", "BOX"), node.get("lookup_index", 0)
    found = known.get("tparam" if "TPARAM" in kind else "param", {})
    size = max(found, default=-1) + 1
    if depth and kind == "LOOKUP_BY_TYPED":
        return without_excluded(as_kind(known.get("typed", {}).get(0), "TYPE"), kind)
    if depth and kind.startswith("LOOKUP_BY_"):
        if at >= size:
            return UNKNOWN
        if at in found:
            return without_excluded(as_kind(found[at], "PARAMETER"), kind)
    elif depth and kind.startswith("PARAMETER_LOOKUP_BY_"):
        if at > size:
            return UNKNOWN
        trees = (without_excluded(found.get(k), kind) for k in range(at, size))
        return {**{k: v for k, v in node.items() if k != "lookup_index"}, "kind": "PARAMETER", "child": [t for t in trees if t]}
    if depth and node.get("child"):
        return {**node, "child": [k for c in node["child"] if (k := filled(c, known, depth - 1))]}
    return node


def flat(trees: Column) -> Column:
    """Every node of a tree: array<struct<node_id, parent_id, child_ix, kind, pre_text>>, ids in preorder."""
    schema = "array<struct<node_id: int, parent_id: int, child_ix: int, kind: string, pre_text: string>>"

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out = []

            def walk(n, parent, ix, depth):
                own = len(out)
                out.append({"node_id": own, "parent_id": parent, "child_ix": ix, "kind": n.get("kind", "BOX"), "pre_text": n.get("pre_text", "")})
                for k, c in enumerate(n.get("child", []) if depth else []):
                    walk(c, own, k, depth - 1)

            walk(json.loads(text), None, 0, DEPTH)
            return json.dumps(out)

        return s.map(one)

    return F.from_json(run(trees), schema)
