"""Graph patterns: conjunctions of goals with variables and negated groups, compiled to joins.

    pattern  :=  item*
    item     :=  goal | "{" pattern "}" | "!{" pattern "}"
    goal     :=  term KIND term            an edge; KIND.N asks for the ordinal N; a leading % turns the edge round
              |  term ".FACT" term         a fact; the value is a string or a variable
              |  term "=" term             equality
    term     :=  Variable | _ | "string" | vname(signature, corpus, root, path, language) | @anchor

Kinds and facts are relative to the vocabulary unless they begin with a slash. Variables begin with a capital. A negated
group holds if its goals have no solution for the bindings of the variables that it shares with what stands outside.
The semantics is that of sets: all solutions are found, and a positive group is a plain part of the conjunction.
Anchors are resolved against a source text before the plan is made: @tok and @"two words" (the next place after the last),
@^tok (its start), @$tok (its end), @#2tok (the second), @+3tok (three lines on), @:12tok (line 12); they stand for the
anchors with that span in the file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edgekinds
from ..functions.uri import ticket
from ..model import REVERSE, vname
from ..operators.graph import Graph
from ..operators.refs import anchors

_TOKEN = re.compile(r'\s*(?:(//.*)|(!\{|[{}=(),])|("(?:[^"\\]|\\.)*")|(@[\^$]?(?:#\d+|\+\d+|:\d+)?(?:"(?:[^"\\]|\\.)*"|[^\s{}=(),"]+))|([^\s{}=(),"]+))')


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    kind: str  # var, any, text, vname, anchor
    value: object = None


@dataclass(frozen=True)
class Goal:
    left: Term
    label: str  # an edge kind, a fact with a leading ".", or "="
    right: Term


@dataclass
class Group:
    negated: bool = False
    items: list = field(default_factory=list)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PatternError(f"can't read {text[at : at + 20]!r}")
        at = m.end()
        if not m[1]:
            out.append(next(g for g in m.groups()[1:] if g))
    return out


def parse(text: str) -> Group:
    left = tokens(text)

    def term() -> Term:
        t = left.pop(0)
        if t == "_":
            return Term("any")
        if t.startswith("@"):
            return Term("anchor", t)
        if t.startswith('"'):
            return Term("text", re.sub(r"\\(.)", r"\1", t[1:-1]))
        if t == "vname":
            parts = []
            if left.pop(0) != "(":
                raise PatternError("vname needs its parts")
            while left[0] != ")":
                p = left.pop(0)
                if p != ",":
                    parts.append(re.sub(r"\\(.)", r"\1", p[1:-1]) if p.startswith('"') else "" if p == "_" else p)
            left.pop(0)
            if len(parts) != 5:
                raise PatternError("a vname has five parts")
            return Term("vname", tuple(parts))
        if t[:1].isupper():
            return Term("var", t)
        raise PatternError(f"no term: {t!r}")

    def group(negated: bool, closed: bool) -> Group:
        g = Group(negated)
        while left:
            if left[0] == "}":
                if not closed:
                    raise PatternError("a } too many")
                left.pop(0)
                return g
            if left[0] in ("{", "!{"):
                g.items.append(group(left.pop(0) == "!{", True))
                continue
            a = term()
            if not left:
                raise PatternError("a goal breaks off")
            label = left.pop(0)
            if not left:
                raise PatternError("a goal breaks off")
            g.items.append(Goal(a, label, term()))
        if closed:
            raise PatternError("a group isn't closed")
        return g

    try:
        return group(False, False)
    except IndexError:
        raise PatternError("the pattern breaks off") from None


def variables(g: Group) -> list[str]:
    out: dict[str, None] = {}
    for i in g.items:
        for v in variables(i) if isinstance(i, Group) else [t.value for t in (i.left, i.right) if t.kind == "var"]:
            out[v] = None
    return list(out)


def single_use(g: Group) -> list[str]:
    """Variables that occur once: most often a slip; _ says that it is meant."""
    seen: dict[str, int] = {}

    def walk(g):
        for i in g.items:
            if isinstance(i, Group):
                walk(i)
            else:
                for t in (i.left, i.right):
                    if t.kind == "var":
                        seen[t.value] = seen.get(t.value, 0) + 1

    walk(g)
    return [v for v, n in seen.items() if n == 1]


def anchor_spans(specs: list[str], source: str, line: int = 1) -> dict[str, tuple[int, int]]:
    """Byte spans of anchor specs in a source text. line: the line that the pattern stands on; places are sought from the next."""
    out, raw = {}, source.encode()
    starts = [0, *(m.end() for m in re.finditer(b"\n", raw))]
    for spec in specs:
        m = re.fullmatch(r'@([\^$]?)(?:(#)(\d+)|(\+)(\d+)|(:)(\d+))?("?)(.*?)\8', spec, re.S)
        text = re.sub(r"\\(.)", r"\1", m[9]).encode()
        nth, at = 1, starts[min(line, len(starts) - 1)] if line > 0 else 0
        if m[2]:
            nth = int(m[3])
        elif m[4]:
            at = starts[min(line + int(m[5]) - 1, len(starts) - 1)]
        elif m[6]:
            at = starts[min(int(m[7]) - 1, len(starts) - 1)]
        for _ in range(nth):
            found = raw.find(text, at)
            if found < 0:
                raise PatternError(f"{spec} isn't in the text")
            at = found + len(text)
        end = found + len(text)
        out[spec] = {"": (found, end), "^": (found, found), "$": (end, end)}[m[1]]
    return out


class Compiler:
    def __init__(self, graph: Graph, file: str | None = None, source: str | None = None, line: int = 0):
        self.graph, self.v, self.file, self.source, self.line = graph, graph.v, file, source, line
        self.facts, self.edges = graph.facts.select("ticket", "name", "value"), graph.edges

    def literal(self, t: Term):
        return F.lit(t.value) if t.kind == "text" else ticket(vname(*t.value), self.v)

    def bound(self, df: DataFrame, sides: list[tuple[str, Term]]) -> DataFrame:
        """df with the columns of its sides restricted to constants or renamed to variables."""
        out, columns = df, {}
        for column, t in sides:
            if t.kind in ("text", "vname"):
                out = out.where(F.col(column) == self.literal(t))
            elif t.kind == "anchor":
                if self.source is None or self.file is None:
                    raise PatternError("anchors need a file and its text")
                start, end = anchor_spans([t.value], self.source, self.line)[t.value]
                spans = anchors(self.graph).where((F.col("file") == self.file) & (F.col("start") == start) & (F.col("end") == end)).select(F.col("anchor").alias(column))
                out = out.join(spans, column, "left_semi")
            elif t.kind == "var":
                if t.value in columns:
                    out = out.where(F.col(column) == F.col(columns[t.value]))
                else:
                    columns[t.value] = column
        return out.select(*(F.col(c).alias(v) for v, c in columns.items())).distinct() if columns else out.select(F.lit(1).alias("_one")).limit(1)

    def goal(self, g: Goal) -> DataFrame:
        if g.label.startswith("."):
            name = g.label[1:]
            name = name if name.startswith("/") else self.v.fact(name)
            f = self.facts.where(F.col("name") == name).select("ticket", F.col("value").cast("string").alias("value"))
            return self.bound(f, [("ticket", g.left), ("value", g.right)])
        left, right, label = g.left, g.right, g.label
        if label.startswith(REVERSE):
            left, right, label = right, left, label[1:]
        m = re.fullmatch(r"(.+)\.(\d+)", label)
        kind, number = (m[1], int(m[2])) if m else (label, None)
        e = self.edges.where(F.col("kind") == (kind if kind.startswith("/") else self.v.edge(kind)))
        if number is not None:
            e = e.where(F.col("ordinal") == number)
        return self.bound(e, [("src", left), ("dst", right)])

    def solutions(self, g: Group) -> DataFrame | None:
        """All bindings of a group's variables; None for an empty group. Goals that share variables are joined before others."""
        parts, equal, negated = [], [], []
        for i in g.items:
            if isinstance(i, Group):
                (negated if i.negated else parts).append(i if i.negated else self.solutions(i))
            elif i.label == "=":
                equal.append(i)
            else:
                parts.append(self.goal(i))
        parts, out = [p for p in parts if p is not None], None
        while parts:
            at = next((k for k, p in enumerate(parts) if out is not None and set(p.columns) & set(out.columns)), 0)
            p = parts.pop(at)
            shared = [] if out is None else [c for c in p.columns if c in out.columns]
            # Goals without a common variable multiply; the pattern asks for it.
            out = p if out is None else out.join(p, shared) if shared else out.crossJoin(p)
        for q in equal:
            a, b = sorted((q.left, q.right), key=lambda t: t.kind != "var")
            if a.kind != "var" or out is None or a.value not in out.columns:
                raise PatternError("an equality needs a variable that a goal binds")
            if b.kind == "var" and b.value not in out.columns:
                out = out.withColumn(b.value, F.col(a.value))
            else:
                out = out.where(F.col(a.value) == (F.col(b.value) if b.kind == "var" else self.literal(b)))
        for n in negated:
            found = self.solutions(Group(items=n.items))
            if found is None or out is None:
                raise PatternError("a negated group needs goals, within and beside it")
            shared = [c for c in found.columns if c in out.columns and c != "_one"]
            out = out.join(found.select(*shared).distinct(), shared, "left_anti") if shared else out.join(found.limit(1).select(F.lit(1).alias("_some")), F.lit(True), "left_anti")
        return out


def solve(graph: Graph, pattern: str, file: str | None = None, source: str | None = None, line: int = 0) -> DataFrame:
    """All solutions of a pattern: one column for each variable outside negated groups."""
    out = Compiler(graph, file, source, line).solutions(parse(pattern))
    if out is None:
        raise PatternError("an empty pattern")
    return out.drop("_one").distinct() if set(out.columns) - {"_one"} else out


def violations(graph: Graph) -> DataFrame:
    """(ticket, name, n_values): facts that have more than one value."""
    return graph.conflicts().select("ticket", "name", "n_values")


def dot(graph: Graph) -> DataFrame:
    """Lines of a Graphviz digraph."""
    return graph.edges.select(F.concat(F.lit('"'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), edgekinds.base_kind("kind"), F.lit('"];')).alias("line"))


__all__ = ["PatternError", "anchor_spans", "dot", "parse", "single_use", "solve", "variables", "violations"]
