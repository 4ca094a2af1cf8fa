import pytest

from codelattice.operators import refs, xrefs
from codelattice.operators.graph import Graph
from codelattice.plans import serving
from codelattice.queries import DEFS
from codelattice.sources.lift import Lift


@pytest.fixture(scope="module")
def both(spark, tables, tmp_path_factory):
    graph = Graph(Lift(spark, tables).entries(*DEFS, "parts_"))
    path = str(tmp_path_factory.mktemp("serving"))
    serving.write(graph, path, ["facts", "edges", "decorations", "xrefs", "callers"], 4)
    return graph, serving.Tables(spark, path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_replies_are_those_of_the_graph(both):
    graph, t = both
    file, part = "graph://tpch?path=orders/7", "graph://tpch?lang=tpch#part%2F7"
    assert rows(t.decorations(file, 0, 30)) == rows(refs.decorations(graph, 0, 30, file=file))
    assert rows(t.cross_references([part]).select("category", "anchor")) == rows(xrefs.categorised(graph).where(f"target = '{part}'").select("category", "anchor"))
    assert set(t.nodes([part], ["/tpch/*"]).first().facts) == {"/tpch/brand", "/tpch/type"}
    assert t.edges([part], page_size=3, page_token=1).count() == 3
    assert rows(t.callers([part])) == rows(refs.callers(graph).where(f"callee = '{part}'"))


def test_filters_reach_the_scan(both):
    _, t = both
    plan = t.decorations("graph://tpch?path=orders/7", 0, 30)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(file,graph://tpch?path=orders/7)" in plan and "Exchange hash" not in plan
    narrow = t.cross_references(["x"]).select("anchor")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in narrow and "scope" not in narrow.split("ReadSchema")[1]
