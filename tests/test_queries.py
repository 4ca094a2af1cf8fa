import pytest

from codelattice import queries_replies  # noqa: F401
from codelattice.queries_requests import ORACLES, QUERIES

from .compare import duck, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tables, name):
    got = QUERIES[name](spark, tables).toPandas()
    if name in ORACLES:
        want = duck(ORACLES[name], tables)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


ABSENT = "import sys; sys.modules['public_tokenizers'] = None; sys.modules['xxhash'] = None; "


@pytest.mark.parametrize("what", ["folders", "a library"])
def test_the_rest_stands_without_the_subpackage(tmp_path, what):
    """A query runs, not just the import, with the folders deleted or with a library of theirs missing."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("codelattice", "__spark_entry__.py", *(["corpus_pipeline.py"] if what == "a library" else [])):
        if (root / name).exists():
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    if what == "folders":
        shutil.rmtree(tmp_path / "codelattice" / "llm", ignore_errors=True)
    code = f"""{ABSENT if what == "a library" else ""}import __spark_entry__ as e
assert len(e.queries()) > 40 and 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.queries())
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert e.queries()['tickets_encode'](s, '/root/testdata/sf0.001').count()"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert not done.returncode, done.stderr
