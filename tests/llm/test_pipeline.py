import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codelattice.llm.common import table

from .test_jaccard import brute
from .test_models import page, text

RNG = random.Random(11)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of every kind that a stage looks for, among clean ones."""
    base = tmp_path_factory.mktemp("tables")
    item = " ".join(f"q{RNG.randrange(500)}x" for _ in range(40))
    rows, labels, kinds = [], [], {}
    for i in range(400):
        kind = ["clean", "clean", "clean", "toxic", "junk", "copy", "leak"][i % 7]
        body = {"clean": lambda: page(True), "toxic": lambda: text(True), "junk": lambda: page(False), "leak": lambda: page(True) + "\n" + item + "\n" + page(True), "copy": lambda: rows[RNG.randrange(0, 3)][1] if rows else page(True)}[kind]()
        rows.append((i, body, "en", "s", len(body)))
        kinds[i] = kind
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(base / "benchmark.parquet"))
    return str(base), kinds


def test_every_stage_works_on_what_its_predecessor_kept(spark, folder):
    base, kinds = folder
    docs = table(spark, base, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, base)
        assert docs.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "ngram_jaccard":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert set(kept[name]) == {c for d, n, c in brute(rows)}
    of = lambda name, kind: [d for d in kept[name] if kinds[d] == kind]
    n = {k: sum(x == k for x in kinds.values()) for k in set(kinds.values())}
    assert len(of("toxicity", "toxic")) <= 0.05 * n["toxic"] and len(of("toxicity", "clean")) >= 0.98 * n["clean"]
    assert len(of("quality", "junk")) <= 0.1 * n["junk"] and len(of("quality", "clean")) >= 0.97 * n["clean"]
    assert not of("decontaminate", "leak") and len(of("decontaminate", "clean")) == len(of("ngram_jaccard", "clean"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, base).collect()
    assert {r.doc_id for r in packed} == set(kept["decontaminate"])


def test_repeated_and_unnamed_rows(spark, folder):
    base, _ = folder
    rows = [(1, "a b c d e f", None, None, None)] * 3 + [(2, "a b c d e f", None, None, None), (None, "x", None, None, None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.deduplicate(spark, docs, base).collect()) == [0, 1, 3]
    assert corpus_pipeline.decontaminated(spark, docs, base).count() == 6


def test_columns_with_names_that_stages_use(spark, folder):
    """Extra columns, whatever their names, come through every stage but the last."""
    base, _ = folder
    extra = ["_score", "_leak", "score", "component_id", "n", "row", "count", "label", "h"]
    docs = table(spark, base, "documents").limit(40)
    for k, c in enumerate(extra):
        docs = docs.withColumn(c, F.lit(k))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
        assert docs.columns[-len(extra) :] == extra
    assert corpus_pipeline.STAGES[-1][1](spark, docs, base).count() > 0
    assert [docs.first()[c] for c in extra] == list(range(len(extra)))
