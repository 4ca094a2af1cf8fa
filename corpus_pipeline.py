"""From raw documents to packed sequences: toxicity, quality, near-duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of docs; the last returns the packed
pieces. Between stages rows are written as Parquet and read again. Rows without a doc_id can't be labelled or grouped:
they are scored and checked like all others, and the near-duplicate stage keeps them.
"""

import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from codelattice.llm import decontaminate, kneser_ney, line_crf
from codelattice.llm.common import BROADCAST_IDS, dropped, fresh, stored, table, with_column
from codelattice.llm.jaccard_join import jaccard_components
from codelattice.llm.packing import pack

TOXIC = 0.5


def toxicity(spark, docs, sf_dir):
    """Drops documents whose toxicity score is 0.5 or more."""
    score = kneser_ney.scoring(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "_score")
    return with_column(docs, name, DoubleType(), score).where(F.col(name) < TOXIC).select(*docs.columns)


def quality(spark, docs, sf_dir):
    """Drops documents whose quality score is below 0.3."""
    score = line_crf.scoring(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "_score")
    return with_column(docs, name, DoubleType(), score).where(F.col(name) >= line_crf.KEEP).select(*docs.columns)


def deduplicate(spark, docs, sf_dir):
    """Keeps of each component of near-duplicates the document with the smallest doc_id, in one row."""
    rows = stored(jaccard_components(docs, percent=75), "components")
    gone = rows.where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    again = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = again.limit(BROADCAST_IDS + 1).count()
    if not n:
        return kept
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontaminated(spark, docs, sf_dir):
    """Drops documents that hold a passage of the benchmark."""
    for leaks in decontaminate.leak_tests(spark, table(spark, sf_dir, "benchmark")):
        name = fresh(docs, "_leak")
        docs = with_column(docs, name, BooleanType(), leaks).where(~F.col(name)).drop(name)
    return docs


def packed(spark, docs, sf_dir):
    """Packs what is left into sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("toxicity", toxicity), ("quality", quality), ("ngram_jaccard", deduplicate), ("decontaminate", decontaminated), ("pack", packed)]

#: Trained models and transitive closures are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
