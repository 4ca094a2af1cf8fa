"""op6: the ten best of all `documents` for every document whose doc_id is divisible by 20 as a query."""

from pyspark.sql import functions as F

from .bm25 import top_k
from .common import table

NAME = "op6_bm25_search"
#: Every query against every document is too slow for SQL on whole tables; tested against brute force.
SQL = None


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10)
