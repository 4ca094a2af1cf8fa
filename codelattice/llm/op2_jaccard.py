"""op2: near-duplicate components of `documents` at 100 * intersection >= 75 * union over 5-word shingles."""

from .common import table
from .jaccard_join import jaccard_components

NAME = "op2_jaccard_join"
#: The components are a transitive closure over a similarity join; DuckDB takes too long on whole tables. Tested against brute force.
SQL = None


def query(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), percent=75)
