"""op5: passages of `benchmark` in `documents`."""

from .common import table
from .decontaminate import contaminated

NAME = "op5_decontaminate"
#: Alignment of windows and slots is beyond plain SQL; tested against brute force.
SQL = None


def query(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
