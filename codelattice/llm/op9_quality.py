"""op9: quality of `documents` as `labels.quality` marks it."""

from .common import table
from .line_crf import quality

NAME = "op9_quality_crf"
#: Trained models are beyond SQL; tested by held-out accuracy.
SQL = None


def query(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
