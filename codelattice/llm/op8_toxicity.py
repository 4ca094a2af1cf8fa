"""op8: toxicity of `documents` as `labels.toxic` marks it."""

from .common import table
from .kneser_ney import toxicity

NAME = "op8_toxicity"
#: Trained models are beyond SQL; tested by held-out accuracy.
SQL = None


def query(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
