"""op7: all `documents` packed into sequences of at most 1024 tokens."""

import public_tokenizers

from .common import table
from .packing import pack

NAME = "op7_best_fit_packing"
#: Tokenization and packing are beyond SQL; tested against the library, a lower bound and gapless offsets.
SQL = None


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
