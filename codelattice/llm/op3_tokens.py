"""op3: token counts of `documents` by byte_bpe_50k.json."""

import public_tokenizers

from .common import table
from .token_counts import token_counts

NAME = "op3_token_counts"
#: BPE merges are beyond SQL; tested against the library on whole texts.
SQL = None
LIMIT = 512


def query(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT)
