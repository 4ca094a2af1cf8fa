"""Token counts of whole texts by a public tokenizer, with the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import slices, utf8


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text") -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs, in one pass without a shuffle.

    tokenizer: path of a tokenizers .json or a sentencepiece .model. Byte-level .json files take the shortcut of
    byte_bpe; the others are counted by their library on whole texts. No special tokens are added, nothing is cut
    or padded; special strings inside texts count as their library's default has it. A null text counts as empty;
    a null doc_id stays null. Very long texts are encoded whole.
    """
    if tokenizer.endswith(".json"):
        library = byte_bpe.load(tokenizer)
        if '"type":"ByteLevel"' in library.to_str().replace(" ", "") and library.normalizer is None:
            # The proof runs here, once; its size is that of the vocabulary.
            known = docs.sparkSession.sparkContext.broadcast(set(byte_bpe.proven(library)))
            count = lambda texts: byte_bpe.encoder(tokenizer, known.value).counts([t.decode() for t in texts])
        else:
            count = lambda texts: [len(e.ids) for e in _whole(tokenizer).encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    elif tokenizer.endswith(".model"):
        count = lambda texts: [len(ids) for ids in _whole(tokenizer).encode([t.decode() for t in texts], num_threads=1)]
    else:
        raise ValueError(f"not a tokenizer file: {tokenizer}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = utf8(b.column(1))
            n = count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", F.col(text)).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")


_WHOLE: dict = {}


def _whole(path: str):
    """The library's own object, once for a process; a tokenizers file without its truncation and padding."""
    if path not in _WHOLE:
        if path.endswith(".json"):
            _WHOLE[path] = byte_bpe.load(path)
            _WHOLE[path].no_truncation()
            _WHOLE[path].no_padding()
        else:
            import sentencepiece

            _WHOLE[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _WHOLE[path]
