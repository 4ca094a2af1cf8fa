"""Helpers shared by the operators: tables, the shared work folder, hashing of words, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows that Python code takes from an Arrow batch at once.
SLICE_ROWS = 512
#: Entries of a memo of words; a memo only holds pure functions of its keys and is emptied beyond that.
MEMO_WORDS = 80_000
#: Ids that may be broadcast (16 MB of longs in a hash relation); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Bytes that go to Python in one Arrow batch. Whole texts and packed blobs make rows large, so the session's bound is lowered.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: a folder of our own on a single machine (tests), an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="codelattice-"))
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of tasks that hand large rows to Python; it holds for the rest of the session and changes no result."""
    spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors. parts: columns to partition by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame, part: str = "") -> None:
    """Delete the files of a table that stored() has made (or of a partition, as "column=value"), once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles() if part in x}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_semi_join(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is in ids; the ids are broadcast only up to BROADCAST_IDS."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, "left_semi")


def give_back() -> None:
    """Returns unused memory of this process to the system; Python workers live on between tasks, and so does the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most that many rows; at the end the worker gives unused memory back."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """word -> f(word), computed once for each word and process; emptied when it is full, so its memory is bounded."""

    def __init__(self, f, most: int = MEMO_WORDS):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.f(word)
        return value


def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def hashed(words: list, memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), U64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15 * (2 * seed + 1) % 2**64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def fresh(docs: DataFrame, name: str) -> str:
    """The name, or where docs has such a column already, one like it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_column(docs: DataFrame, name: str, kind: DataType, f) -> DataFrame:
    """docs with one more column, computed from whole texts by f(list of UTF-8 texts) -> values; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    text = docs.columns.index("text")
    assert name not in docs.columns, f"{name} is a column already"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f(utf8(b.column(text))))], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, kind)]))
