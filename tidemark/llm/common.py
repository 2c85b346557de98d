"""What the training-data operators share: reading tables, written intermediate results, Arrow helpers, workers' memory."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-casing of A-Z alone, as the contracts ask.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a batch that a worker looks at at once; words whose hash it remembers; bits of a filter of rows (Marks).
SLICE, REMEMBERED, MARK_BITS = 4 << 20, 100_000, 25
BATCH, BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
NULL_ID = (1 << 63) - 1
#: What a row is known by: its doc_id, NULL_ID for none, and a hash of its text.
ROW = ["doc_id", "row"]
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Arrow's own pools keep what was freed; the system's gives it back, which a worker that Spark uses again needs.
pa.set_memory_pool(pa.system_memory_pool())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A temporary one only on a local master without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


@contextmanager
def without_old_shuffles(spark: SparkSession):
    """Spark drops the shuffle files of each query that ends in here, as their results are written."""
    before = spark.conf.get(SHUFFLES, "false")
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder, where it outlives lost executors, and read again.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    with without_old_shuffles(spark):
        df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A column of texts with nulls as empty texts."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class WordHashes(dict):
    """Hashes of words, a bounded number of them remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


word_hashes = WordHashes()
#: A worker's caches by their operator's module.
_caches: dict[str, dict] = {}


def cache_of(module: str) -> dict:
    """This worker's cache for an operator, by its module; those of others, which ran in this worker before, are emptied."""
    for name, x in _caches.items():
        if name != module and x:
            x.clear()
            release()
    return _caches.setdefault(module, {})


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes."""
    for b in batches:
        n = max(1, b.num_rows * most // max(1, b.nbytes))
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)


def release() -> None:
    """Gives freed memory back to the system."""
    word_hashes.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bounded_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of at most BATCH bytes, unless the session says otherwise.

    Spark's own limit is by rows, and rows with long texts make batches of any size.
    """
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(BATCH))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes, in a worker that keeps no memory between tasks but its caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of(f.__module__)
        try:
            yield from f(sliced(batches))
        finally:
            release()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def batch(names: Sequence[str], columns: Sequence, types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=list(names))


def documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) alone, whatever other columns the table has."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def identified(docs: DataFrame, rest: Sequence[str] = ()) -> DataFrame:
    """(doc_id, row, text, rest) with NULL_ID for a null doc_id; ``rest`` is a struct of columns to carry along."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"), *carried)


class Marks:
    """A broadcast bitmap that tells rows which may be among some keys from those which surely aren't.

    It has 2**bits bits whatever there are of keys, 8 MB in all at most with its index, so that only rows with a chance of
    a partner have to be shuffled to it. A bit too many only shuffles a row too many.
    """

    def __init__(self, keys: DataFrame, *columns: str, bits: int = MARK_BITS):
        self.columns, self.mask = columns, (1 << bits) - 1
        h = self._hash()
        words = keys.select(F.shiftright(h, 6).alias("word_"), h.bitwiseAND(63).cast("int").alias("bit_"))
        self.words = checkpointed(words.groupBy("word_").agg(F.expr("bit_or(shiftleft(1L, bit_))").alias("bits_")))

    def _hash(self) -> Column:
        return F.xxhash64(*self.columns).bitwiseAND(self.mask)

    def _marked(self, rows: DataFrame) -> DataFrame:
        h = self._hash()
        return rows.withColumn("at_", h).join(F.broadcast(self.words), F.shiftright(F.col("at_"), 6) == F.col("word_"), "left").withColumn("marked_", F.coalesce(F.expr("shiftright(bits_, cast(at_ & 63 as int)) & 1") == 1, F.lit(False)))

    def there(self, rows: DataFrame) -> DataFrame:
        """Rows that may be among the keys."""
        return self._marked(rows).where("marked_").select(*[f"`{c}`" for c in rows.columns])

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that may be among the keys, and those that aren't."""
        m = self._marked(rows)
        columns = [f"`{c}`" for c in rows.columns]
        return m.where("marked_").select(*columns), m.where("not marked_").select(*columns)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; TIDEMARK_TOKENIZERS names another folder."""
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
