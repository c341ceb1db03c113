"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the ASCII controls 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
SPACES = rf"[{SPACE_CLASS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a temporary one of this machine does for a local master; a cluster needs spark.checkpoint.dir.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in a new folder below the shared one; the folder is removed when the application ends."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/eventloom-{name}-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{folder.toString()}/table"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: what a lambda captures is otherwise computed again for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Bits of a Bloom filter per key, and the most bits that are broadcast: 2^20 words, some 32 MB.
BITS_PER_KEY, MOST_BITS = 16, 1 << 26


def bloom_words(n_keys: int, most_bits: int | None = None) -> int:
    """64-bit words of a filter of n_keys keys: a power of two."""
    bits = max(64, 1 << max(0, BITS_PER_KEY * n_keys - 1).bit_length())
    return (min(bits, most_bits) if most_bits else bits) // 64


def bloom_place(value: Column, words: int) -> tuple[Column, Column]:
    """Where a value stands in a filter of so many words: its word, and a mask of up to four bits in it."""
    h = F.xxhash64(value)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52)).bitwiseOR(bit(58))
    return h.bitwiseAND(F.lit(words - 1)).cast("int"), mask


def bloom(keys: DataFrame, key: str, words: int) -> DataFrame:
    """_word, _bits: the Bloom filter of keys[key]."""
    word, mask = bloom_place(F.col(key), words)
    return keys.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def let_through(rows: DataFrame, column: Column, filter_: DataFrame, words: int, how: str = "left_semi") -> DataFrame:
    """The rows whose value the filter has (left_anti: has not).  It is broadcast only where its size is bounded by MOST_BITS."""
    word, mask = bloom_place(column, words)
    if 64 * words <= MOST_BITS:
        filter_ = F.broadcast(filter_)
    return rows.join(filter_, (word == F.col("_word")) & (F.col("_bits").bitwiseAND(mask) == mask), how)


def passing(rows: DataFrame, column: Column, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose value may be among keys[key] (with how="left_anti" those whose value surely isn't).

    A Bloom filter lets every value of keys through, and few others.  Its size follows the number of keys (a written
    table, so counting it is cheap) up to MOST_BITS, 4 million keys at full strength; with ever more keys it lets more and more through
    and stays right.  Null counts as a value.
    """
    words = bloom_words(keys.count(), MOST_BITS)
    return let_through(rows, column, bloom(keys, key, words), words, how)


SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, on: str, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """left joined on left[on] = right[key] (nulls meet), right having one row per key: a key that many rows of left share is spread over
    SALTS tasks by the hash of ``spread``, whatever adaptive execution makes of it.  key is dropped.  right is sent SALTS times, so it should be
    the smaller side by far; it is merged, never broadcast, as it has no bound."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    same = (F.col("_salt") == F.col("_salt2")) & F.col(on).eqNullSafe(F.col(key))
    return left.withColumn("_salt", salt).join(copies, same, how).drop("_salt", "_salt2", key)


def give_back() -> None:
    """Returns a worker's free memory to the system: workers outlive their tasks, and share an executor's memory with its JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may not have it
        if trim is not None:
            trim(0)
