"""Session helpers shared by the operators: shared storage, table reading, id Bloom filters."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte class of white space in the texts: [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; on a local master, a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gridlake-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns a scan of it.

    The lineage is cut at files that survive lost executors.  The JVM deletes them when the
    session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS, ARROW_BYTES = 4000, 8 << 20


def hand_back() -> None:
    """Gives the memory this process freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, work: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in bounded memory.

    The session's Arrow batches are lowered to ``ARROW_ROWS`` rows and ``ARROW_BYTES`` where they are
    larger, and each task hands the memory it freed back to the system, as workers are used again.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        held = int(re.sub(r"\D", "", conf.get(f"spark.sql.execution.arrow.{key}")))
        if not 0 < held <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        hand_back()

    return df.mapInArrow(run, schema)


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column in ``taken`` has it (case does not count)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bloom(ids: DataFrame, column: str, most_bits: int = 1 << 27, bits_each: int = 16):
    """A bit set with one bit for each ``xxhash64(column)``, as (broadcast words, bits).

    The set has at most ``most_bits`` (16 MB), whatever the number of ids; past that size only its
    share of false positives grows, and callers join exactly behind it.  The words are OR-ed by a
    partial aggregate, so no list of ids reaches the driver.
    """
    spark = ids.sparkSession
    n = ids.count()
    bits = 1 << 10
    while bits < min(most_bits, bits_each * max(n, 1)):
        bits <<= 1
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    rows = (
        ids.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )
    words = np.zeros(bits >> 6, dtype=np.uint64)
    table = rows.toArrow()
    if table.num_rows:
        words[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(words), bits


def bloom_hash(column: str) -> Column:
    """The column that :func:`bloom_has` tests."""
    return F.xxhash64(F.col(column))


def bloom_has(words: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.int64) & np.int64(bits - 1)
    return (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
