"""What the training-data operators share: scratch tables, text columns, byte-level hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees. Where it is unset, a temporary one in local mode; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/glyphlake/{uuid.uuid4().hex}"


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back; later jobs read it instead of recomputing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialize has written and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def lean(spark: SparkSession) -> None:
    """Sends texts to Python in batches of 1,000 rows, unless the session asks for another number than the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def hold() -> None:
    """Lets the C allocator keep what is freed, up to 64 MB, for arrays that come and go by the megabyte; trim gives it back."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def trim() -> None:
    """Gives memory that the allocators hold but do not use back to the system, for workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd-ish 64-bit value for each byte, and the base of the rolling hash.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 8) -> DataFrame:
    """left joined with right, which has each key once: right's rows are copied so that a hot key of left spreads over tasks."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(right, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each endpoint of the edges (a, b) reaches.

    Labels spread by minimum over the edges, then jump to their label's label; the rounds grow with the
    logarithm of a component's width. Every round is a table in the shared folder.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = held = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    while True:
        # A hub of many edges and the label of a large component are hot keys: adaptive execution splits these plain joins.
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        new = labels.join(near, "id").join(jump, "component", "left")
        new = materialize(new.select("id", F.least("component", "near", "jump").alias("component"), (F.least("near", "jump") < F.col("component")).alias("moved")))
        discard(held)
        labels, held = new.select("id", "component"), new
        if not new.where("moved").limit(1).count():
            discard(edges)
            return labels
