"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

The texts are read once: each row leaves a narrow fingerprint row (id, length, SHA-256, 64-bit hash) in a
scratch table, laid out by ranges of the hash without a shuffle. Each range has a Bloom filter of bounded size, so
what is broadcast does not grow with the input, only the number of ranges does. Pass 1 sets two slots of one block
for every hash, counted task by task before they are shuffled, and keeps as bitmaps the slots that more than one
row set. Pass 2 tests each row of the range against its block. Only rows with both slots repeated are shuffled by
SHA-256; all others are unique for certain and go straight to the result. False positives cost a shuffled row,
never a wrong answer, for the groups are formed on SHA-256.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, scratch, text_of

#: Bits of a range's filter at most (16 MB as bitmaps), which bounds what is broadcast at once.
MAX_BITS = 1 << 27
#: Bits for each row, and in a block of the filter (a bitmap of Spark's).
BITS_PER_ROW, BLOCK = 16, 32768
#: Copies of a group's verdict, so that a group holding a third of all rows is joined in several tasks.
SALTS = 8


def _maybe_repeated(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows of one range with `maybe`: whether the filter, of so many blocks, has both slots of the hash repeated."""
    rows = rows.withColumn("b", F.pmod("h", F.lit(blocks)))
    places = [F.pmod(F.xxhash64("h", F.lit(i)), F.lit(BLOCK)) for i in (1, 2)]
    repeated = rows.select("b", F.explode(F.array_distinct(F.array(*places))).alias("place")).groupBy("b", "place").agg(F.count("*").alias("c")).where("c > 1")
    bitmaps = F.broadcast(materialize(repeated.groupBy("b").agg(F.bitmap_construct_agg("place").alias("bm"))))

    def held(place):
        byte = F.conv(F.hex(F.substring("bm", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))

    return rows.join(bitmaps, "b", "left").withColumn("maybe", held(places[0]) & held(places[1])).drop("b", "bm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after removing ASCII white space. The row with the most code points stays,
    then the one with the smallest id (null ids first); of wholly repeated rows exactly one stays. A null text
    is an empty one; empty texts equal each other. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    wanted = BITS_PER_ROW * max(1, docs.count())
    ranges = -(-wanted // max(max_bits, BLOCK))
    blocks = -(-wanted // ranges // BLOCK)
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"), F.monotonically_increasing_id().alias("rid"))
        .select("doc_id", "rid", F.length("t").alias("n"), F.regexp_replace("t", SPACE, "").alias("norm"))
        .select("doc_id", "rid", "n", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("h"))
        .withColumn("range", F.pmod(F.xxhash64("h", F.lit(0)), F.lit(ranges)).cast("int"))
    )
    path = scratch(spark)
    (rows.write.partitionBy("range") if ranges > 1 else rows.write).parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    tested = reduce(DataFrame.unionByName, (_maybe_repeated(rows.where(F.col("range") == r), blocks) for r in range(ranges)))
    maybe, rest = tested.where("maybe"), tested.where("NOT maybe")
    verdict = maybe.groupBy("sha").agg(F.min(F.struct((-F.col("n")).alias("m"), "doc_id", "rid")).alias("best"), F.count("*").alias("size")).where("size > 1")
    verdict = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Not a self-join on columns of the same attribute ids: the verdict is renamed.
    verdict = verdict.select(F.col("sha").alias("vsha"), F.col("salt").alias("vsalt"), "best", "size")
    grouped = maybe.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(verdict, (F.col("sha") == F.col("vsha")) & (F.col("salt") == F.col("vsalt")), "left")
    single = F.col("size").isNull()
    out = grouped.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("best.rid") == F.col("rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return out.unionByName(rest.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")))
