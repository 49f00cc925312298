"""A training corpus from `documents`: quality, line dedup, near duplicates, decontamination, packing.

Every stage works on all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import documents, materialize
from glyphlake.llm.decontamination import decontaminate
from glyphlake.llm.line_dedup import removed_lines
from glyphlake.llm.ngram_join import ngram_join
from glyphlake.llm.packing import pack
from glyphlake.llm.quality import judge

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Near duplicates: shingles of five words, at least this similarity in percent.
SHINGLE, PERCENT = 5, 80


#: The columns that stages read; others pass through under names that clash with nothing.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def guarded(stage: Stage) -> Stage:
    """The stage, returning the columns that it is given, whatever their names."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*(c if c in OWN else f"_x{i}" for i, c in enumerate(docs.columns)))
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


@guarded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models of trusted text accept; those with nothing to judge stay (see `judge`)."""
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), docs.columns).where("kept").select(docs.columns)


@guarded
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier line matches; one that loses lines and keeps no word goes.

    Rows of one id are one document; rows without an id neither match nor lose lines. Null texts stay.
    """
    gone = removed_lines(docs).where(F.size("removed") > 0).select(F.col("doc_id").alias("_id"), F.col("removed").alias("_removed"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_removed", i.cast("long")))
    some = F.exists("_kept", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.join(gone, docs.doc_id == F.col("_id"), "left").withColumn("_kept", F.when(F.col("_id").isNotNull(), kept))
    out = out.where(F.col("_id").isNull() | F.col("text").isNull() | some).withColumn("text", F.when(F.col("_id").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_id").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)


@guarded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents; rows of one id are one document, rows without an id stay."""
    return _without(docs, ngram_join(docs, shingle=SHINGLE, percent=PERCENT).where("component_id <> doc_id"))


@guarded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item. Rows of one id are one document; rows without an id are judged each."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = lambda x: _without(x, decontaminate(x, items).where("contaminated AND doc_id IS NOT NULL"))
    named, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    if not nameless.limit(1).count():
        return clean(docs)
    kind = docs.schema["doc_id"].dataType
    numbered = materialize(nameless.withColumn("doc_id", F.monotonically_increasing_id()))
    return clean(named).unionByName(clean(numbered).withColumn("doc_id", F.lit(None).cast(kind)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: The models and the linear program cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
