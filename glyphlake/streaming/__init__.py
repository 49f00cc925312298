"""The per-file operators over a stream of scripts.

Every operator but the catalog join looks at one file at a time, so the stream needs no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lint import misuse
from ..operators.statements import generator_statements


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    df = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sage").load(root)
    path = F.col("_metadata.file_path")
    return df.select(F.xxhash64(path).alias("file_id"), path.alias("path"), F.lit("sage").alias("ext"), F.col("value").alias("text"))


def watch(spark: SparkSession, root: str, out: str, checkpoint: str) -> list[StreamingQuery]:
    """Appends statements and misuse of files that arrive below root to Parquet tables below out."""
    files = stream_files(spark, root)
    return [
        table.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        for name, table in (("statements", generator_statements(files)), ("misuse", misuse(files)))
    ]
