"""All that is known of a corpus of scripts, as named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lex, lint, resolve, statements


def analyze_corpus(files: DataFrame, symbols: DataFrame, returns: DataFrame, methods: DataFrame, bases: DataFrame) -> dict[str, DataFrame]:
    """Lazy tables of a corpus: tokens, statements, errors, implicit, misuse, types, and a summary with one row per file.

    The files are read once by each table that is used; null texts have no tokens, statements or misuse.
    """
    made = statements.generator_statements(files)
    out = {
        "tokens": lex.tokens(files),
        "statements": made,
        "errors": statements.statement_errors(files),
        "implicit": statements.implicit_files(files).select("file_id"),
        "misuse": lint.misuse(files),
        "types": resolve.generator_types(made, returns, methods, bases),
    }
    per_file = lambda table, name: table.groupBy("file_id").agg(F.count("*").alias(name))
    summary = files.select("file_id", "ext")
    for table, name in ((lex.caret_tokens(files), "carets"), (made, "generators"), (out["errors"], "errors"), (out["misuse"], "misuse")):
        summary = summary.join(per_file(table, name), "file_id", "left").fillna(0, [name])
    summary = summary.join(out["implicit"].withColumn("implicit", F.lit(True)), "file_id", "left").fillna(False, ["implicit"])
    return out | {"summary": summary}
