"""Scripts, interface stubs and settings as DataFrames."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.templates import PUBLIC_CONDITIONS, editable, read_condition
from ..schema import RUNS, SETTINGS, SOURCES, SYMBOLS

# What a new script file starts with.
NEW_FILE = "# Sage file: plain Python + the implicit sage.all namespace.\n# ^ is power (preparsed to **); Python XOR is written ^^.\n"


def read_files(spark: SparkSession, root: str, glob: str = "*.sage") -> DataFrame:
    """(file_id, path, ext, text); the id is a hash of the path. An empty file gives no row."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    path = F.col("_metadata.file_path")
    return df.select(F.xxhash64(path).alias("file_id"), path.alias("path"), F.regexp_extract(path, r"\.([^./\\]+)$", 1).alias("ext"), F.col("value").alias("text"))


def write_files(fixed: DataFrame, path: str) -> None:
    """Fixed texts, one row per file."""
    fixed.select("file_id", "fixed_text").write.parquet(path)


def declarations(text: str) -> list[tuple]:
    """Top level of one stub: (name, kind, annotation, imported module, imported name, source, position)."""
    try:
        return declared_in(ast.parse(text).body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def declared_in(body: list[ast.stmt]) -> list[tuple]:
    """The declarations of a stub's statements."""
    out: list[tuple] = []
    add = lambda kind, name, annotation=None, module=None, imported=None: out.append((name, kind, annotation, module, imported, SOURCES.index(kind) + 1, len(out)))
    for node in body:
        if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            add("attribute", node.target.id, ast.unparse(node.annotation))
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                for t in target.elts if isinstance(target, ast.Tuple | ast.List) else [target]:
                    if isinstance(t, ast.Name):
                        add("attribute", t.id)
                    if isinstance(t, ast.Name) and t.id == "__all__" and isinstance(node.value, ast.List | ast.Tuple):
                        for e in node.value.elts:
                            if isinstance(e, ast.Constant) and isinstance(e.value, str):
                                add("listed", e.value)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            add("function", node.name, ast.unparse(node.returns) if node.returns else None)
        elif isinstance(node, ast.ClassDef):
            add("class", node.name)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.name != "*":
                    add("import", a.asname or a.name, None, node.module, a.name)
    return out


def module_of(path: str) -> str:
    """The dotted name of the module that a stub's path stands for."""
    tail = path.replace("\\", "/").rpartition("/site-packages/")[2].removesuffix(".pyi").removesuffix("/__init__")
    return tail.replace("/", ".")


def read_symbols(stubs: DataFrame) -> DataFrame:
    """Stub files (path, text) to the symbol relation; a stub that does not parse gives no rows. `stubs` reads the other relations too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = module_of(path or "")
                rows += [(n, k, m if k == "import" else own, path, a, i, s, p) for n, k, a, m, i, s, p in declarations(text or "")]
            c = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:6]), pa.array(c[6], pa.int32()), pa.array(c[7], pa.int32())], names=["name", "kind", "module", "path", "annotation", "imported_name", "src", "pos"])

    return stubs.select("path", "text").mapInArrow(run, SYMBOLS)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings rows from XML (<settings> elements)."""
    return spark.read.format("xml").option("rowTag", "settings").schema(SETTINGS).load(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "configuration").schema(RUNS).load(path)


def write_rows(df: DataFrame, path: str, row_tag: str) -> None:
    """S9."""
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", f"{row_tag}_list").save(path)


#: How user-made templates are stored: one element each, conditions inside.
TEMPLATE_ROW = "_key string, _topmost string, body string, condition array<struct<_id string, _class string>>, malformed string"


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """User-made templates, `schema.TEMPLATES`, and `malformed`, the text of an element that is none.

    A condition that is not known is null, which nothing fits. Templates without key or body, or with another topmost than true and false, are malformed too.
    """
    rows = spark.read.format("xml").option("rowTag", "template").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").option("ignoreSurroundingSpaces", "false").schema(TEMPLATE_ROW).load(path)
    known = F.transform(F.coalesce("condition", F.array().cast("array<struct<_id:string,_class:string>>")), lambda c: read_condition(c["_id"], c["_class"]))
    flag = F.lower(F.coalesce("_topmost", F.lit("false")))
    lacking = F.when(F.col("_key").isNull() | F.col("body").isNull(), F.lit("a template needs a key and a body")).when(~flag.isin("true", "false"), F.lit("topmost is true or false"))
    return rows.select(F.col("_key").alias("key"), "body", known.alias("conditions"), (flag == "true").alias("topmost"), F.lit(False).alias("builtin"), F.coalesce("malformed", lacking).alias("malformed"))


def write_templates(templates: DataFrame, path: str) -> None:
    """The user-made templates as XML; built-in ones are never written, nor are conditions that were not known."""
    kind = lambda c: F.struct(F.when(c.isin(*PUBLIC_CONDITIONS), c).otherwise("class").alias("_id"), F.when(~c.isin(*PUBLIC_CONDITIONS), c).alias("_class"))
    rows = editable(templates).select(F.col("key").alias("_key"), F.col("topmost").cast("string").alias("_topmost"), "body", F.transform(F.array_compact("conditions"), kind).alias("condition"))
    rows.write.format("xml").option("rowTag", "template").option("rootTag", "templates").save(path)


def new_file(spark: SparkSession, path: str) -> DataFrame:
    """S13."""
    return spark.createDataFrame([(path, NEW_FILE)], "path string, text string")
