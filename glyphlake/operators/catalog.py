"""The catalog of declarations: anchor, namespace, aliases, callability.

A catalog may have any size, and Spark's estimates are far below it where names are made or exploded: by them it
would collect large sides on the driver. So joins that aliases, callability, resolution and completion go through are hinted to
be merged; the one side that is broadcast is the anchor, which has one row.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_stub, strip_category


def _row(*names: str) -> Column:
    return F.struct(*names)


def stub_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where(is_stub(F.col("path")))


def anchor(symbols: DataFrame) -> DataFrame:
    """(path) of the first stub function GF, by path and place; no row if there is none."""
    found = stub_symbols(symbols).where("kind = 'function' AND name = 'GF'")
    return found.agg(F.min_by("path", F.struct("path", "pos")).alias("path")).where("path IS NOT NULL")


def namespace(symbols: DataFrame) -> DataFrame:
    """(name, kind, module, path, annotation, imported_name), the first declaration of each name.

    Attributes, functions, classes, from-imports and listed names, in that order; a name that is only listed
    has a null kind. `__all__` itself is no name.
    """
    rows = stub_symbols(symbols).where("name <> '__all__'").join(F.broadcast(anchor(symbols)), "path", "left_semi")
    pick = F.min_by(_row("kind", "module", "path", "annotation", "imported_name"), F.struct("src", "pos")).alias("d")
    rows = rows.groupBy("name").agg(pick).select("name", "d.*")
    return rows.withColumn("kind", F.when(F.col("kind") != "listed", F.col("kind")))


def declared(symbols: DataFrame) -> DataFrame:
    """Functions, then classes, of the stub tree."""
    return stub_symbols(symbols).where(F.col("kind").isin("function", "class"))


def follow_aliases(aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(module, imported_name) to (…, kind, path, module) of the target; null where there is none.

    Same name in the module, same name anywhere, then both without the category suffix; one hop only.
    """
    d = declared(symbols).select(F.col("name").alias("d_name"), F.col("kind").alias("d_kind"), F.col("module").alias("d_module"), F.col("path").alias("d_path"), "pos")
    rows = aliases.select("module", "imported_name").distinct()
    rows = rows.withColumn("t", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("tier"), F.col("imported_name").alias("look")), F.struct(F.lit(2).alias("tier"), strip_category(F.col("imported_name")).alias("look"))))))
    hit = rows.join(d.hint("merge"), F.col("t.look") == F.col("d_name"), "left").where("t.tier = 0 OR t.look <> imported_name")
    order = F.struct(F.col("t.tier") + F.when(F.col("d_module") == F.col("module"), 0).otherwise(1), F.when(F.col("d_kind") == "function", 0).otherwise(1), "d_path", "pos")
    best = F.min_by(F.struct("d_name", "d_kind", "d_module", "d_path"), F.when(F.col("d_name").isNotNull(), order)).alias("b")
    out = hit.groupBy("module", "imported_name").agg(best)
    return out.select("module", "imported_name", F.col("b.d_name").alias("target_name"), F.col("b.d_kind").alias("target_kind"), F.col("b.d_module").alias("target_module"), F.col("b.d_path").alias("target_path"))


def alias_classes(aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """The alias's target if the pick is a class; the filter comes after the pick."""
    return follow_aliases(aliases, symbols).withColumn("class_name", F.when(F.col("target_kind") == "class", F.col("target_name")))


def entry_targets(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Namespace rows with (target_name, target_kind, target_path): aliases followed, else the row itself."""
    found = follow_aliases(names.where("kind = 'import'"), symbols)
    rows = names.join(found.hint("merge"), ["module", "imported_name"], "left")
    own = F.col("kind").isNull() | (F.col("kind") != "import") | F.col("target_kind").isNull()
    pick = lambda target, mine: F.when(own, F.col(mine)).otherwise(F.col(target)).alias(target)
    return rows.select("name", "kind", "module", "path", "annotation", "imported_name", pick("target_name", "name"), pick("target_kind", "kind"), pick("target_path", "path"))


def settled(df: DataFrame) -> DataFrame:
    """df from a table in the shared checkpoint folder: a loop's plan does not grow, and what is read several times is made once."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def ancestors(bases: DataFrame) -> DataFrame:
    """(class_name, ancestor, distance), the class itself at distance 0, of bases (class_name, base).

    Distinct pairs with their least distance, to a fixed point: each round joins the known pairs with themselves,
    so the rounds grow with the logarithm of the depth. Diamonds count once and cycles end; nulls are no classes.
    """
    pair = F.col("class_name").isNotNull() & F.col("ancestor").isNotNull() & (F.col("class_name") != F.col("ancestor"))
    steps = settled(bases.select("class_name", F.col("base").alias("ancestor"), F.lit(1).alias("distance")).where(pair).distinct())
    size = lambda: steps.agg(F.count("*"), F.coalesce(F.sum("distance"), F.lit(0))).first()
    seen = size()
    while True:
        up = steps.toDF("ancestor", "higher", "more")
        longer = steps.join(up.hint("merge"), "ancestor").select("class_name", F.col("higher").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")).where(pair)
        steps = settled(steps.unionByName(longer).groupBy("class_name", "ancestor").agg(F.min("distance").alias("distance")))
        before, seen = seen, size()
        if seen == before:
            break
    own = bases.select(F.explode(F.array("class_name", "base")).alias("class_name")).where("class_name IS NOT NULL").distinct()
    return steps.unionByName(own.select("class_name", F.col("class_name").alias("ancestor"), F.lit(0).alias("distance")))


def callable_names(targets: DataFrame, symbols: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """(name, is_callable): functions and classes; attributes whose class has or inherits __call__."""
    has_call = methods.where("method = '__call__'").select(F.col("class_name").alias("ancestor"))
    callable_classes = ancestors(bases).join(has_call.hint("merge"), "ancestor", "left_semi").select("class_name").union(has_call.toDF("class_name")).distinct()
    # An attribute's `_Type_*` annotation names an import of its module; any other annotation is the class.
    imports = symbols.where("kind = 'import'").select(F.col("name").alias("annotation"), F.col("path").alias("i_path"), F.col("module").alias("i_module"), F.col("imported_name").alias("i_name"))
    classes = alias_classes(imports.select(F.col("i_module").alias("module"), F.col("i_name").alias("imported_name")), symbols).select(F.col("module").alias("i_module"), F.col("imported_name").alias("i_name"), F.col("class_name").alias("via"))
    typed = imports.join(classes.hint("merge"), ["i_module", "i_name"]).select("annotation", "i_path", "via").dropDuplicates(["annotation", "i_path"])
    rows = targets.join(typed.hint("merge"), (targets.annotation == typed.annotation) & (targets.path == typed.i_path), "left").select("name", "target_kind", F.coalesce("via", targets.annotation).alias("class_name"))
    rows = rows.join(callable_classes.withColumn("yes", F.lit(True)).hint("merge"), "class_name", "left")
    return rows.select("name", (F.coalesce(F.col("target_kind"), F.lit("")).isin("function", "class") | ((F.col("target_kind") == "attribute") & F.coalesce("yes", F.lit(False)))).alias("is_callable")).withColumn("is_callable", F.coalesce("is_callable", F.lit(False)))


def find_class(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, class_path, class_module): the first class of that name in the stub tree."""
    classes = stub_symbols(symbols).where("kind = 'class'").groupBy("name").agg(F.min_by(F.struct("path", "module"), F.struct("path", "pos")).alias("c"))
    return names.select("name").distinct().join(classes, "name", "left").select("name", F.col("c.path").alias("class_path"), F.col("c.module").alias("class_module"))


#: Buckets of a stored catalog.
BUCKETS = 64


def store(symbols: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """The declarations as a table that is bucketed and sorted by name, and read back.

    Lookups by name (`find_class`, `resolve.find_declarations`, `resolve.candidate_counts`) group and join it as it lies: only the names that are
    asked for are shuffled, to its buckets, however often it is asked. An existing table of that name is replaced.
    """
    symbols.write.bucketBy(buckets, "name").sortBy("name").mode("overwrite").saveAsTable(table)
    return symbols.sparkSession.table(table)
