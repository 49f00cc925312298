"""Name resolution (J1, J7, J8, P10) and types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ancestors, anchor, declared, find_class, follow_aliases, settled, stub_symbols
from .syntax import names, open_references


def candidate_counts(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """A3: (name, n), how many functions and classes of the stub tree a name could mean."""
    return names.select("name").distinct().join(declared(symbols).groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def find_declarations(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, tier, target_kind, target_path), one row per name; tier 0 means not found.

    Tiers: 1 namespace attribute, 2 namespace import (followed, or the import itself), 3 function or class of
    the namespace file, 4 of the stub tree. Unlike in the namespace table, an import beats a function here.
    """
    home = F.broadcast(anchor(symbols).select(F.col("path").alias("home")))
    rows = stub_symbols(symbols).where(F.col("kind").isin("attribute", "import", "function", "class")).join(home, F.lit(True), "left")
    here = F.coalesce(F.col("path") == F.col("home"), F.lit(False))
    tier = F.when(here & (F.col("kind") == "attribute"), 1).when(here & (F.col("kind") == "import"), 2).when(F.col("kind").isin("function", "class"), F.when(here, 3).otherwise(4))
    rows = rows.withColumn("tier", tier).where("tier IS NOT NULL")
    order = F.struct("tier", F.when(F.col("kind") == "class", 1).otherwise(0), "path", "pos")
    best = rows.groupBy("name").agg(F.min_by(F.struct("tier", "kind", "path", "module", "imported_name"), order).alias("d")).select("name", "d.*")
    found = names.select("name").distinct().join(best.hint("merge"), "name", "left")
    alias = follow_aliases(found.where("tier = 2"), symbols)
    found = found.join(alias.hint("merge"), ["module", "imported_name"], "left")
    return found.select("name", F.coalesce("tier", F.lit(0)).alias("tier"), F.coalesce("target_kind", "kind").alias("target_kind"), F.coalesce("target_path", "path").alias("target_path"))


def resolve_names(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line_no, start, name, origin, target_kind, target_path) of the references in the scripts' text.

    Qualified names, files with the explicit import, builtins and names that a scope around the reference binds are
    left to ordinary resolution and give no row. A name of the same generator statement wins (J7), then the catalog (J1).
    """
    open_ = settled(open_references(settled(names(files)), files))
    rows = open_.join(find_declarations(open_, symbols).hint("merge"), "name", "left")
    mine = F.col("own")
    origin = F.when(mine, "generator").when(F.col("tier") > 0, "catalog").otherwise("none")
    return rows.select("file_id", "line_no", "start", "name", origin.alias("origin"), F.when(mine, "target").otherwise(F.col("target_kind")).alias("target_kind"), F.when(~mine, F.col("target_path")).alias("target_path"))


def literal_types(assignments: DataFrame, symbols: DataFrame) -> DataFrame:
    """M3: (file_id, line_no, target, rhs) whose value itself is a number literal, with its class if the catalog has it."""
    value = F.regexp_replace(F.trim("rhs"), "_", "")
    kind = F.when(value.rlike(r"^(?:\d+|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"), "Integer").when(value.rlike(r"^(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?$"), "RealNumber")
    rows = assignments.withColumn("name", kind).where("name IS NOT NULL")
    classes = find_class(rows, symbols).where("class_path IS NOT NULL")
    return rows.join(classes, "name").select("file_id", "line_no", "target", F.col("name").alias("class_name"))


def factory_types(statements: DataFrame, returns: DataFrame) -> DataFrame:
    """M4: generator statements with factory_class, the declared return class of the callee (callee, class_name)."""
    return statements.join(returns.select("callee", F.col("class_name").alias("factory_class")).dropDuplicates(["callee"]).hint("merge"), "callee", "left")


def generator_types(statements: DataFrame, returns: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """T5 b, J11: (file_id, line_no, target, class_name): the factory's class for the first target, and for the
    generators what `_first_ngens` of that class, own or of the nearest ancestor that has it, returns: element 0 of a tuple, else the class; a union is none."""
    made = factory_types(statements, returns)
    gens = methods.where("method = '_first_ngens'").select(F.col("class_name").alias("ancestor"), F.when(F.col("return_kind").isin("tuple", "instance"), F.get("return_elems", F.lit(0))).alias("gen_class"))
    closure = ancestors(bases).join(gens.hint("merge"), "ancestor").groupBy("class_name").agg(F.min_by("gen_class", F.struct("distance", "ancestor")).alias("gen_class"))
    closure = closure.withColumnRenamed("class_name", "factory_class")
    rows = made.join(closure.hint("merge"), "factory_class", "left")
    pair = lambda target, kind: F.struct(target.alias("target"), kind.alias("class_name"))
    return rows.select("file_id", "line_no", F.inline(F.concat(F.array(pair(F.col("factory_name"), F.col("factory_class"))), F.transform("names", lambda x: pair(x, F.col("gen_class"))))))


def attribute_types(symbols: DataFrame) -> DataFrame:
    """T5 a, J5: (name, path, class_name) of stub attributes whose `_Type_*` annotation is an import of their file."""
    attributes = stub_symbols(symbols).where("kind = 'attribute' AND startswith(annotation, '_Type_')").select("name", "path", "annotation")
    imports = stub_symbols(symbols).where("kind = 'import'").select(F.col("name").alias("annotation"), "path", "module", "imported_name")
    rows = attributes.join(imports, ["annotation", "path"])
    return rows.join(follow_aliases(rows, symbols), ["module", "imported_name"]).where("target_kind = 'class'").select("name", "path", F.col("target_name").alias("class_name"))


def target_types(statements: DataFrame, assignments: DataFrame, symbols: DataFrame, returns: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """T5: generator statements first, number literals otherwise."""
    made = generator_types(statements, returns, methods, bases).where("class_name IS NOT NULL")
    plain = literal_types(assignments, symbols).join(made, ["file_id", "line_no", "target"], "left_anti")
    return made.unionByName(plain)


__all__ = ["attribute_types", "declared", "factory_types", "find_declarations", "generator_types", "literal_types", "resolve_names", "target_types"]
