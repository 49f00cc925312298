"""Interface stubs as relations: declarations, bases of classes, methods and return classes (S6 for J6, J11, M4).

One pass parses every stub and gives facts, in which names are as the file writes them. The relations join a file's
names with its own imports, so that an alias means the class that it was imported as.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import alias_classes, anchor, entry_targets, namespace, settled, stub_symbols
from .files import declared_in, module_of

FACTS = "relation string, path string, module string, pos int, owner string, name string, kind string, annotation string, imported_name string, src int, return_kind string, return_names array<string>"
#: Wrappers whose argument is the type itself, and those that list alternatives or elements. Fixed values of the typing module.
_PLAIN = ("Annotated", "ClassVar", "Final", "Required", "NotRequired", "ReadOnly")
_TUPLES = ("tuple", "Tuple")


def _last(node: ast.expr) -> str | None:
    """The last name of a dotted path, without what it is subscripted by."""
    if isinstance(node, ast.Subscript):
        return _last(node.value)
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def annotated(node: ast.expr | None) -> tuple[str | None, list[str | None]]:
    """What an annotation says: ("instance", [class]), ("tuple", its elements' classes), ("union", its members), or (None, []) for none.

    Quoted annotations are read like plain ones. None is left out of a union, and a union of one class is that class.
    """
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return annotated(ast.parse(node.value.strip(), mode="eval").body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None, []
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return _union([node.left, node.right])
    if isinstance(node, ast.Subscript):
        name = _last(node.value)
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        if name == "Optional" or name == "Union":
            return _union(inner)
        if name in _PLAIN:
            return annotated(inner[0])
        if name in _TUPLES:
            elements = [annotated(x) for x in inner if not (isinstance(x, ast.Constant) and x.value is Ellipsis)]
            return "tuple", [names[0] if kind == "instance" else "tuple" if kind == "tuple" else None for kind, names in elements]
        return "instance", [name] if name else []
    name = _last(node) if node else None
    return ("tuple", []) if name in _TUPLES else ("instance", [name]) if name else (None, [])


def _union(members: list[ast.expr]) -> tuple[str | None, list[str | None]]:
    found = []
    for m in members:
        if not (isinstance(m, ast.Constant) and m.value is None):
            kind, names = annotated(m)
            found += [(kind, names)] if kind != "union" else [("instance", [n]) for n in names]
    if len(found) == 1:
        return found[0]
    return ("union", [names[0] for kind, names in found if kind == "instance"]) if found else (None, [])


def facts_of(text: str) -> list[dict]:
    """The facts of one stub; what does not parse has none. Classes and functions inside others are no declarations."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    try:
        declared = declared_in(body)
    except (ValueError, RecursionError, MemoryError):
        declared = []
    out = [{"relation": "symbol", "name": n, "kind": k, "annotation": a, "owner": m, "imported_name": i, "src": s, "pos": p} for n, k, a, m, i, s, p in declared]
    given = lambda node: dict(zip(("return_kind", "return_names"), annotated(node.returns), strict=True))
    functions = ast.FunctionDef | ast.AsyncFunctionDef
    for node in body:
        if isinstance(node, functions):
            out.append({"relation": "return", "name": node.name, "pos": node.lineno} | given(node))
        elif isinstance(node, ast.ClassDef):
            names = [x for b in node.bases if (x := _last(b))]
            out += [{"relation": "base", "owner": node.name, "name": x, "pos": i} for i, x in enumerate(names)]
            # In a class an attribute that is assigned from a method is that method.
            made = {}
            for x in node.body:
                if isinstance(x, functions):
                    made.setdefault(x.name, (x.lineno, given(x)))
                elif isinstance(x, ast.Assign) and isinstance(x.value, ast.Name) and x.value.id in made:
                    made |= {t.id: (x.lineno, made[x.value.id][1]) for t in x.targets if isinstance(t, ast.Name)}
            out += [{"relation": "method", "owner": node.name, "name": n, "pos": at} | what for n, (at, what) in made.items()]
    return out


def read_stubs(stubs: DataFrame) -> DataFrame:
    """Stub files (path, text) to facts; null texts and those that do not parse have none.

    The relations read the facts many times, so the files are dealt out evenly, parsed once and the facts settled.
    """
    names = [x.split()[0] for x in FACTS.split(", ")]
    kinds = [pa.int32() if t == "int" else pa.list_(pa.string()) if t.startswith("array") else pa.string() for t in (x.split()[1] for x in FACTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [fact | {"path": path, "module": module_of(path or "")} for fact in facts_of(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return settled(stubs.select("path", "text").repartition("path").mapInArrow(run, FACTS))


def symbols(facts: DataFrame) -> DataFrame:
    """The declarations of `schema.SYMBOLS`."""
    module = F.when(F.col("kind") == "import", F.col("owner")).otherwise(F.col("module"))
    return facts.where("relation = 'symbol'").select("name", "kind", module.alias("module"), "path", "annotation", "imported_name", "src", "pos")


def _meanings(facts: DataFrame) -> DataFrame:
    """(path, written, meant): what the imported names of each file are called where they are declared."""
    declared = symbols(facts)
    imports = stub_symbols(declared).where("kind = 'import'").groupBy("path", "name").agg(F.min_by(F.struct("module", "imported_name"), "pos").alias("i"))
    imports = imports.select("path", F.col("name").alias("written"), "i.module", "i.imported_name")
    found = alias_classes(imports, declared).select("module", "imported_name", "class_name")
    rows = imports.join(found.hint("merge"), ["module", "imported_name"], "left")
    return rows.select("path", "written", F.coalesce("class_name", "imported_name").alias("meant"))


def _meant(rows: DataFrame, column: str, facts: DataFrame) -> DataFrame:
    """The rows with a column's name replaced by what it means in the row's file."""
    m = _meanings(facts).withColumnRenamed("path", "m_path")
    joined = rows.join(m.hint("merge"), (rows.path == m.m_path) & (rows[column] == m.written), "left")
    return joined.withColumn(column, F.coalesce("meant", column)).drop("m_path", "written", "meant")


def bases(facts: DataFrame) -> DataFrame:
    """(class_name, base) of the stub tree's classes, `schema.BASES`."""
    rows = stub_symbols(facts.where("relation = 'base'").select("path", F.col("owner").alias("class_name"), F.col("name").alias("base")))
    return _meant(rows, "base", facts).select("class_name", "base").distinct()


def methods(facts: DataFrame) -> DataFrame:
    """(class_name, method, return_kind, return_elems), `schema.METHODS`: of classes of one name, the first by path."""
    rows = stub_symbols(facts.where("relation = 'method'").select("path", "pos", F.col("owner").alias("class_name"), F.col("name").alias("method"), "return_kind", F.posexplode_outer("return_names").alias("k", "written_name")))
    rows = _meant(rows, "written_name", facts)
    elems = F.transform(F.array_sort(F.collect_list(F.struct("k", "written_name"))), lambda x: x["written_name"])  # as many as the annotation has
    rows = rows.groupBy("class_name", "method", "path", "pos").agg(F.first("return_kind").alias("return_kind"), F.when(F.first("return_kind").isNotNull(), elems).alias("return_elems"))
    best = F.min_by(F.struct("return_kind", "return_elems"), F.struct("path", "pos")).alias("m")
    return rows.groupBy("class_name", "method").agg(best).select("class_name", "method", "m.return_kind", "m.return_elems")


def returns(facts: DataFrame) -> DataFrame:
    """(callee, class_name): the class of what a call gives; of several declarations of a name the first.

    A function gives what its annotation says (a tuple or a union is no class), a class its instances, and a name
    that the namespace imports what its target gives. The namespace's own declaration of a name comes first, then path and place.
    """
    declared = symbols(facts)
    made = stub_symbols(facts.where("relation = 'return'").select("path", "pos", "name", F.when(F.col("return_kind") == "instance", F.get("return_names", F.lit(0))).alias("class_name")))
    made = _meant(made, "class_name", facts).withColumn("rank", F.lit(0))
    classes = stub_symbols(declared).where("kind = 'class'").select("path", "pos", "name", F.col("name").alias("class_name"), F.lit(1).alias("rank"))
    home = F.broadcast(anchor(declared).select(F.col("path").alias("home")))  # one row
    every = made.select("name", "path", "pos", "class_name", "rank").unionByName(classes.select("name", "path", "pos", "class_name", "rank")).join(home, F.lit(True), "left")
    every = every.withColumn("far", F.when(F.col("path") == F.col("home"), 0).otherwise(1))
    found = every.groupBy("name").agg(F.min_by("class_name", F.struct("far", "rank", "path", "pos")).alias("class_name"), F.min("far").alias("far"))
    aliases = entry_targets(namespace(declared), declared).where("kind = 'import' AND target_kind IN ('function', 'class')").select(F.col("name").alias("callee"), F.col("target_name").alias("name"), "target_path")
    at_target = every.groupBy("name", "path").agg(F.min_by("class_name", F.struct("rank", "pos")).alias("class_name"))
    via = aliases.join(at_target.withColumnRenamed("path", "target_path").hint("merge"), ["name", "target_path"]).select("callee", F.col("class_name").alias("via"))
    rows = found.withColumnRenamed("name", "callee").join(via.hint("merge"), "callee", "full")
    # The namespace's function or class of a name beats its import; the import beats what the rest of the tree has.
    return rows.select("callee", F.when(F.col("far") == 0, F.col("class_name")).otherwise(F.coalesce("via", "class_name")).alias("class_name")).where("class_name IS NOT NULL")
