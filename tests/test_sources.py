"""Readers, writers, catalog details, command lines, templates and the stream."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from glyphlake.functions import paths
from glyphlake.operators import catalog, complete, runcmd, templates
from glyphlake.sources import files as S
from glyphlake.sources import sink
from glyphlake.streaming import watch

STUB = """
from sage.rings.ring import Ring as Ring
from sage.misc import *
ZZ: _Type_ZZ
a, b = 1, 2
__all__ = ["ZZ", "hidden"]
def GF(q) -> Field: ...
class Field: ...
"""


def test_read_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.sage").write_text("R.<x> = GF(2)[]\né")
    (tmp_path / "y.py").write_text("pass")
    rows = S.read_files(spark, str(tmp_path)).collect()
    assert [(r.ext, r.text) for r in rows] == [("sage", "R.<x> = GF(2)[]\né")]


def test_read_symbols(spark):
    path = "/e/site-packages/sage/all.pyi"
    df = spark.createDataFrame([(path, STUB), ("/e/site-packages/sage/bad.pyi", "def ("), ("/e/site-packages/sage/no.pyi", None)], "path string, text string")
    got = {(r.name, r.kind, r.module, r.annotation) for r in S.read_symbols(df).collect()}
    assert got == {("Ring", "import", "sage.rings.ring", None), ("ZZ", "attribute", "sage.all", "_Type_ZZ"), ("a", "attribute", "sage.all", None), ("b", "attribute", "sage.all", None), ("__all__", "attribute", "sage.all", None), ("ZZ", "listed", "sage.all", None), ("hidden", "listed", "sage.all", None), ("GF", "function", "sage.all", "Field"), ("Field", "class", "sage.all", None)}
    names = {r.name: r.kind for r in catalog.namespace(S.read_symbols(df)).collect()}
    assert names == {"Ring": "import", "ZZ": "attribute", "a": "attribute", "b": "attribute", "hidden": None, "GF": "function", "Field": "class"}


def test_no_anchor_no_namespace(spark):
    df = spark.createDataFrame([("/e/site-packages/sage/all.pyi", "ZZ: int")], "path string, text string")
    assert catalog.namespace(S.read_symbols(df)).count() == 0


def test_settings_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("DOCKER", "/usr/bin/sage", "Ubuntu", "img", "/mnt", "sage", "-q")], S.SETTINGS)
    S.write_rows(df, str(tmp_path / "s"), "settings")
    assert S.read_settings(spark, str(tmp_path / "s")).collect() == df.collect()
    empty = spark.createDataFrame([(None,)], "execution_mode string")
    assert runcmd.with_defaults(empty).first().asDict() == runcmd.DEFAULTS


def test_new_file(spark):
    assert S.new_file(spark, "/x.sage").first().text.count("\n") == 2


@pytest.mark.parametrize(
    ("path", "want"),
    [(r"C:\Users\a\b.sage", "/mnt/c/Users/a/b.sage"), ("/home/u/a.sage", "/home/u/a.sage"), ("C:rel", "C:rel"), ("d:/", "/mnt/d/"), ("\\\\host\\x", "//host/x")],
)
def test_wsl_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(paths.wsl_path(F.col("p"))).first()[0] == want


def test_arguments(spark):
    rows = spark.createDataFrame([("  -q   --x ",), ("",), (None,), ("a\tb 'c d'",)], "p string").select(paths.arguments(F.col("p")).alias("a")).collect()
    assert [r.a for r in rows] == [["-q", "--x"], [], [], ["a\tb", "'c", "d'"]]


def test_library_paths(spark):
    cases = {"/opt/envs/sage/lib/site-packages/numpy/x.pyi": False, r"C:\site-packages\sage\all.pyi": True, "/site-packages/sage/all.py": False, "/site-packages/sagex/all.pyi": False}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.is_stub(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in got} == cases


def test_exactly_one(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert runcmd.exactly_one(df, "k").count() == 2
    with pytest.raises(PySparkException):
        runcmd.exactly_one(df.union(df), "k").collect()


def test_user_templates(spark):
    user = spark.createDataFrame([("sq", "($EXPR$)^2$END$ # $expr$", ["sage.rings.integer.Integer"], False, False), ("t", "<$EXPR$>", ["string"], False, False)], S.SYMBOLS and templates.TEMPLATES)
    bases = spark.createDataFrame([("my.Int", "sage.rings.integer.Integer")], "class_name string, base string")
    rows = spark.createDataFrame([(1, "sage", "x", "sq", "my.Int"), (2, "sage", "x", "sq", "other"), (3, "sage", "s", "t", "string"), (4, "py", "s", "t", "string")], "file_id long, ext string, expr string, key string, expr_type string")
    got = {r.file_id: (r.expanded, r.caret) for r in templates.expand(rows, user, bases).collect()}
    assert got == {1: ("(x)^2 # $expr$", 5), 3: ("<s>", 3)}
    assert templates.editable(templates.postfix_templates(spark)).count() == 0
    assert templates.postfix_templates(spark).count() == 28
    assert len(templates.LIVE) == 25


def test_completion_insert(spark):
    df = spark.createDataFrame([("GF", True, ""), ("GF", True, "("), ("pi", False, "")], "n string, c boolean, x string")
    text, caret = complete.insertion(F.col("n"), F.col("c"), F.col("x"))
    assert [tuple(r) for r in df.select(text, caret).collect()] == [("GF()", 3), ("GF", 3), ("pi", 2)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sage").write_text("R.<x> = GF(2)[]\nz = b'k' ^ m")
    for q in watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")):
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/statements")).first().factory_name == "R"
    assert spark.read.parquet(str(tmp_path / "out/misuse")).first().fix == "^^"


def test_scripts_as_files(spark, tmp_path):
    root = tmp_path / "out"
    rows = [(f"d{i % 3}/f{i}.sage", f"é = {i}\r\n") for i in range(40)] + [("top.sage", ""), ("none.sage", None)]
    df = spark.createDataFrame(rows, "path string, text string").repartition(5).withColumn("other", F.lit(1))
    sink.write_scripts(df, f"file://{root}")
    want = {p: t for p, t in rows if t is not None}
    found = lambda: {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert found() == want
    read = {r.path.split("/out/")[1]: r.text for r in S.read_files(spark, str(root)).collect()}
    assert read == {p: t for p, t in want.items() if t}
    # What is there is replaced only on demand, and a failure leaves all as it was.
    again = spark.createDataFrame([("new.sage", "x"), ("top.sage", "y")], "path string, text string").repartition(2)
    with pytest.raises(PySparkException):
        sink.write_scripts(again, f"file://{root}")
    assert found() == want and not list(root.glob("_staging-*"))
    sink.write_scripts(again, f"file://{root}", replace=True)
    assert found() == want | {"new.sage": "x", "top.sage": "y"}


@pytest.mark.parametrize("rows", [[("a.sage", "1"), ("a.sage", "2")], [("../a.sage", "1")], [("/a.sage", "1")], [(None, "1")], [("a/../../b.sage", "1"), ("ok.sage", "2")]])
def test_scripts_that_cannot_be_files(spark, tmp_path, rows):
    with pytest.raises(PySparkException):
        sink.write_scripts(spark.createDataFrame(rows, "path string, text string").repartition(2), str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_a_second_attempt_leaves_nothing(tmp_path):
    writer = sink.ScriptWriter(str(tmp_path), False)
    lost, kept = (writer.write(iter([Row(path="a.sage", text=t)])) for t in ("lost", "kept"))
    writer.commit([kept, None])
    assert lost.folder != kept.folder
    assert [p.name for p in tmp_path.rglob("*")] == ["a.sage"] and (tmp_path / "a.sage").read_text() == "kept"


def test_user_templates_round_trip(spark, tmp_path):
    rows = [("sq", "($EXPR$)^2 < 3 & 'x'", ["list", "sage.rings.integer.Integer"], True, False), ("id", "$EXPR$", [], False, False), ("one", "$EXPR$", ["non-None"], False, False), ("ZZ", "ZZ($expr$)", [], False, True)]
    df = spark.createDataFrame(rows, "key string, body string, conditions array<string>, topmost boolean, builtin boolean")
    S.write_templates(df, str(tmp_path / "t"))
    got = {tuple(r[:2]) + (tuple(r.conditions), r.topmost, r.builtin, r.malformed) for r in S.read_templates(spark, str(tmp_path / "t")).collect()}
    assert got == {(k, b, tuple(c), t, False, None) for k, b, c, t, builtin in rows if not builtin}


def test_templates_that_others_wrote(spark, tmp_path):
    (tmp_path / "t.xml").write_text("""<templates>
<template key="a" topmost="true"><body>f($EXPR$)</body><condition id="class" class="m.C"/><condition id="unheard"/><condition id="class"/></template>
<template key="b"><body>g($EXPR$)</body></template>
<template key="c" topmost="maybe"><body>h</body></template>
<template><body>no key</body></template>
</templates>""")
    got = {r.key: r for r in S.read_templates(spark, str(tmp_path / "t.xml")).collect()}
    assert got["a"].conditions == ["m.C", None, None] and got["a"].topmost and got["a"].malformed is None
    assert got["b"].conditions == [] and not got["b"].topmost and got["b"].malformed is None
    assert got["c"].malformed is not None and got[None].malformed is not None
    # Unknown conditions fit nothing, known ones do.
    good = S.read_templates(spark, str(tmp_path / "t.xml")).where("malformed IS NULL").drop("malformed")
    asked = spark.createDataFrame([(1, "sage", "x", "a", "m.C"), (2, "sage", "x", "a", "m.D"), (3, "sage", "x", "b", None)], "file_id long, ext string, expr string, key string, expr_type string")
    assert {(r.file_id, r.expanded) for r in templates.expand(asked, good).collect()} == {(1, "f(x)"), (3, "g(x)")}
