"""Roles of names, scopes, references and completion positions, read from text."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.operators import catalog, complete, resolve, syntax
from glyphlake.schema import SYMBOLS

FILES = "file_id long, path string, ext string, text string"


def files(spark, *texts, ext="sage"):
    return spark.createDataFrame([(i, f"/{i}.{ext}", ext, t) for i, t in enumerate(texts)], FILES)


TEXTS = (
    "async def f(k, /, *a: int, z=q, **o) -> Dict[str, T]:\n    return k\nclass C(B, metaclass=M): x = y; z = x\n",
    "for i, (j, k) in p: q = i\nwith a as b, c as (d): pass\ntry: t\nexcept E as e: raise e\n",
    "a, b = c = d\n(x) == y\nu += v\nw: int\nf(g=h, *i, **j)[k] = l\nm.n = o\n",
    "import a.b, c as d\nfrom . import e as f, g\nfrom h import (\n    i,\n    j as k,\n)\nl = '''\nm = n\n''' if o else p\n",
    "{a: b for a, b in c if d}; e = [f for f in g for h in f]; i = (lambda j, *k, l=m: j)\nn if (o := p) else q\n",
    "def f():\n  def g():\n    nonlocal x\n    x = 1\n  x = 2\n  if y:\n      def h(): return x\n  return x\nx\n",
    "R.<x, y> = GF(q)[x]; z = x\nS = x^2 # t\nif R: T.<u> = v\n",
    "class A:\n    a = 1\n    def b(self, c=a): return a\n    d = a\n\n    class E:\n        f = a\ng = a\n",
    "x = f(\ny = x\n",
    None,
    "",
)


@pytest.fixture(scope="module")
def named(spark):
    return catalog.settled(syntax.names(files(spark, *TEXTS)))


def test_roles(named):
    got = {}
    for r in named.where("role <> 'reference'").orderBy("start").collect():
        got.setdefault(r.file_id, []).append(f"{r.name}:{r.role}")
    assert got == {
        0: "f:function k:parameter a:parameter z:parameter o:parameter C:class metaclass:keyword x:target z:target".split(),
        1: "i:loop j:loop k:loop q:target b:as e:as".split(),
        2: "a:target b:target c:target u:target w:target g:keyword n:attribute".split(),
        3: "a:import b:attribute c:source d:import e:source f:import g:import h:source i:import j:source k:import l:target".split(),
        4: "a:loop b:loop e:target f:loop h:loop i:target j:lambda k:lambda l:lambda o:walrus".split(),
        5: "f:function g:function x:nonlocal x:target x:target h:function".split(),
        6: "R:generator x:generator y:generator z:target S:target".split(),
        7: "A:class a:target b:function self:parameter c:parameter d:target E:class f:target g:target".split(),
        8: "x:target y:target".split(),
    }


def test_references_find_their_scope(named):
    """The scope of each reference, by the line that opens it; none: nothing binds the name."""
    got = {}
    for r in syntax.bound_references(named).orderBy("file_id", "start").collect():
        text = TEXTS[r.file_id]
        where = "-" if r.scope is None else "module" if r.scope == syntax.MODULE else text[r.scope :].split(":")[0].split("(")[0].strip()
        got.setdefault(r.file_id, []).append(f"{r.name}@{where}")
    assert got[0] == ["int@-", "q@-", "Dict@-", "str@-", "T@-", "k@async def f", "B@-", "M@-", "y@-", "x@class C"]
    assert got[1] == ["p@-", "i@module", "a@-", "c@-", "d@-", "t@-", "E@-", "e@module"]
    assert got[3] == ["o@-", "p@-"]
    assert got[5] == ["y@-", "x@def f", "x@def f", "x@-"]
    assert got[6] == ["GF@-", "q@-", "x@module", "x@module", "x@module", "R@module", "T@-", "u@-", "v@-"]
    assert got[7] == ["a@class A", "a@-", "a@class A", "a@-", "a@-"]
    assert got[8] == ["f@-", "x@module"]
    four = dict(zip(range(20), got[4], strict=False))
    assert [x.split("@")[0] for x in four.values()] == ["a", "b", "c", "d", "f", "g", "f", "m", "j", "n", "p", "q"]
    assert four[2] == "c@-" and four[5] == "g@-" and four[7] == "m@-" and "-" not in four[0][2:] and four[8] == "j@lambda j, *k, l=m"


def test_open_references_keep_what_a_generator_statement_names_itself(spark):
    df = files(spark, "R.<x> = GF(q)[x]; z = x\nprint(x, w)", "from sage.all import *\nw", "from sage.rings.all import ZZ\nZZ, w")
    got = {(r.file_id, r.line_no, r.name, r.own) for r in syntax.open_references(catalog.settled(syntax.names(df)), df).collect()}
    assert got == {(0, 0, "GF", False), (0, 0, "q", False), (0, 0, "x", True), (0, 1, "w", False), (2, 1, "w", False)}


def test_resolution_reads_the_text(spark):
    lib = "/e/site-packages/sage"
    symbols = spark.createDataFrame([("GF", "function", "sage.all", f"{lib}/all.pyi", None, None, 2, 0), ("pi", "attribute", "sage.all", f"{lib}/all.pyi", "C", None, 1, 1)], "name string, kind string, module string, path string, annotation string, imported_name string, src int, pos int")
    df = files(spark, "def f(pi): return pi\nK.<a> = GF(\n    a, pi)\nobj.GF")
    got = {(r.line_no, r.name, r.origin, r.target_kind) for r in resolve.resolve_names(df, symbols).collect()}
    assert got == {(1, "GF", "catalog", "function"), (2, "a", "generator", "target"), (2, "pi", "catalog", "attribute"), (3, "obj", "none", None)}


def test_positions(spark):
    got = {(r.prefix, r.pos, r.next_char, r.qualified, r.is_target, r.in_import) for r in complete.positions(files(spark, "ab = c.de(f)\nimport g\nh(i=1)")).collect()}
    assert got == {("ab", 2, "", False, True, False), ("c", 6, ".", False, False, False), ("de", 9, "(", True, False, False), ("f", 11, ")", False, False, False), ("g", 21, "", False, False, True), ("h", 23, "(", False, False, False)}


@pytest.mark.parametrize(
    ("prefix", "name", "want"),
    [
        ("gF", "getField", True), ("getF", "getField", True), ("fG", "getField", False), ("gfi", "getField", False), ("GF", "getField", True), ("getfi", "getField", True), ("gFN", "getFieldName", True),
        ("gN", "getFieldName", True), ("gNF", "getFieldName", False), ("n_d", "number_of_divisors", True), ("nD", "number_of_divisors", True), ("n_o_d", "number_of_divisors", True), ("numofd", "number_of_divisors", False),
        ("GF", "GF", True), ("gf", "GF", True), ("eC", "EllipticCurve", True), ("_T", "_Type_ZZ", True), ("TZ", "_Type_ZZ", True), ("ECM", "ECM", True), ("", "x", False), (".*", "x", False), ("a.B", "aBc", False), ("éÉ", "éaÉb", True),
    ],
)
def test_prefixes(spark, prefix, name, want):
    one = spark.createDataFrame([(prefix, name)], "prefix string, name string")
    assert one.select(complete.prefix_matches(F.col("name"), F.col("prefix"))).first()[0] == want
    # The index loses nothing that the rule accepts.
    assert complete.matches(one, one).count() == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abAB_", max_size=5), st.text(alphabet="abAB_", min_size=1, max_size=9)), min_size=60, max_size=60))
def test_the_index_agrees_with_the_rule(spark, pairs):
    df = spark.createDataFrame(pairs, "prefix string, name string")
    want = {(p, n) for p, n in df.select("prefix").distinct().crossJoin(df.select("name").distinct()).where(complete.prefix_matches(F.col("name"), F.col("prefix"))).collect()}
    assert {tuple(r) for r in complete.matches(df, df).collect()} == want


def test_names_agree_with_the_parser(spark):
    """Every name that Python's own tree stores or loads is a binding or a reference, and nothing else is."""
    texts = [TEXTS[i] for i in (0, 2, 3, 4, 5, 7)]
    found = {}
    for r in syntax.names(files(spark, *texts)).where("role IN ('target', 'loop', 'walrus', 'reference')").collect():
        found.setdefault(r.file_id, set()).add((r.start, r.name, r.role != "reference"))
    for i, text in enumerate(texts):
        lines = [0]
        for line in text.split("\n"):
            lines.append(lines[-1] + len(line) + 1)
        assert found[i] == {(lines[n.lineno - 1] + n.col_offset, n.id, isinstance(n.ctx, ast.Store)) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Name)}


def test_no_side_of_a_join_is_collected_by_an_estimate(spark):
    """What a text explodes into is larger than Spark's estimate of it, so joins of tokens and of catalogs are merged."""
    files = spark.createDataFrame([(1, "/a.sage", "sage", "def f(k):\n    return k ^ g\n")], "file_id long, path string, ext string, text string")
    symbols = spark.createDataFrame([("g", "function", "m", "/e/site-packages/sage/all.pyi", None, None, 2, 0)], SYMBOLS)
    named = syntax.names(files)
    for rows in (syntax.bound_references(named), syntax.open_references(named, files), resolve.find_declarations(named, symbols), complete.matches(named.select(F.col("name").alias("prefix")), symbols)):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
