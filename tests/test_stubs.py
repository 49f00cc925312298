"""Stub texts to declarations, bases, methods and return classes."""

import ast

import pytest

from glyphlake.operators import catalog, resolve, statements
from glyphlake.sources import stubs

LIB = "/e/site-packages/sage"
TEXTS = {
    f"{LIB}/all.pyi": """
from sage.rings.ff import GF as GF
from sage.rings.ff import Field as F0
from sage.rings.nf import NumberField as NumberField
from sage.rings.poly import Ring_with_category as Polynomials
CC: "F0"
pi: Constant
def GF(q): ...
""",
    f"{LIB}/rings/ff.pyi": """
from sage.structure import Parent as P, Missing
import typing as t
class Elt(P): ...
class Field(P, t.Generic[T], metaclass=Meta):
    def _first_ngens(self, n) -> "t.Tuple[Elt, ...]": ...
    def __add__(self, other) -> "Elt | None": ...
    __radd__ = __add__
    class Inner(P): ...
def GF(q) -> t.Optional["Field"]:
    def Hidden(): ...
async def later() -> Missing: ...
def nothing(): ...
def pair() -> tuple[Field, Elt]: ...
""",
    f"{LIB}/rings/nf.pyi": "from .ff import Field as Base\nclass NumberField(Base[int]): ...\n",
    f"{LIB}/rings/poly.pyi": "class Ring: ...\nclass Elt:\n    def _first_ngens(self) -> int: ...\n",
    f"{LIB}/structure.pyi": "class Parent:\n    def __call__(self, x): ...\n",
    f"{LIB}/bad.pyi": "class Elt(\n",
    f"{LIB}/none.pyi": None,
    "/e/site-packages/numpy/a.pyi": "class Elt:\n    def __call__(self): ...\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    return stubs.read_stubs(spark.createDataFrame(list(TEXTS.items()), "path string, text string"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A", ("instance", ["A"])), ("'m.A'", ("instance", ["A"])), ("Optional['A']", ("instance", ["A"])), ("None | A", ("instance", ["A"])), ("Union[A, None, 'B']", ("union", ["A", "B"])),
        ("A | B | C", ("union", ["A", "B", "C"])), ("'Tuple[m.A, B[int], None]'", ("tuple", ["A", "B", None])), ("tuple[tuple[A], ...]", ("tuple", ["tuple"])), ("tuple", ("tuple", [])),
        ("List[A]", ("instance", ["List"])), ("Annotated[A, 'x']", ("instance", ["A"])), ("None", (None, [])), ("'A['", (None, [])), ("3", (None, [])), ("f()", (None, [])),
    ],
)
def test_annotations(text, want):
    assert stubs.annotated(ast.parse(text, mode="eval").body) == want


def test_bases_follow_the_imports_of_their_file(facts):
    got = {(r.class_name, r.base) for r in stubs.bases(facts).collect()}
    # Base is imported from a module that has no such class by its exact name, so the class is found anywhere in the tree.
    assert got == {("Elt", "Parent"), ("Field", "Parent"), ("Field", "Generic"), ("NumberField", "Field")}


def test_methods(facts):
    got = {(r.class_name, r.method): (r.return_kind, r.return_elems) for r in stubs.methods(facts).collect()}
    assert got == {("Field", "_first_ngens"): ("tuple", ["Elt"]), ("Field", "__add__"): ("instance", ["Elt"]), ("Field", "__radd__"): ("instance", ["Elt"]), ("Elt", "_first_ngens"): ("instance", ["int"]), ("Parent", "__call__"): (None, None)}


def test_returns_of_functions_classes_and_aliases(facts):
    got = {r.callee: r.class_name for r in stubs.returns(facts).collect()}
    # The namespace's own GF says nothing, though its import does; a tuple is no class.
    assert got == {"F0": "Field", "Field": "Field", "Elt": "Elt", "NumberField": "NumberField", "Polynomials": "Ring", "Ring": "Ring", "Parent": "Parent", "later": "Missing"}


def test_stub_texts_alone_feed_callability_and_types(spark, facts):
    symbols = stubs.symbols(facts)
    targets = catalog.entry_targets(catalog.namespace(symbols), symbols)
    called = {r.name: r.is_callable for r in catalog.callable_names(targets, symbols, stubs.methods(facts), stubs.bases(facts)).collect()}
    assert called["GF"] and called["F0"] and called["NumberField"] and not called["pi"]
    files = spark.createDataFrame([(1, "/a.sage", "sage", "K.<a> = NumberField(x^2 - 2)\nP.<u> = Polynomials(3)")], "file_id long, path string, ext string, text string")
    made = statements.generator_statements(files)
    got = {r.target: r.class_name for r in resolve.generator_types(made, stubs.returns(facts), stubs.methods(facts), stubs.bases(facts)).collect()}
    assert got == {"K": "NumberField", "a": "Elt", "P": "Ring", "u": None}


def test_no_stubs(spark):
    facts = stubs.read_stubs(spark.createDataFrame([], "path string, text string"))
    for relation in (stubs.symbols, stubs.bases, stubs.methods, stubs.returns):
        assert relation(facts).count() == 0


def test_a_stored_catalog_is_not_shuffled(spark, facts):
    symbols = stubs.symbols(facts)
    asked = spark.createDataFrame([("Elt",), ("Field",), ("nothing",), ("Elt",)], "name string")
    want = {tuple(r) for r in catalog.find_class(asked, symbols).collect()}
    stored = catalog.store(symbols, "stored_symbols", 4)
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = catalog.find_class(asked, stored)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.collect()} == want
        # One exchange, of the names that are asked for; the table is read as it lies.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        counted = resolve.candidate_counts(asked, stored)._jdf.queryExecution().executedPlan().toString()
        assert counted.count("Exchange hashpartitioning") == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE stored_symbols")


def test_stubs_are_parsed_once(spark, facts):
    """The relations read settled facts; none parses the files again, nor takes a side of a join to the driver by an estimate."""
    for relation in (stubs.symbols, stubs.bases, stubs.methods, stubs.returns):
        plan = relation(facts)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan
    assert "BroadcastHashJoin" not in stubs.bases(facts)._jdf.queryExecution().executedPlan().toString()
