"""Lexing, statements and lint on hand-written scripts."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.operators import catalog, lex, lint, resolve, statements

FILES = "file_id long, path string, ext string, text string"


def files(spark, *texts, ext="sage"):
    return spark.createDataFrame([(i, f"/{i}.{ext}", ext, t) for i, t in enumerate(texts)], FILES)


CARETS = {
    "g^31": [("^", "EXP")],
    "p ^^ q": [("^^", "XOR")],
    "p ^= 5": [("^=", "EXPEQ")],
    "k ^^=2": [("^^=", "XOREQ")],
    "p ^^^ q": [("^^^", "XOR")],
    "p ^^^= q": [("^^", "XOR"), ("^=", "EXPEQ")],
    "w = 'u^v' ^ 4  # y^z": [("^", "EXP")],
    's = """a^b\nc^d""" ^^ 2': [("^^", "XOR")],
    "": [],
}


def test_carets(spark):
    found = {}
    for r in lex.caret_tokens(files(spark, *CARETS)).collect():
        found.setdefault(r.file_id, []).append((r.start, r.lexeme, r.type))
    for i, want in enumerate(CARETS.values()):
        assert [x[1:] for x in sorted(found.get(i, []))] == want


def test_null_text_has_no_tokens(spark):
    assert lex.tokens(files(spark, None)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab1^='\"#\n\\ é😀.", max_size=30), min_size=10, max_size=10))
def test_lexemes_join_to_the_text(spark, texts):
    got = lex.tokens(files(spark, *texts)).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "lexeme"))), lambda x: x.lexeme), "").alias("t")).collect()
    assert {r.file_id: r.t for r in got} == {i: t for i, t in enumerate(texts) if t}


STATEMENTS = {
    "P.<t> = GF(5)[]\nE.<c> = GF(5^3, modulus=t^3 + 3*t + 3)": [("P", ["t"], "GF"), ("E", ["c"], "GF")],
    "L.<u,v> = NumberField(t^3 - 5, names=('u','v'))": [("L", ["u", "v"], "NumberField")],
    "p < q > r = 2\ny[1] = 3\np.q.<t> = 4": [],
    "R.<x> =": [("R", ["x"], None)],
    "R.<x": [],
    "R.<a,> = GF(7)": [],
    "x = 1; R.<y> = GF(2)[]": [],
    "S.<y> = ZZ[]": [("S", ["y"], None)],
    "R.<x>= GF(2)": [],
    "f(\nR.<x> = GF(2)[]\n)": [],
    "a = 1 + \\\nR.<x> = GF(2)[]": [],
    "x = f(\nR.<x> = GF(2)[]": [("R", ["x"], "GF")],
    ")\nT.<z> = ring(\n    GF(5), # (\n    'z')\nR.<x> = GF(2)[]": [("T", ["z"], "ring"), ("R", ["x"], "GF")],
    "s = '''\nR.<x> = GF(2)\n''' + (\n'[')\nR.<x> = GF(2)[]": [("R", ["x"], "GF")],
    's = """\nR.<x> = GF(2)\n"""': [],
    "# R.<x> = GF(2)": [],
    "    R.<x> = GF(2)": [],
}


def test_generator_statements(spark):
    found = {}
    for r in statements.generator_statements(files(spark, *STATEMENTS)).orderBy("line_no").collect():
        found.setdefault(r.file_id, []).append((r.factory_name, r.names, r.callee))
    for i, want in enumerate(STATEMENTS.values()):
        assert found.get(i, []) == want
    assert statements.generator_statements(files(spark, "R.<x> = GF(2)[]", ext="py")).count() == 0
    assert statements.generator_statements(files(spark, "R.<x> = GF(2)[]", ext="SAGE")).count() == 0


def test_explicit_import(spark):
    texts = ["from sage.all import *", "# from sage.all import *", "x = 'from sage.all import *'", "'''\nfrom sage.all import *\n'''", "from sage.all import GF", "from sage.rings.all import ZZ", ""]
    assert {r.file_id for r in statements.explicit_imports(files(spark, *texts)).collect()} == {0, 4}
    assert {r.file_id for r in statements.implicit_files(files(spark, *texts)).collect()} == {1, 2, 3, 5, 6}


MISUSE = {
    'z = b"k" ^ m': 'z = b"k" ^^ m',
    "bytes(x ^ y for x, y in zip(a, b))": "bytes(x ^^ y for x, y in zip(a, b))",
    'm ^= b"k"': 'm ^^= b"k"',
    "é = '^'; z = m ^ rb'k'": "é = '^'; z = m ^^ rb'k'",
    "k: bytes = f()\nz = k ^ m": "k: bytes = f()\nz = k ^^ m",
    "z = bytes.fromhex(s) ^ m": "z = bytes.fromhex(s) ^^ m",
    "R.<x> = GF(2)[]\nz = b'k' ^ m": "R.<x> = GF(2)[]\nz = b'k' ^^ m",
    "P.<u, v> = ring(3)[]\nkey: bytes = f()\nout = key ^ pad": "P.<u, v> = ring(3)[]\nkey: bytes = f()\nout = key ^^ pad",
    "P.<u> = ring(3)[]\nout = bytes(\n    s ^ t for s, t in zip(p,\n    q))": "P.<u> = ring(3)[]\nout = bytes(\n    s ^^ t for s, t in zip(p,\n    q))",
    "P.<u> = ring(3)[]\nif b'n' ^ pad:": "P.<u> = ring(3)[]\nif b'n' ^^ pad:",
    "if x:\n    pass\nelif b'n' ^ pad:\n    y = = 1": "if x:\n    pass\nelif b'n' ^^ pad:\n    y = = 1",
    "for i in [1..5]:\n    z = b'n' ^ i  # é ^": "for i in [1..5]:\n    z = b'n' ^^ i  # é ^",
    "P.<u> =\ndef f(k: bytes):\n    return 'é', k ^ 2^u": "P.<u> =\ndef f(k: bytes):\n    return 'é', k ^^ 2^u",
    "s = [] ; t = b'n' ^ r[]": "s = [] ; t = b'n' ^^ r[]",
    "def f(k: bytes):\n    return k ^ 2\ndef g(k):\n    return k ^ 2": "def f(k: bytes):\n    return k ^^ 2\ndef g(k):\n    return k ^ 2",
    "k: bytes = r\nclass A:\n    k = 1\n    u = k ^ 1\n    def m(self):\n        return k ^ 1": "k: bytes = r\nclass A:\n    k = 1\n    u = k ^ 1\n    def m(self):\n        return k ^^ 1",
    "k: bytes = r\nz = [k ^ 1 for k in r], (lambda k: k ^ 2), k ^ 3": "k: bytes = r\nz = [k ^ 1 for k in r], (lambda k: k ^ 2), k ^^ 3",
    "def f():\n    global k\n    k = k ^ 1\nk: bytearray = r\n= =": "def f():\n    global k\n    k = k ^^ 1\nk: bytearray = r\n= =",
    "x = (\nz = b'n' ^ r": "x = (\nz = b'n' ^^ r",
}
FINE = ["g^31", "3^4", 'b"k" ** 2', "x ^^ y", 'x ^^= b"k"', "bytes(f(x ^ y))", "broken( ^", "", "s = 'b^' # ^ b'k'"]


@pytest.mark.parametrize("text", list(MISUSE))
def test_misuse_and_fix(text):
    hits = lint.misuse_in(text)
    fixed = text
    for start, _, _, _ in reversed(hits):
        fixed = fixed[:start] + "^" + fixed[start:]
    assert fixed == MISUSE[text]
    assert lint.misuse_in(fixed) == []


@pytest.mark.parametrize("text", FINE)
def test_no_misuse(text):
    assert lint.misuse_in(text) == []


def test_fixes_as_a_table(spark):
    df = files(spark, *MISUSE)
    got = lint.apply_fixes(df, lint.misuse(df)).collect()
    assert {r.file_id: r.fixed_text for r in got} == dict(enumerate(MISUSE.values()))


def test_two_hits_in_one_expression():
    assert [h[0] for h in lint.misuse_in('x ^ b"k" ^ z')] == [2, 9]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab^=b'\"() \n", max_size=40))
def test_lint_never_fails(text):
    for start, stop, lexeme, _ in lint.misuse_in(text):
        assert text[start:stop] == lexeme


def test_a_long_script_is_lexed_in_linear_time(spark):
    line = "ab ^ c1 + 'x y' # z\n"
    took = {}
    for n in (5_000, 5_000, 50_000):  # the first warms up
        began = time.monotonic()
        last = lex.tokens(files(spark, line * n)).agg(F.max("end").alias("end"), F.count_if(F.col("type") == "EXP").alias("n")).first()
        assert (last.end, last.n) == (n * len(line), n)
        took[n] = time.monotonic() - began
    assert took[50_000] < 30 * max(took[5_000], 0.2)


def test_a_long_script_is_linted_in_linear_time():
    text = "P.<u> = ring(3)[]\n" + "z = b'n' ^ pad\nif u:\n    y = 2^u\n" * 20_000
    assert len(lint.misuse_in(text)) == 20_000
    assert len(lint.misuse_in("broken( ]]\n" + text)) == 20_000


def test_ancestors_of_chains_diamonds_and_cycles(spark):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(41)]
    pairs += [(f"d{i}", f"{side}{i}") for i in range(18) for side in "lr"] + [(f"{side}{i}", f"d{i + 1}") for i in range(18) for side in "lr"]
    pairs += [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("n", None)]
    got = {(r.class_name, r.ancestor): r.distance for r in catalog.ancestors(spark.createDataFrame(pairs, "class_name string, base string")).collect()}
    assert len({a for c, a in got if c == "c0"}) == 42 and got["c0", "c41"] == 41
    assert got["d0", "d18"] == 36 and len([1 for c, _ in got if c == "d0"]) == 18 * 3 + 1
    assert got["x", "z"] == 2 and got["z", "y"] == 2 and got["s", "s"] == 0 and got["n", "n"] == 0


def test_generators_come_from_the_nearest_class(spark):
    made = statements.generator_statements(files(spark, "C.<g> = make()"))
    bases = spark.createDataFrame([("C", "ZNear"), ("ZNear", "AFar")], "class_name string, base string")
    methods = spark.createDataFrame([("AFar", "_first_ngens", "tuple", ["FarElt"]), ("ZNear", "_first_ngens", "tuple", ["NearElt"])], "class_name string, method string, return_kind string, return_elems array<string>")
    returns = spark.createDataFrame([("make", "C")], "callee string, class_name string")
    assert {r.target: r.class_name for r in resolve.generator_types(made, returns, methods, bases).collect()} == {"C": "C", "g": "NearElt"}


def test_statement_errors(spark):
    df = files(spark, "p = 1\nR.<x> = ring(2)[]", "P.<k> =\nQ.<l> = ring(2)[]")
    assert [(r.file_id, r.line_no) for r in statements.statement_errors(df).collect()] == [(1, 0)]


def test_right_sides_are_whole(spark):
    df = files(spark, "T.<z> = ring(\n    GF(5), # (\n    'z')\nu = 1", "P.<k> = a + \\\n  b; c = 2")
    got = {r.file_id: (r.line_no, r.last_line, r.rhs) for r in statements.generator_statements(df).collect()}
    assert got == {0: (0, 2, "ring(\n    GF(5), # (\n    'z')"), 1: (0, 1, "a + \\\n  b; c = 2")}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab([])=\n\n\\'#\" ", max_size=40), min_size=10, max_size=10))
def test_logical_lines_are_the_text(spark, texts):
    got = {}
    for r in statements.logical_lines(files(spark, *texts)).orderBy("file_id", "line_no").collect():
        assert len(r.line) == len(r.code) and r.line.count("\n") == r.last_line - r.line_no
        got.setdefault(r.file_id, []).append(r.line)
    assert {i: "\n".join(x) for i, x in got.items()} == dict(enumerate(texts))


def test_a_long_script_has_logical_lines_in_linear_time(spark):
    text = "x = f(\n    1,\n    2)\ny = [\n"
    took = {}
    for n in (400, 400, 4_000):
        began = time.monotonic()
        assert statements.logical_lines(files(spark, text * n)).count() > 1
        took[n] = time.monotonic() - began
    assert took[4_000] < 40 * max(took[400], 0.3)


def test_errors_of_the_parser_are_filtered_by_statement(spark):
    text = "Q.<w> =\nx = (1\ny = 2\ndef broken(:\n    pass\nU.<t> = GF(\nR.<x\nT.<z> = ring(\n  3 3,\n)\na ^^^= b\nok = 1 ^ 2"
    df = files(spark, text, None, "").unionByName(spark.createDataFrame([(7, "/b.py", "py", "R.<x> = f()\nx = 1")], FILES))
    errors = lint.script_errors(df)
    assert {(r.file_id, r.line_no) for r in errors.collect()} == {(0, 0), (0, 1), (0, 3), (0, 5), (0, 6), (0, 8), (0, 10), (7, 0)}
    assert {(r.file_id, r.line_no) for r in statements.visible_errors(errors, df).collect()} == {(0, 1), (0, 3), (0, 6), (0, 10), (7, 0)}
