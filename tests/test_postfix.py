"""Expressions at a caret, against Python's own parser, and the templates applied to them."""

import ast
import random

from glyphlake.operators import postfix, templates

REQUESTS = "file_id long, ext string, text string, caret int"
ATOMS = ("a", "f(x, -y)", "g[i:j]", "o.p", "(a + b).c", "[x for x in y if z]", "{k: v}", "3", "'s t'", "h(lambda q: q)(2)", "(u, v)[0]", "None")
LEVELS = (("*", "/", "//", "%", "@"), ("+", "-"), ("<<", ">>"), ("&",), ("^",), ("|",), ("<", ">=", "==", "in", "not in", "is", "is not"))
FRAMES = (
    ("", ""), ("x = ", ""), ("f(1, ", ")\ny = 2"), ("a = [i for i in ", "]"), ("if ", ": pass"), ("x += 1; return ", "\nz"), ("d[k: ", "]"), ("{p: ", "}"),
    ("def f(u, w=", "): pass"), ("[i for i in j if ", "]"), ("while ", ":\n  q"), ("z = (1,\n  ", ")"),
)


def expression(rng, depth, level=10):
    """A random expression of Python; its last operand is never only something in brackets."""
    again = lambda at, less=0: expression(rng, max(depth - less, 0), at)
    if level == 10:
        if rng.random() < 0.1:
            return rng.choice(("lambda p, q=1: ", "lambda: ")) + again(10, 1)
        return f"{again(9)} if {again(9, 1)} else {again(10, 1)}" if rng.random() < 0.2 and depth else again(9)
    if level in (8, 9):
        word = " or " if level == 9 else " and "
        return word.join(again(level - 1) for _ in range(1 + (rng.random() < 0.2)))
    if level == 7 and rng.random() < 0.1:
        return "not " + again(7)
    if level:
        text = again(level - 1)
        while rng.random() < 0.2:
            text += f" {rng.choice(LEVELS[level - 1])} {again(level - 1)}"
        return text
    if rng.random() < 0.15:
        return rng.choice("-+~") + again(0)
    base = f"({again(10, 1)}) ** " if depth and rng.random() < 0.15 else "a ** " if rng.random() < 0.2 else ""
    return base + (again(0, 1) if base and depth else rng.choice(ATOMS))


def test_expressions_are_those_of_the_parser(spark):
    rng, rows, want = random.Random(7), [], {}
    while len(rows) < 400:
        text = expression(rng, 2)
        if len(text) > 120:
            continue
        before, after = FRAMES[len(rows) % len(FRAMES)]
        ends = {n.col_offset for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.expr) and n.end_col_offset == len(text)}
        dialect = lambda x: x.replace("^", "^^")
        key = len(rows)
        want[key] = sorted(len(before) + len(dialect(text[:at])) for at in ends)
        whole = before + dialect(text)
        rows.append((key, "sage", f"{whole}.ZZ{after}", len(whole) + 3))
    got = {}
    for r in postfix.expressions_at(spark.createDataFrame(rows, REQUESTS)).collect():
        text = rows[r.file_id][2]
        assert r.expr == text[r.start : r.end] and text[r.end :].startswith(".ZZ")
        got.setdefault(r.file_id, []).append((r.start, r.rank, r.topmost))
    assert {k: [s for s, _, _ in sorted(v)] for k, v in got.items()} == want
    for spans in got.values():
        spans.sort(reverse=True)
        assert [(rank, top) for _, rank, top in spans] == [(i + 1, i + 1 == len(spans)) for i in range(len(spans))]


def at_carets(spark, *marked, ext="sage"):
    return spark.createDataFrame([(i, ext, None if t is None else t.replace("|", ""), 9 if t is None else t.find("|")) for i, t in enumerate(marked)], REQUESTS)


def test_kinds_and_places_without_an_expression(spark):
    cases = ("x = [a, b].k|", "{}.k|", "{a}.k|", "{**a}.k|", "{a: b for a in c}.k|", "(a, b).k|", "().k|", "(a).k|", "(a for a, b in c).k|", "'a' \"b\".k|", "None.k|", "b'x'.k|", "f('a').k|", "[a][0].k|")
    got = {r.file_id: r.kind for r in postfix.expressions_at(at_carets(spark, *cases)).where("rank = 1").collect()}
    assert [got[i] for i in range(len(cases))] == ["list", "dict", "set", "dict", "dict", "tuple", "tuple", None, None, "string", "None", "string", None, None]
    none = ("# a.k|", "'a.k|'", "import a.k|", "from a.k|", "def a.k|", "class A.k|", "for i in j: pass\nwith a as b.k|", "R.<x.k| = GF(2)", "a + .k|", "a .k|", ".k|", "a.k", "a.|", "", None, "global a.k|", "if.k|")
    assert postfix.expressions_at(at_carets(spark, *none)).collect() == []
    assert postfix.expressions_at(at_carets(spark, "a.k|", ext="py")).collect() == []
    assert postfix.expressions_at(spark.createDataFrame([], REQUESTS)).collect() == []
    beyond = spark.createDataFrame([(1, "sage", "a.k", 99), (2, "sage", "a.k", -1), (3, "sage", "a.k", None)], REQUESTS)
    assert postfix.expressions_at(beyond).collect() == []


def test_templates_at_the_caret(spark):
    rows = [("t", "T($EXPR$)", [], True, False), ("t", "I($EXPR$)", [], False, False), ("c", "C($EXPR$)$END$", ["my.Base"], True, False), ("s", "S($EXPR$)", ["string", "list"], False, False)]
    user = spark.createDataFrame(rows, templates.TEMPLATES)
    bases = spark.createDataFrame([("my.Class", "my.Base")], "class_name string, base string")
    types = spark.createDataFrame([(1, "v", "my.Class"), (2, "v", "my.Class"), (3, "w", "my.Class")], "file_id long, target string, class_name string")
    asked = at_carets(spark, "a + b.t|", "f(v.c|)", "1 + v.c|", "v.c|", "x = 'a' + ['b'].s| + 1", "a.unknown|")
    got = sorted((r.file_id, r.start, r.text, r.caret) for r in postfix.expand_at(asked, user, bases, types).collect())
    assert got == [(0, 0, "I(a + b)", 8), (0, 0, "T(a + b)", 8), (0, 4, "a + I(b)", 8), (1, 2, "f(C(v))", 6), (4, 10, "x = 'a' + S(['b']) + 1", 18)]
