"""Postfix and live templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TEMPLATES
from .catalog import ancestors

# The names that wrap an expression as a call.
CALL_WRAPS = (
    "ZZ", "QQ", "RR", "CC", "SR", "Integer", "N", "factor", "show", "vector", "matrix", "euler_phi", "carmichael_lambda", "divisors",
    "number_of_divisors", "prime_factors", "squarefree_part", "next_prime", "random_prime", "primitive_root", "factorial", "numerator",
    "denominator", "continued_fraction", "cyclotomic_polynomial", "sage_eval",
)
# The other two postfix keys and what they write.
FIXED_POSTFIX = (("b2i", 'int.from_bytes($expr$, "big")'), ("i2b", 'int($expr$).to_bytes($END$, "big")'))
# The live templates, each with its slots and their defaults.
LIVE = (
    ("def", "def $NAME$($PARAMS$):\n    $BODY$", {"NAME": "f", "PARAMS": "", "BODY": "pass"}),
    ("cls", "class $NAME$($BASE$):\n    def __init__(self, $PARAMS$):\n        $BODY$", {"NAME": "Foo", "BASE": "object", "PARAMS": "", "BODY": "pass"}),
    ("for", "for $X$ in $ITER$:\n    $BODY$", {"X": "i", "ITER": "range(10)", "BODY": "pass"}),
    ("if", "if $COND$:\n    $BODY$", {"COND": "", "BODY": "pass"}),
    ("ife", "if $COND$:\n    $THEN$\nelse:\n    $ELSE$", {"COND": "", "THEN": "pass", "ELSE": "pass"}),
    ("while", "while $COND$:\n    $BODY$", {"COND": "", "BODY": "pass"}),
    ("try", "try:\n    $BODY$\nexcept $EXC$ as e:\n    $HANDLER$", {"BODY": "pass", "EXC": "Exception", "HANDLER": "raise"}),
    ("from", "from $MOD$ import $NAMES$", {"MOD": "sage.all", "NAMES": "*"}),
    ("pr", "print($EXPR$)", {"EXPR": ""}),
    ("as", "assert $COND$", {"COND": ""}),
    ("poly", "$R$.<$GENS$> = PolynomialRing($BASE$)", {"R": "R", "GENS": "x", "BASE": "QQ"}),
    ("nf", "$K$.<$GEN$> = NumberField($POLY$)", {"K": "K", "GEN": "a", "POLY": "x^2 - 2"}),
    ("gf", "$K$.<$GEN$> = GF($Q$)", {"K": "F", "GEN": "a", "Q": "2^8"}),
    ("ec", "$E$ = EllipticCurve($AINVS$)", {"E": "E", "AINVS": "[0, 0, 0, -1, 0]"}),
    ("mat", "$M$ = matrix($RING$, $ROWS$, $COLS$, $ENTRIES$)", {"M": "M", "RING": "QQ", "ROWS": "2", "COLS": "2", "ENTRIES": "[1, 0, 0, 1]"}),
    ("vec", "$V$ = vector($RING$, $ENTRIES$)", {"V": "v", "RING": "QQ", "ENTRIES": "[]"}),
    ("var", "$NAMES$ = var('$NAMES$')", {"NAMES": "x"}),
    ("solv", "solve($EQ$, $X$)", {"EQ": "", "X": "x"}),
    ("ig", "integral($F$, $X$)", {"F": "", "X": "x"}),
    ("dr", "diff($F$, $X$)", {"F": "", "X": "x"}),
    ("lim", "limit($F$, $X$=$A$)", {"F": "", "X": "x", "A": "0"}),
    ("pl", "plot($F$, ($X$, $A$, $B$))", {"F": "sin(x)", "X": "x", "A": "-pi", "B": "pi"}),
    ("fa", "factor($N$)", {"N": ""}),
    ("ip", "is_prime($N$)", {"N": ""}),
    ("main", "if __name__ == '__main__':\n    $BODY$", {"BODY": "pass"}),
)
# Class conditions on offer, by qualified name.
CLASS_CONDITIONS = (
    "sage.rings.integer.Integer",
    "sage.rings.rational.Rational",
    "sage.rings.real_mpfr.RealNumber",
    "sage.rings.complex_mpfr.ComplexNumber",
    "sage.rings.finite_rings.element_base.FinitePolyExtElement",
    "sage.rings.polynomial.polynomial_element.Polynomial",
    "sage.matrix.matrix0.Matrix",
    "sage.modules.free_module_element.FreeModuleElement",
)
PUBLIC_CONDITIONS = ("string", "list", "dict", "set", "tuple", "non-None")


def postfix_templates(spark: SparkSession) -> DataFrame:
    """The 28 built-in rows of the template relation."""
    rows = [(k, f"{k}($expr$)", [], False, True) for k in CALL_WRAPS] + [(k, body, [], False, True) for k, body in FIXED_POSTFIX]
    return spark.createDataFrame(rows, TEMPLATES)


def live_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, d) for k, v, d in LIVE], "key string, value string, defaults map<string,string>")


def is_terminal(c: Column) -> Column:
    """P12."""
    return c.isin(".", "!")


def editable(templates: DataFrame) -> DataFrame:
    """User-made rows only."""
    return templates.where("NOT builtin")


def fill(body: Column, expr: Column, builtin: Column) -> Column:
    """Built-in bodies spell the slot in lower case, user-made ones in upper case."""
    return F.when(builtin, F.replace(body, F.lit("$expr$"), expr)).otherwise(F.replace(body, F.lit("$EXPR$"), expr))


def expand(expressions: DataFrame, templates: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Expressions (file_id, ext, expr, key, expr_type) to (file_id, key, expanded, caret).

    Only in scripts. A user row with conditions needs one that fits: a public kind, or a class that the
    expression's type is or inherits. The caret is where $END$ was, else the end. `postfix.expand_at` finds the expressions
    in the text, and only the outermost for a topmost template.
    """
    rows = expressions.where("ext = 'sage'").join(templates, "key")
    kind = F.coalesce("expr_type", F.lit(""))
    public = F.array_contains("conditions", kind) | (F.array_contains("conditions", F.lit("non-None")) & ~kind.isin("", "None"))
    if bases is not None:
        closure = ancestors(bases).groupBy(F.col("class_name").alias("expr_type")).agg(F.collect_set("ancestor").alias("up"))
        rows = rows.join(closure, "expr_type", "left")
        public = public | F.coalesce(F.arrays_overlap("conditions", "up"), F.lit(False))
    rows = rows.where(F.col("builtin") | (F.size("conditions") == 0) | public)
    text = fill(F.col("body"), F.col("expr"), F.col("builtin"))
    at = F.instr(text, "$END$")
    return rows.select("file_id", "key", F.replace(text, F.lit("$END$"), F.lit("")).alias("expanded"), F.when(at > 0, at - 1).otherwise(F.length(text)).cast("int").alias("caret"))


def expand_live(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Live templates: requests (request_id, key, arguments map) to (request_id, key, expanded); defaults fill the rest."""
    rows = requests.join(templates, "key")
    pieces = F.split("value", r"\$", -1)  # slots are the odd pieces
    given = lambda x: F.coalesce(F.element_at("arguments", x), F.element_at("defaults", x))
    text = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.coalesce(given(x), F.lit(""))).otherwise(x)), "")
    return rows.select("request_id", "key", text.alias("expanded"))


def read_condition(kind: Column, class_name: Column) -> Column:
    """A class condition by its qualified name, a public one by its id, else null."""
    return F.when((kind == "class") & class_name.isNotNull(), class_name).when(kind.isin(*PUBLIC_CONDITIONS), kind)
