"""A script corpus and a catalog to query. Both are SQL that Spark and DuckDB read alike.

The given tables hold no scripts, so each row of `part` becomes one: import line, statement, expression. The catalog
has a few hand-written rows for each rule, and a declaration for each row of `part`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "CAST(p_partkey AS STRING)"
_S = "CAST(p_size AS STRING)"
_FIRST = """CASE p_partkey % 5 WHEN 0 THEN 'from sage.all import *' WHEN 1 THEN '# from sage.all import *'
    WHEN 2 THEN 's = "from sage.all import *"' WHEN 3 THEN 'from sage.rings.all import ZZ' ELSE 'import os' END"""
_SECOND = f"""CASE p_partkey % 8 WHEN 0 THEN concat('R', {_K}, '.<x> = ', CASE WHEN p_partkey % 16 = 0 THEN 'GF' ELSE concat('fn', CAST(p_partkey - p_partkey % 6 + 1 AS STRING)) END, '(', {_S}, ')[]') WHEN 1 THEN concat('F.<a,b> = NumberField(x^', {_S}, ' - 2)')
    WHEN 2 THEN concat('y = e^', {_S}) WHEN 3 THEN concat('m ^^= ', {_S}) WHEN 4 THEN concat('z = b"', p_brand, '" ^ k')
    WHEN 5 THEN CASE WHEN p_partkey % 16 = 5 THEN 'R.<x' ELSE 'Q.<w> =' END WHEN 6 THEN concat('# ', p_name, ' ^ comment') ELSE concat('n = ', {_S}) END"""
_THIRD = f"""CASE p_partkey % 11 WHEN 0 THEN 'c = bytes(x ^ y for x, y in zip(a, b))' WHEN 1 THEN 'm ^= b"k"' WHEN 2 THEN 'w = p ^^^ q'
    WHEN 3 THEN concat('v = ', {_S}, '.5') WHEN 4 THEN 'u = -5' WHEN 5 THEN 's = "a^b" ^ 2  # c^d' WHEN 6 THEN 'a ^^^= b'
    WHEN 7 THEN 'd = bytes(f(x ^ y))' WHEN 8 THEN 'h: bytes = g(); v = h ^ t' WHEN 9 THEN 'for i in [1..5]: v = i ^ 2' ELSE concat('S.<y> = ZZ[]; T = ', {_S}) END"""
SCRIPTS = f"""SELECT p_partkey AS file_id, concat('/src/', {_K}, '.', CASE WHEN p_partkey % 10 = 9 THEN 'py' ELSE 'sage' END) AS path,
    CASE WHEN p_partkey % 10 = 9 THEN 'py' ELSE 'sage' END AS ext,
    concat({_FIRST}, chr(10), {_SECOND}, chr(10), {_THIRD}) AS text FROM {{part}}"""

_LIB = "/opt/env/lib/site-packages/sage"
_NS = f"{_LIB}/all.pyi"
SYMBOL_ROWS = (
    # name, kind, module, path, annotation, imported_name, src, pos
    ("GF", "function", "sage.all", _NS, None, None, 2, 0),
    ("ZZ", "attribute", "sage.all", _NS, "_Type_ZZ", None, 1, 1),
    ("CC", "attribute", "sage.all", _NS, "_Type_CC", None, 1, 2),
    ("pi", "attribute", "sage.all", _NS, "Constant", None, 1, 3),
    ("_Type_ZZ", "import", "sage.rings.integer_ring", _NS, None, "IntegerRing_class", 4, 4),
    ("_Type_CC", "import", "sage.rings.complex", _NS, None, "ComplexField_class_with_category", 4, 5),
    ("N", "import", "sage.misc.functional", _NS, None, "numerical_approx", 4, 6),
    ("ECM", "import", "sage.interfaces.ecm", _NS, None, "ECM", 4, 7),
    ("lost", "import", "sage.gone", _NS, None, "nowhere", 4, 8),
    ("factor", "function", "sage.all", _NS, None, None, 2, 9),
    ("factor", "import", "sage.arith.misc", _NS, None, "factor_impl", 4, 10),
    ("Integer", "class", "sage.all", _NS, None, None, 3, 11),
    ("Integer", "listed", "sage.all", _NS, None, None, 5, 12),
    ("ghost", "listed", "sage.all", _NS, None, None, 5, 13),
    ("__all__", "attribute", "sage.all", _NS, None, None, 1, 14),
    ("numerical_approx", "function", "sage.misc.functional", f"{_LIB}/misc/functional.pyi", None, None, 2, 0),
    ("N", "class", "sage.modular.modsym.p1list", f"{_LIB}/modular/modsym/p1list.pyi", None, None, 3, 0),
    ("ECM", "class", "sage.interfaces.ecm", f"{_LIB}/interfaces/ecm.pyi", None, None, 3, 0),
    ("IntegerRing_class", "class", "sage.rings.integer_ring", f"{_LIB}/rings/integer_ring.pyi", None, None, 3, 0),
    ("ComplexField_class", "class", "sage.rings.complex_mpfr", f"{_LIB}/rings/complex_mpfr.pyi", None, None, 3, 0),
    ("Integer", "class", "sage.rings.integer", f"{_LIB}/rings/integer.pyi", None, None, 3, 0),
    ("RealNumber", "class", "sage.rings.real_mpfr", f"{_LIB}/rings/real_mpfr.pyi", None, None, 3, 0),
    ("factor_impl", "class", "sage.arith.other", f"{_LIB}/arith/other.pyi", None, None, 3, 0),
    ("factor_impl", "function", "sage.arith.misc", f"{_LIB}/arith/misc.pyi", None, None, 2, 0),
    ("NumberField", "function", "sage.rings.number_field", f"{_LIB}/rings/number_field.pyi", None, None, 2, 0),
    ("Constant", "class", "sage.symbolic", f"{_LIB}/symbolic.pyi", None, None, 3, 0),
    ("array", "function", "numpy", "/opt/env/lib/site-packages/numpy/all.pyi", None, None, 2, 0),
    ("GF", "function", "numpy", "/opt/envs/sage/lib/site-packages/numpy/all.pyi", None, None, 2, 0),
)
METHOD_ROWS = (
    ("Parent", "__call__", "instance", "Element"),
    ("FiniteField", "_first_ngens", "tuple", "FiniteElement"),
    ("NumberFieldBase", "_first_ngens", "instance", "NumberFieldElement"),
)
BASE_ROWS = (("IntegerRing_class", "Ring"), ("Ring", "Parent"), ("NumberField_absolute", "NumberFieldBase"), ("ComplexField_class", "Field"), ("FiniteField", "Field"))
RETURN_ROWS = (("GF", "FiniteField"), ("NumberField", "NumberField_absolute"))


def values(rows, columns: str) -> str:
    """A SELECT over literal rows."""
    text = lambda v: "CAST(NULL AS STRING)" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def _made(prefix: str, less: int = 0) -> str:
    return f"concat('{prefix}', CAST(p_partkey - {less} AS STRING))"


#: Each row of `part` is a declaration too: a class, a function, two imports, an attribute or a listed name.
_DECLARED = f"""SELECT CASE p_partkey % 6 WHEN 0 THEN {_made("Cls")} WHEN 1 THEN {_made("fn")} WHEN 2 THEN {_made("al")} WHEN 3 THEN {_made("am")} WHEN 4 THEN {_made("at")} ELSE {_made("li")} END AS name,
    CASE p_partkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 4 THEN 'attribute' WHEN 5 THEN 'listed' ELSE 'import' END AS kind,
    CASE p_partkey % 6 WHEN 0 THEN concat('sage.gen.m', CAST(p_partkey % 50 AS STRING)) WHEN 1 THEN concat('sage.gen.m', CAST(p_partkey % 50 AS STRING))
        WHEN 2 THEN concat('sage.gen.m', CAST((p_partkey - 2) % 50 AS STRING)) WHEN 3 THEN 'sage.elsewhere' ELSE 'sage.all' END AS module,
    CASE WHEN p_partkey % 6 < 2 THEN concat('{_LIB}/gen/m', CAST(p_partkey % 50 AS STRING), '.pyi') ELSE '{_NS}' END AS path,
    CASE WHEN p_partkey % 6 = 4 THEN {_made("Cls", 4)} END AS annotation, CASE p_partkey % 6 WHEN 2 THEN {_made("Cls", 2)} WHEN 3 THEN {_made("fn", 2)} END AS imported_name,
    CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 5 ELSE 4 END AS src, p_partkey + 100 AS pos FROM {{part}}"""
#: The classes are chains of fifty in which every class has the next two as bases: half of all paths are diamonds.
_INHERITED = f"""SELECT {_made("Cls")} AS class_name, {_made("Cls", 6)} AS base FROM {{part}} WHERE p_partkey % 6 = 0 AND p_partkey % 300 <> 0
    UNION ALL SELECT {_made("Cls")}, {_made("Cls", 12)} FROM {{part}} WHERE p_partkey % 6 = 0 AND p_partkey % 300 >= 12"""
_GIVEN = f"""SELECT {_made("Cls")} AS class_name, '_first_ngens' AS method, 'tuple' AS return_kind, {_made("El")} AS return_elem FROM {{part}} WHERE p_partkey % 150 = 0
    UNION ALL SELECT {_made("Cls")}, '__call__', 'instance', 'Element' FROM {{part}} WHERE p_partkey % 600 = 0"""
SYMBOLS = values(SYMBOL_ROWS, "name, kind, module, path, annotation, imported_name, src, pos") + " UNION ALL " + _DECLARED
METHODS = values(METHOD_ROWS, "class_name, method, return_kind, return_elem") + " UNION ALL " + _GIVEN
BASES = values(BASE_ROWS, "class_name, base") + " UNION ALL " + _INHERITED
RETURNS = values(RETURN_ROWS, "callee, class_name") + f" UNION ALL SELECT {_made('fn')}, {_made('Cls', 1)} FROM {{part}} WHERE p_partkey % 6 = 1"


def _over_part(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, SCRIPTS)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, SYMBOLS)


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, f"SELECT class_name, method, return_kind, array(return_elem) AS return_elems FROM ({METHODS})")


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, BASES)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, RETURNS)


#: Each row of `part` is a stub file too. Ten classes make a chain, whose first inherits from Parent or from Ring;
#: bases are written as the names that the file imports them by.
_GENS = f"""CASE p_partkey % 6 WHEN 0 THEN concat('Tuple[El', {_K}, ', ...]') WHEN 1 THEN concat('Union[El', {_K}, ', int]') WHEN 2 THEN concat('tuple[El', {_K}, ', int]')
    WHEN 3 THEN concat('El', {_K}, ' | None') WHEN 4 THEN concat('Optional[El', {_K}, ']') ELSE concat('"El', {_K}, '"') END"""
_MAKES = f"CASE p_partkey % 4 WHEN 0 THEN concat('Cls', {_K}) WHEN 1 THEN concat('\"Cls', {_K}, '\"') WHEN 2 THEN concat('Optional[Cls', {_K}, ']') ELSE concat('Tuple[Cls', {_K}, ', int]') END"
_STUB_LINES = f"""concat(CASE WHEN p_partkey % 20 = 0 THEN 'from sage.structure.parent import Parent as Up' WHEN p_partkey % 10 = 0 THEN 'from sage.structure.parent import Ring as Up'
        ELSE concat('from sage.gen.m', CAST(p_partkey - 1 AS STRING), ' import Cls', CAST(p_partkey - 1 AS STRING), ' as Up') END, chr(10),
    'class Cls', {_K}, CASE WHEN p_partkey % 3 = 0 THEN '(Up[int], metaclass=M):' ELSE '(Up):' END, chr(10), '    size: int', chr(10),
    CASE WHEN p_partkey % 5 = 0 THEN concat('    def _first_ngens(self, n) -> ', {_GENS}, ': ...', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 15 = 0 THEN concat('    def __call__(self, x): ...', chr(10)) ELSE '' END,
    'def fn', {_K}, '(q) -> ', {_MAKES}, ': ...', chr(10), 'at', {_K}, ': Cls', {_K}, chr(10))"""
STUB_FILES = (
    (f"{_LIB}/all.pyi", 'from sage.gen.m5 import fn5 as make\ndef GF(q) -> "Cls10": ...\n__all__ = ["ghost"]\n'),
    (f"{_LIB}/structure/parent.pyi", "class Parent:\n    def __call__(self): ...\nclass Ring: ...\n"),
    (f"{_LIB}/broken.pyi", "class Cls5(\n"),
)
#: One statement for each function of the stubs.
STUB_CALLS = f"SELECT p_partkey AS file_id, '/g.sage' AS path, 'sage' AS ext, concat('G.<g> = fn', {_K}, '(2)') AS text FROM {{part}}"


def stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _over_part(spark, sf_dir, f"SELECT concat('{_LIB}/gen/m', {_K}, '.pyi') AS path, {_STUB_LINES} AS text FROM {{part}}")
    return made.unionByName(spark.createDataFrame(STUB_FILES, "path string, text string"))


def stub_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_part(spark, sf_dir, STUB_CALLS)


#: Scripts with functions, classes, scopes of their own, logical lines of several lines and errors: one of them for each row of `part`.
MODULES = (
    "def f(k: bytes, *a, z=q):\n    return k ^ 2\ndef g(k):\n    return k ^ w\nh = lambda k, j=z: k ^ 3",
    "k: bytes = b()\nclass A(B):\n    k = 1\n    def m(self) -> T[int]:\n        return k ^ 1, self.k\n    u = k\ndef n():\n    k = 5\n    return k ^ 4\nz = [k ^ 5 for k in range(3) if k]; y = k ^ 6",
    "R.<x> = GF(q)[x]\ndef area(r, n=N):\n    global total\n    total = pi * r\n    return sum(total for t in ZZ) + t\ny = total + lost + x\nfor i, j in pairs: s = i ^ j\nif (m := N(2)) > 1: print(m, f(key=GF))",
    "import os.path, re as p\nfrom a.b import c, d as e\nwith open(o) as fh:\n    data, t2 = fh.read(),\\\n  1\nx += 1\na = b = ECM\nfrom sage.all import factor",
    "f(\nR.<x> = GF(2)[]\n)\na = 1 + \\\nS.<y> = GF(3)[]\nT.<z> = PolynomialRing(\n    GF(5), # c (\n    z, 'z')\ns = '''\nU.<u> = GF(2)\n'''\nV.<v> = GF(7)[]; q = v\nW.<w>= GF(2)",
    "Q.<w> =\nx = (1\ny = 2\ndef broken(:\n    pass\nU.<t> = GF(\n",
    "y = fac(2)\nx1 = obj.fac\nfac = 1\nfrom m import Inte\nprint(Inte, GF (2), cc, nA, eCm(3), gho)",
)


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts (file_id, path, ext, text): the text of a row of `part` is that of its key modulo the number of texts."""
    key = F.col("p_partkey")
    text = F.get(F.array(*map(F.lit, MODULES)), F.pmod(key, F.lit(len(MODULES))).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("file_id"), F.concat(F.lit("/m/"), key.cast("string"), F.lit(".sage")).alias("path"), F.lit("sage").alias("ext"), text.alias("text"))


#: Scripts in which a template's key was typed, with `|` at the caret: one of them for each row of `part`.
CARETS = (
    "y = a + b*c.ZZ|",
    "y = a + b*c.sq|",
    "z = f(x, [1, 2].ls|)  # t",
    "z = [1] + [2].ls|",
    "z = 1 + 'a'.ts|",
    "print('a b'.ts|)",
    "x = -a^b.i2b|\ny = 1",
    "# a.ZZ|",
    "s = 'a.ZZ|'",
    "import a.ZZ|",
    "g(lambda t: t if t else u.N|)",
    "q = m.nope|",
    "h = x in y and not z.sq|",
    "R.<t> = GF(\n    p.ZZ|)",
    "v = a ^^ b ^ c!QQ|",
)
#: User-made templates beside the built-in ones: key, body, conditions, topmost.
USER_TEMPLATES = (("sq", "($EXPR$)^2$END$", [], True), ("ls", "len($EXPR$)", ["list", "tuple"], False), ("ts", "f($EXPR$)", ["string"], True))


def carets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (file_id, ext, text, caret)."""
    key = F.col("p_partkey")
    marked = F.get(F.array(*map(F.lit, CARETS)), F.pmod(key, F.lit(len(CARETS))).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("file_id"), F.lit("sage").alias("ext"), marked.alias("marked"))
    return rows.select("file_id", "ext", F.replace("marked", F.lit("|"), F.lit("")).alias("text"), (F.instr("marked", "|") - 1).alias("caret"))
