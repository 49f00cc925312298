"""DuckDB SQL for the queries of `queries.py`."""

from __future__ import annotations

from ..operators import templates
from . import corpus
from .queries import _OUTPUT, _RUNS, HUMPS

_PART = lambda sql: sql.replace("{part}", "part")
_FILES = f"files AS ({_PART(corpus.SCRIPTS)})"
_LEX = r"""[rRbBuU]*"[^"\\\n]*(?:\\.[^"\\\n]*)*"|#[^\n]*|\^+=?|[A-Za-z_]\w*|\d[\d_]*(?:\.\d*)?|[ \t]+|\n|(?s:.)"""
_TOKENS = f"""lexed AS (SELECT file_id, ext, regexp_extract_all(text, '{_LEX}') AS l FROM files),
raw AS (SELECT file_id, ext, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM lexed),
placed AS (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY file_id ORDER BY i) AS INTEGER) - CAST(length(x) AS INTEGER) AS spot FROM raw),
carets AS (
    SELECT file_id, ext, i, spot AS start_at, CASE WHEN x LIKE '^^^%=' THEN x[:-3] ELSE x END AS lexeme,
           CASE WHEN x = '^' THEN 'EXP' WHEN x = '^=' THEN 'EXPEQ' WHEN x = '^^=' THEN 'XOREQ' ELSE 'XOR' END AS type FROM placed WHERE x LIKE '^%'
    UNION ALL SELECT file_id, ext, i, spot + CAST(length(x) AS INTEGER) - 2, '^=', 'EXPEQ' FROM placed WHERE x LIKE '^^^%=')"""
_GEN = r"^([A-Za-z_]\w*)\s*\.\s*<\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*>\s*=(.*)$"
_LINES = "lines AS (SELECT file_id, ext, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM files)"
_GENS = f"""{_LINES}, gens AS (SELECT file_id, line_no, regexp_extract(line, '{_GEN}', 1) AS factory_name, string_split(regexp_extract(line, '{_GEN}', 2), ',') AS names,
    nullif(regexp_extract(string_split(regexp_extract(line, '{_GEN}', 3), ';')[1], '^\\s*([A-Za-z_][\\w.]*)\\s*\\(', 1), '') AS callee FROM lines WHERE ext = 'sage' AND regexp_matches(line, '{_GEN}'))"""
_EXPLICIT = r"explicit AS (SELECT file_id FROM files WHERE regexp_matches(text, '(?m)^\s*from\s+sage\.all\s+import\b'))"
_IMPLICIT = f"{_EXPLICIT}, implicit AS (SELECT file_id FROM files WHERE ext = 'sage' AND file_id NOT IN (SELECT file_id FROM explicit))"
_STUBS = f"symbols AS ({_PART(corpus.SYMBOLS)}), stubs AS (SELECT * FROM symbols WHERE contains(path, '/site-packages/sage/') AND path LIKE '%.pyi'), home AS (SELECT path FROM stubs WHERE kind = 'function' AND name = 'GF' ORDER BY path, pos LIMIT 1)"
_NAMES = f"{_STUBS}, names AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src, pos) AS rn FROM stubs WHERE path IN (SELECT path FROM home) AND name <> '__all__') WHERE rn = 1)"
_DECLARED = "declared AS (SELECT name AS n, kind AS k, module AS m, path AS p, pos AS o FROM stubs WHERE kind IN ('function', 'class'))"
_FOLLOW = f"""{_DECLARED}, looks AS (SELECT DISTINCT module, imported_name, 0 AS t, imported_name AS look FROM symbols WHERE kind = 'import'
    UNION SELECT DISTINCT module, imported_name, 2, regexp_replace(imported_name, '_with_category$', '') FROM symbols WHERE kind = 'import' AND imported_name LIKE '%\\_with\\_category' ESCAPE '\\'),
follow AS (SELECT * FROM (SELECT module, imported_name, n, k, m, p, row_number() OVER (PARTITION BY module, imported_name ORDER BY n IS NULL, t + CASE WHEN m = module THEN 0 ELSE 1 END, CASE WHEN k = 'function' THEN 0 ELSE 1 END, p, o) AS rn
    FROM looks LEFT JOIN declared ON n = look) WHERE rn = 1)"""
_TARGETS = f"""{_NAMES}, {_FOLLOW}, targets AS (SELECT name, names.path AS home_path, annotation, CASE WHEN kind = 'listed' THEN NULL ELSE kind END AS kind,
    CASE WHEN kind = 'import' AND k IS NOT NULL THEN n ELSE name END AS target_name, CASE WHEN kind = 'import' AND k IS NOT NULL THEN k WHEN kind = 'listed' THEN NULL ELSE kind END AS target_kind,
    CASE WHEN kind = 'import' AND k IS NOT NULL THEN p ELSE names.path END AS target_path FROM names LEFT JOIN follow USING (module, imported_name))"""
_UP = f"bases AS ({_PART(corpus.BASES)}), methods AS ({_PART(corpus.METHODS)}), up(class_name, ancestor, distance) AS (SELECT class_name, class_name, 0 FROM (SELECT class_name FROM bases UNION SELECT base FROM bases) UNION SELECT up.class_name, b.base, distance + 1 FROM up JOIN bases b ON b.class_name = up.ancestor)"
_CALLABLE = f"""{_TARGETS}, {_UP}, calling AS (SELECT class_name FROM up JOIN methods ON methods.class_name = ancestor AND method = '__call__' UNION SELECT class_name FROM methods WHERE method = '__call__'),
typed AS (SELECT s.name AS a, s.path AS ap, n AS via FROM symbols s JOIN follow USING (module, imported_name) WHERE s.kind = 'import' AND k = 'class'),
entries AS (SELECT name, target_kind AS kind, coalesce(target_kind IN ('function', 'class') OR target_kind = 'attribute' AND coalesce(via, annotation) IN (SELECT class_name FROM calling), false) AS is_callable
    FROM targets LEFT JOIN typed ON annotation = a AND home_path = ap)""".replace("SELECT class_name FROM up JOIN methods", "SELECT up.class_name FROM up JOIN methods")
_FIND = f"""{_STUBS}, {_FOLLOW}, tiers AS (SELECT name, kind, path, module, imported_name, pos, CASE WHEN path IN (SELECT path FROM home) AND kind = 'attribute' THEN 1 WHEN path IN (SELECT path FROM home) AND kind = 'import' THEN 2
    WHEN kind IN ('function', 'class') THEN CASE WHEN path IN (SELECT path FROM home) THEN 3 ELSE 4 END END AS tier FROM stubs WHERE kind <> 'listed'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, CASE WHEN kind = 'class' THEN 1 ELSE 0 END, path, pos) AS rn FROM tiers WHERE tier IS NOT NULL) WHERE rn = 1),
found AS (SELECT name, tier, CASE WHEN tier = 2 AND k IS NOT NULL THEN k ELSE kind END AS target_kind, CASE WHEN tier = 2 AND p IS NOT NULL THEN p ELSE path END AS target_path FROM best LEFT JOIN follow USING (module, imported_name))"""
_GENTYPES = f"""{_FILES}, {_GENS}, {_UP}, made AS (SELECT gens.*, r.class_name AS factory_class FROM gens LEFT JOIN ({_PART(corpus.RETURNS)}) r USING (callee)),
first_gens AS (SELECT class_name, return_elem AS gen_class FROM (SELECT up.class_name, return_elem, row_number() OVER (PARTITION BY up.class_name ORDER BY distance, ancestor) AS rn FROM up JOIN methods m ON m.class_name = ancestor AND method = '_first_ngens') WHERE rn = 1),
gentypes AS (SELECT file_id, line_no, factory_name AS target, factory_class AS class_name FROM made UNION ALL SELECT file_id, line_no, x, gen_class FROM (SELECT file_id, line_no, factory_class, unnest(names) AS x FROM made) LEFT JOIN first_gens ON class_name = factory_class)"""
_LITERALS = f"""assigned AS (SELECT file_id, line_no, regexp_extract(line, '^([A-Za-z_]\\w*)\\s*=\\s*([^=].*)$', 1) AS target, trim(regexp_extract(line, '^([A-Za-z_]\\w*)\\s*=\\s*([^=].*)$', 2)) AS rhs FROM lines WHERE ext = 'sage' AND regexp_matches(line, '^[A-Za-z_]\\w*\\s*=\\s*[^=]')),
literals AS (SELECT file_id, line_no, target, CASE WHEN regexp_matches(rhs, '^\\d+$') THEN 'Integer' ELSE 'RealNumber' END AS class_name FROM assigned WHERE regexp_matches(rhs, '^\\d+(\\.\\d*)?$'))"""
_MISUSE = f"""{_FILES}, {_TOKENS}, code AS (SELECT *, lag(x) OVER w AS before, lead(x) OVER w AS after, lag(x, 2) OVER w AS opened, lag(x, 3) OVER w AS called FROM placed WHERE NOT regexp_matches(x, '^[ \\t]') AND x NOT LIKE '#%' WINDOW w AS (PARTITION BY file_id ORDER BY i)),
misuse AS (SELECT file_id, spot AS start_at, x AS lexeme, concat('^', x) AS fix FROM code WHERE ext = 'sage' AND x IN ('^', '^=') AND (regexp_matches(before, '(?i)^(b|br|rb)["'']') OR regexp_matches(after, '(?i)^(b|br|rb)["'']')))"""
_KEYS = [*templates.CALL_WRAPS, *(k for k, _ in templates.FIXED_POSTFIX)]
_q = lambda s: "'" + s.replace("'", "''") + "'"
_LIVE = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(k)}, {_q(v)})" for i, (k, v, _) in enumerate(templates.LIVE)) + ") AS t(i, key, value)"
_SLOTS = "SELECT * FROM (VALUES " + ", ".join(f"({_q(k)}, {_q(s)}, {_q(v)})" for k, _, d in templates.LIVE for s, v in d.items()) + ") AS t(key, slot, preset)"


def _by_module(columns: str, rows: str) -> str:
    """Rows that are known by hand for each text of `corpus.MODULES`: one tuple (text, …) a line."""
    return f"SELECT p_partkey AS file_id, {columns} FROM part JOIN (VALUES {', '.join(rows.split(chr(10))[1:-1])}) AS t(v, {columns}) ON p_partkey % {len(corpus.MODULES)} = v"


_ERRORS = """
(4, 1, true)
(4, 4, true)
(4, 12, true)
(5, 0, false)
(5, 1, true)
(5, 3, true)
(5, 5, false)
"""
_STATEMENTS = """
(2, 0, 0, 'R', 'x', 'GF', 8)
(4, 5, 7, 'T', 'z', 'PolynomialRing', 44)
(4, 11, 11, 'V', 'v', 'GF', 14)
(5, 0, 0, 'Q', 'w', NULL, 0)
(5, 5, 5, 'U', 't', 'GF', 3)
"""
_ROLES = """
(0, 0, 'function', 'f')
(0, 0, 'parameter', 'a,k,z')
(0, 0, 'reference', 'bytes,q')
(0, 1, 'reference', 'k')
(0, 2, 'function', 'g')
(0, 2, 'parameter', 'k')
(0, 3, 'reference', 'k,w')
(0, 4, 'lambda', 'j,k')
(0, 4, 'reference', 'k,z')
(0, 4, 'target', 'h')
(1, 0, 'reference', 'b,bytes')
(1, 0, 'target', 'k')
(1, 1, 'class', 'A')
(1, 1, 'reference', 'B')
(1, 2, 'target', 'k')
(1, 3, 'function', 'm')
(1, 3, 'parameter', 'self')
(1, 3, 'reference', 'T,int')
(1, 4, 'attribute', 'k')
(1, 4, 'reference', 'k,self')
(1, 5, 'reference', 'k')
(1, 5, 'target', 'u')
(1, 6, 'function', 'n')
(1, 7, 'target', 'k')
(1, 8, 'reference', 'k')
(1, 9, 'loop', 'k')
(1, 9, 'reference', 'k,k,k,range')
(1, 9, 'target', 'y,z')
(2, 0, 'generator', 'R,x')
(2, 0, 'reference', 'GF,q,x')
(2, 1, 'function', 'area')
(2, 1, 'parameter', 'n,r')
(2, 1, 'reference', 'N')
(2, 2, 'global', 'total')
(2, 3, 'reference', 'pi,r')
(2, 3, 'target', 'total')
(2, 4, 'loop', 't')
(2, 4, 'reference', 'ZZ,sum,t,total')
(2, 5, 'reference', 'lost,total,x')
(2, 5, 'target', 'y')
(2, 6, 'loop', 'i,j')
(2, 6, 'reference', 'i,j,pairs')
(2, 6, 'target', 's')
(2, 7, 'keyword', 'key')
(2, 7, 'reference', 'GF,N,f,m,print')
(2, 7, 'walrus', 'm')
(3, 0, 'attribute', 'path')
(3, 0, 'import', 'os,p')
(3, 0, 'source', 're')
(3, 1, 'attribute', 'b')
(3, 1, 'import', 'c,e')
(3, 1, 'source', 'a,d')
(3, 2, 'as', 'fh')
(3, 2, 'reference', 'o,open')
(3, 3, 'attribute', 'read')
(3, 3, 'reference', 'fh')
(3, 3, 'target', 'data,t2')
(3, 5, 'target', 'x')
(3, 6, 'reference', 'ECM')
(3, 6, 'target', 'a,b')
(3, 7, 'attribute', 'all')
(3, 7, 'import', 'factor')
(3, 7, 'source', 'sage')
(4, 0, 'reference', 'f')
(4, 1, 'reference', 'GF,R,x')
(4, 3, 'target', 'a')
(4, 4, 'reference', 'GF,S,y')
(4, 5, 'generator', 'T,z')
(4, 5, 'reference', 'PolynomialRing')
(4, 6, 'reference', 'GF')
(4, 7, 'reference', 'z')
(4, 8, 'target', 's')
(4, 11, 'generator', 'V,v')
(4, 11, 'reference', 'GF,v')
(4, 11, 'target', 'q')
(4, 12, 'reference', 'GF,W,w')
(5, 0, 'generator', 'Q,w')
(5, 1, 'target', 'x')
(5, 2, 'target', 'y')
(5, 3, 'function', 'broken')
(5, 5, 'generator', 'U,t')
(5, 5, 'reference', 'GF')
(6, 0, 'reference', 'fac')
(6, 0, 'target', 'y')
(6, 1, 'attribute', 'fac')
(6, 1, 'reference', 'obj')
(6, 1, 'target', 'x1')
(6, 2, 'target', 'fac')
(6, 3, 'import', 'Inte')
(6, 3, 'source', 'm')
(6, 4, 'reference', 'GF,Inte,cc,eCm,gho,nA,print')
"""
_BOUND = """
(0, 0, 'none', false, 'bytes,q')
(0, 1, 'inner', true, 'k')
(0, 3, 'inner', false, 'k')
(0, 3, 'none', false, 'w')
(0, 4, 'inner', false, 'k')
(0, 4, 'none', false, 'z')
(1, 0, 'none', false, 'b,bytes')
(1, 1, 'none', false, 'B')
(1, 3, 'none', false, 'T,int')
(1, 4, 'inner', false, 'self')
(1, 4, 'module', true, 'k')
(1, 5, 'inner', false, 'k')
(1, 8, 'inner', false, 'k')
(1, 9, 'inner', false, 'k,k')
(1, 9, 'module', true, 'k')
(1, 9, 'none', false, 'range')
(2, 0, 'module', false, 'x')
(2, 0, 'none', false, 'GF,q')
(2, 1, 'none', false, 'N')
(2, 3, 'inner', false, 'r')
(2, 3, 'none', false, 'pi')
(2, 4, 'module', false, 'total')
(2, 4, 'none', false, 'ZZ,sum,t')
(2, 5, 'module', false, 'total,x')
(2, 5, 'none', false, 'lost')
(2, 6, 'module', false, 'i,j')
(2, 6, 'none', false, 'pairs')
(2, 7, 'module', false, 'm')
(2, 7, 'none', false, 'GF,N,f,print')
(3, 2, 'none', false, 'o,open')
(3, 3, 'module', false, 'fh')
(3, 6, 'none', false, 'ECM')
(4, 0, 'none', false, 'f')
(4, 1, 'none', false, 'GF,R,x')
(4, 4, 'none', false, 'GF,S,y')
(4, 5, 'none', false, 'PolynomialRing')
(4, 6, 'none', false, 'GF')
(4, 7, 'module', false, 'z')
(4, 11, 'module', false, 'v')
(4, 11, 'none', false, 'GF')
(4, 12, 'none', false, 'GF,W,w')
(5, 5, 'none', false, 'GF')
(6, 0, 'module', false, 'fac')
(6, 1, 'none', false, 'obj')
(6, 4, 'module', false, 'Inte')
(6, 4, 'none', false, 'GF,cc,eCm,gho,nA,print')
"""
_OPEN = """
(0, 0, 'q', 'none', NULL)
(0, 3, 'w', 'none', NULL)
(0, 4, 'z', 'none', NULL)
(1, 0, 'b', 'none', NULL)
(1, 1, 'B', 'none', NULL)
(1, 3, 'T', 'none', NULL)
(2, 0, 'GF', 'catalog', 'function')
(2, 0, 'q', 'none', NULL)
(2, 0, 'x', 'generator', 'target')
(2, 1, 'N', 'catalog', 'function')
(2, 3, 'pi', 'catalog', 'attribute')
(2, 4, 'ZZ', 'catalog', 'attribute')
(2, 4, 't', 'none', NULL)
(2, 5, 'lost', 'catalog', 'import')
(2, 6, 'pairs', 'none', NULL)
(2, 7, 'GF', 'catalog', 'function')
(2, 7, 'N', 'catalog', 'function')
(2, 7, 'f', 'none', NULL)
(4, 0, 'f', 'none', NULL)
(4, 1, 'GF', 'catalog', 'function')
(4, 1, 'R', 'none', NULL)
(4, 1, 'x', 'none', NULL)
(4, 4, 'GF', 'catalog', 'function')
(4, 4, 'S', 'none', NULL)
(4, 4, 'y', 'none', NULL)
(4, 5, 'PolynomialRing', 'none', NULL)
(4, 6, 'GF', 'catalog', 'function')
(4, 7, 'z', 'generator', 'target')
(4, 11, 'GF', 'catalog', 'function')
(4, 12, 'GF', 'catalog', 'function')
(4, 12, 'W', 'none', NULL)
(4, 12, 'w', 'none', NULL)
(5, 5, 'GF', 'catalog', 'function')
(6, 1, 'obj', 'none', NULL)
(6, 4, 'GF', 'catalog', 'function')
(6, 4, 'cc', 'none', NULL)
(6, 4, 'eCm', 'none', NULL)
(6, 4, 'gho', 'none', NULL)
(6, 4, 'nA', 'none', NULL)
"""
_COMPLETED = """
(0, 87, 'ZZ', 'attribute', true, 'ZZ()', 3)
(1, 61, 'Integer', 'class', true, 'Integer()', 8)
(2, 10, 'GF', 'function', true, 'GF', 3)
(2, 32, 'N', 'function', true, 'N()', 2)
(2, 66, 'pi', 'attribute', false, 'pi', 2)
(2, 103, 'ZZ', 'attribute', true, 'ZZ()', 3)
(2, 125, 'lost', 'import', false, 'lost', 4)
(2, 154, 'Integer', 'class', true, 'Integer()', 8)
(2, 169, 'N', 'function', true, 'N', 2)
(2, 189, 'factor', 'function', true, 'factor', 7)
(2, 196, 'GF', 'function', true, 'GF()', 3)
(4, 1, 'factor', 'function', true, 'factor', 7)
(4, 13, 'GF', 'function', true, 'GF', 3)
(4, 41, 'GF', 'function', true, 'GF', 3)
(4, 77, 'GF', 'function', true, 'GF', 3)
(4, 93, 'ZZ', 'attribute', true, 'ZZ()', 3)
(4, 136, 'GF', 'function', true, 'GF', 3)
(4, 158, 'GF', 'function', true, 'GF', 3)
(5, 53, 'GF', 'function', true, 'GF', 3)
(6, 7, 'factor', 'function', true, 'factor', 7)
(6, 61, 'Integer', 'class', true, 'Integer()', 8)
(6, 65, 'GF', 'function', true, 'GF()', 3)
(6, 73, 'CC', 'attribute', false, 'CC', 2)
(6, 82, 'ECM', 'class', true, 'ECM', 4)
(6, 90, 'ghost', NULL, false, 'ghost', 5)
"""
#: What the templates make of `corpus.CARETS`, worked out by hand: text, start of the expression, script and caret afterwards.
_EXPANDED = (
    (0, 10, "y = a + b*ZZ(c)", 15),
    (0, 8, "y = a + ZZ(b*c)", 15),
    (0, 4, "y = ZZ(a + b*c)", 15),
    (1, 4, "y = (a + b*c)^2", 15),
    (2, 9, "z = f(x, len([1, 2]))  # t", 20),
    (3, 10, "z = [1] + len([2])", 18),
    (5, 6, "print(f('a b'))", 14),
    (6, 7, 'x = -a^int(b).to_bytes(, "big")\ny = 1', 23),
    (6, 5, 'x = -int(a^b).to_bytes(, "big")\ny = 1', 23),
    (6, 4, 'x = int(-a^b).to_bytes(, "big")\ny = 1', 23),
    (10, 24, "g(lambda t: t if t else N(u))", 28),
    (10, 12, "g(lambda t: N(t if t else u))", 28),
    (10, 2, "g(N(lambda t: t if t else u))", 28),
    (12, 4, "h = (x in y and not z)^2", 24),
    (13, 16, "R.<t> = GF(\n    ZZ(p))", 21),
    (14, 13, "v = a ^^ b ^ QQ(c)", 18),
    (14, 9, "v = a ^^ QQ(b ^ c)", 18),
    (14, 4, "v = QQ(a ^^ b ^ c)", 18),
)
#: The unbound references of the second and third lines of `corpus.SCRIPTS`, and what each of the three lines binds.
_SCRIPT_REFS = """refs AS (SELECT file_id, 1 AS line_no, name FROM files JOIN (VALUES (1, 'NumberField'), (1, 'x'), (2, 'e'), (4, 'k')) AS t(v, name) ON file_id % 8 = v
        UNION ALL SELECT file_id, 1, CASE WHEN file_id % 16 = 0 THEN 'GF' ELSE concat('fn', CAST(file_id - file_id % 6 + 1 AS VARCHAR)) END FROM files WHERE file_id % 8 = 0
        UNION ALL SELECT file_id, 1, unnest(['R', 'x']) FROM files WHERE file_id % 16 = 5
        UNION ALL SELECT file_id, 2, name FROM files JOIN (VALUES (0, 'a'), (0, 'b'), (2, 'p'), (2, 'q'), (6, 'a'), (6, 'b'), (7, 'f'), (7, 'x'), (7, 'y'), (8, 'g'), (8, 't'), (10, 'ZZ')) AS t(v, name) ON file_id % 11 = v),
    binds AS (SELECT file_id, name FROM files JOIN (VALUES (2, 's'), (3, 'ZZ'), (4, 'os')) AS t(v, name) ON file_id % 5 = v
        UNION ALL SELECT file_id, name FROM files JOIN (VALUES (0, 'x'), (1, 'F'), (1, 'a'), (1, 'b'), (2, 'y'), (3, 'm'), (4, 'z'), (7, 'n')) AS t(v, name) ON file_id % 8 = v
        UNION ALL SELECT file_id, unnest(['Q', 'w']) FROM files WHERE file_id % 16 = 13
        UNION ALL SELECT file_id, name FROM files JOIN (VALUES (0, 'c'), (1, 'm'), (2, 'w'), (3, 'v'), (4, 'u'), (5, 's'), (7, 'd'), (8, 'h'), (8, 'v'), (9, 'i'), (9, 'v'), (10, 'S'), (10, 'y'), (10, 'T')) AS t(v, name) ON file_id % 11 = v)"""
#: What no parser reads, by line: in scripts and in plain Python.
_SCRIPT_ERRORS = """SELECT file_id, 1 AS line_no FROM files WHERE ext = 'sage' AND file_id % 16 = 5 UNION ALL SELECT file_id, 2 FROM files WHERE ext = 'sage' AND file_id % 11 = 6
        UNION ALL SELECT file_id, 1 FROM files WHERE ext = 'py' AND file_id % 8 IN (1, 3, 5) UNION ALL SELECT file_id, 2 FROM files WHERE ext = 'py' AND file_id % 11 IN (2, 6, 9, 10)"""


def _argv(mode: str) -> str:
    runs = f"runs AS ({_RUNS.replace('{supplier}', 'supplier').replace('{mode}', mode)})"
    split = lambda c: f"[x for x in string_split({c}, ' ') if x <> '']"
    unix = "replace(script_path, chr(92), '/')"
    mounted = rf"CASE WHEN regexp_matches({unix}, '^[A-Za-z]:/') THEN concat('/mnt/', lower({unix}[1]), {unix}[3:]) ELSE {unix} END"
    folder = r"CASE WHEN regexp_matches(script_path, '[/\\]') THEN regexp_extract(script_path, '^(.*)[/\\][^/\\]*$', 1) END"
    name = f"string_split({unix}, '/')[-1]"
    real = mode if mode in ("NATIVE", "WSL", "DOCKER") else "NATIVE"
    argv = {
        "NATIVE": f"list_concat([executable], {split('parameters')}, [script_path], {split('script_parameters')})",
        "WSL": f"list_concat(['wsl.exe', '-d', wsl_distribution, '--', executable], {split('parameters')}, [{mounted}], {split('script_parameters')})",
        "DOCKER": f"list_concat(['docker', 'run', '--rm', '-v', concat({folder}, ':', docker_dir), '-w', docker_dir, docker_image, docker_command], {split('parameters')}, [{name}], {split('script_parameters')})",
    }[real]
    extra = {"WSL": "WHEN trim(executable) = '' OR executable LIKE '~%' THEN 'executable is not configured'", "DOCKER": f"WHEN {folder} IS NULL THEN 'no script directory'"}.get(real, "")
    error = f"CASE WHEN trim(script_path) = '' THEN 'script path is empty' {extra} END"
    return f"WITH {runs} SELECT name, '{real}' AS mode, CASE WHEN {error} IS NULL THEN array_to_string({argv}, '|') END AS argv, {error} AS error FROM runs"


ORACLE_SQL: dict[str, str] = {
    "caret_tokens": f"WITH {_FILES}, {_TOKENS} SELECT file_id, start_at, lexeme, type FROM carets",
    "caret_type_counts": f"WITH {_FILES}, {_TOKENS} SELECT type, count(*) AS n, count(DISTINCT file_id) AS files FROM carets GROUP BY type",
    "token_stats": f"""WITH {_FILES}, {_TOKENS} SELECT file_id, count(*) FILTER (regexp_matches(x, '^[A-Za-z_]') AND NOT regexp_matches(x, '"$')) AS names,
        count(*) FILTER (regexp_matches(x, '"$') AND x NOT LIKE '#%') AS strings, count(*) FILTER (x LIKE '#%') AS comments, CAST(sum(length(x)) AS BIGINT) AS chars FROM placed GROUP BY file_id""",
    "generator_statements": f"WITH {_FILES}, {_GENS} SELECT file_id, line_no, factory_name, array_to_string(names, ',') AS names, callee FROM gens",
    "generator_names": f"WITH {_FILES}, {_GENS} SELECT file_id, factory_name AS first_target, unnest(names) AS name FROM gens",
    "explicit_import_files": f"WITH {_FILES}, {_EXPLICIT} SELECT file_id FROM explicit",
    "implicit_files": f"WITH {_FILES}, {_IMPLICIT} SELECT file_id FROM implicit",
    "stub_files": f"WITH s AS (SELECT DISTINCT path FROM ({_PART(corpus.SYMBOLS)})) SELECT path, contains(path, '/site-packages/sage/') AS library, contains(path, '/site-packages/sage/') AND path LIKE '%.pyi' AS stub, contains(path, '/site-packages/sage/') AND path LIKE '%/all.pyi' AS all_stub FROM s",
    "namespace_anchor": f"WITH {_STUBS} SELECT path FROM home",
    "namespace_first_wins": f"WITH {_NAMES} SELECT name, nullif(kind, 'listed') AS kind, annotation, imported_name FROM names",
    "alias_follow": f"WITH {_STUBS}, {_FOLLOW} SELECT module, imported_name, n AS target_name, k AS target_kind, m AS target_module, p AS target_path, CASE WHEN k = 'class' THEN n END AS class_name FROM follow",
    "entry_target": f"WITH {_TARGETS} SELECT name, target_name, target_kind, target_path FROM targets",
    "callable_names": f"WITH RECURSIVE {_CALLABLE} SELECT name, is_callable FROM entries",
    "find_class": f"WITH {_STUBS}, c AS (SELECT * FROM (SELECT name, path, module, row_number() OVER (PARTITION BY name ORDER BY path, pos) AS rn FROM stubs WHERE kind = 'class') WHERE rn = 1) SELECT s.name, c.path AS class_path, c.module AS class_module FROM (SELECT DISTINCT name FROM symbols) s LEFT JOIN c USING (name)",
    "find_declarations": f"WITH {_FIND} SELECT n.name, coalesce(tier, 0) AS tier, target_kind, target_path FROM (SELECT DISTINCT name FROM symbols UNION SELECT 'nothing') n LEFT JOIN found USING (name)",
    "literal_types": f"WITH {_FILES}, {_LINES}, {_LITERALS} SELECT * FROM literals",
    "generator_types": f"WITH RECURSIVE {_GENTYPES} SELECT * FROM gentypes",
    "target_types": f"WITH RECURSIVE {_GENTYPES}, {_LITERALS} SELECT * FROM gentypes WHERE class_name IS NOT NULL UNION ALL SELECT * FROM literals",
    "attribute_types": f"WITH {_STUBS}, {_FOLLOW} SELECT a.name, n AS class_name FROM stubs a JOIN stubs i ON i.kind = 'import' AND i.name = a.annotation AND i.path = a.path JOIN follow f ON f.module = i.module AND f.imported_name = i.imported_name WHERE a.kind = 'attribute' AND starts_with(a.annotation, '_Type_') AND k = 'class'",
    "bytes_operand_lint": f"WITH {_MISUSE} SELECT * FROM misuse",
    "bytes_context_lint": f"""WITH {_MISUSE} SELECT *, 'ERROR' AS level FROM misuse
        UNION SELECT file_id, spot, x, '^^', 'ERROR' FROM code JOIN files USING (file_id, ext) WHERE ext = 'sage' AND x = '^' AND (opened = '(' AND called = 'bytes' OR contains(text, concat(before, ': bytes')))""",
    "statement_errors": f"WITH {_FILES}, {_GENS} SELECT file_id, line_no, 'expression expected' AS message FROM gens JOIN lines USING (file_id, line_no) WHERE line LIKE '%='",
    "shortened_values": f"""WITH {_FILES}, {_GENS}, v AS (SELECT file_id, line_no, trim(regexp_extract(line, '{_GEN}', 3)) AS rhs FROM gens JOIN lines USING (file_id, line_no))
        SELECT file_id, line_no, concat(rhs, ' of ', repeat(rhs, 9))[:60] AS shown FROM v""",
    "candidate_counts": f"WITH {_STUBS} SELECT n.name, count(s.name) AS n FROM (SELECT DISTINCT name FROM symbols) n LEFT JOIN stubs s ON s.name = n.name AND s.kind IN ('function', 'class') GROUP BY n.name",
    "corpus_summary": f"""WITH {_MISUSE}, {_GENS}, {_IMPLICIT}, bad AS (SELECT * FROM misuse
        UNION SELECT file_id, spot, x, '^^' FROM code JOIN files USING (file_id, ext) WHERE ext = 'sage' AND x = '^' AND (opened = '(' AND called = 'bytes' OR contains(text, concat(before, ': bytes'))))
        SELECT file_id, ext, (SELECT count(*) FROM carets c WHERE c.file_id = f.file_id) AS carets, (SELECT count(*) FROM gens g WHERE g.file_id = f.file_id) AS generators,
        (SELECT count(*) FROM gens g JOIN lines l USING (file_id, line_no) WHERE g.file_id = f.file_id AND line LIKE '%=') AS errors,
        (SELECT count(*) FROM bad b WHERE b.file_id = f.file_id) AS misuse, file_id IN (SELECT file_id FROM implicit) AS implicit FROM files f""",
    "visible_errors": f"WITH {_FILES} {_SCRIPT_ERRORS}",
    "module_errors": _by_module("line_no, visible", _ERRORS),
    "module_statements": _by_module("line_no, last_line, factory_name, names, callee, rhs_chars", _STATEMENTS),
    "name_roles": _by_module("line_no, role, names", _ROLES),
    "scoped_references": _by_module("line_no, bound, as_bytes, names", _BOUND),
    "scoped_lint": _by_module("start_at, fix", "\n(0, 39, '^^')\n(1, 81, '^^')\n(1, 181, '^^')\n"),
    "module_resolution": _by_module("line_no, name, origin, target_kind", _OPEN),
    "completion_lookup": f"SELECT *, 'sage.all' AS type_text FROM ({_by_module('pos, name, kind, is_callable, insert_text, caret', _COMPLETED)})",
    "hump_matches": f"""SELECT p_partkey, prefix, name FROM part JOIN (VALUES (0, 'NF', 'NumberField'), (1, 'nuF', 'NumberField'), (2, 'cFi', 'ComplexField_class'), (3, 'iR_c', 'IntegerRing_class'), (4, 'gf', 'GF'), (5, 'GF', 'GF'),
        (6, '_T', '_Type_CC'), (6, '_T', '_Type_ZZ'), (7, 'facI', 'factor_impl'), (8, 'RN', 'RealNumber')) AS t(v, prefix, name) ON p_partkey % {len(HUMPS)} = v""",
    "resolve_names": f"""WITH {_FILES}, {_IMPLICIT}, {_FIND}, {_SCRIPT_REFS}
        SELECT file_id, line_no, name, CASE WHEN tier > 0 THEN 'catalog' ELSE 'none' END AS origin, target_kind, target_path FROM refs LEFT JOIN found USING (name)
        WHERE file_id IN (SELECT file_id FROM implicit) AND (file_id, name) NOT IN (SELECT (file_id, name) FROM binds)""",
    "stub_declarations": f"""WITH k AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, CAST(p_partkey - 1 AS VARCHAR) AS b FROM part), m AS (SELECT *, concat('sage.gen.m', s) AS module FROM k)
        SELECT concat('Cls', s) AS name, 'class' AS kind, module, NULL AS annotation, NULL AS imported_name FROM m
        UNION ALL SELECT concat('at', s), 'attribute', module, concat('Cls', s), NULL FROM m
        UNION ALL SELECT concat('fn', s), 'function', module, CASE k % 4 WHEN 0 THEN concat('Cls', s) WHEN 1 THEN concat(chr(39), 'Cls', s, chr(39)) WHEN 2 THEN concat('Optional[Cls', s, ']') ELSE concat('Tuple[Cls', s, ', int]') END, NULL FROM m
        UNION ALL SELECT 'Up', 'import', CASE WHEN k % 10 = 0 THEN 'sage.structure.parent' ELSE concat('sage.gen.m', b) END, NULL, CASE WHEN k % 20 = 0 THEN 'Parent' WHEN k % 10 = 0 THEN 'Ring' ELSE concat('Cls', b) END FROM m
        UNION ALL SELECT * FROM (VALUES ('make', 'import', 'sage.gen.m5', NULL, 'fn5'), ('GF', 'function', 'sage.all', chr(39) || 'Cls10' || chr(39), NULL), ('__all__', 'attribute', 'sage.all', NULL, NULL), ('ghost', 'listed', 'sage.all', NULL, NULL),
            ('Parent', 'class', 'sage.structure.parent', NULL, NULL), ('Ring', 'class', 'sage.structure.parent', NULL, NULL)) AS t""",
    "stub_bases": "SELECT concat('Cls', CAST(p_partkey AS VARCHAR)) AS class_name, CASE WHEN p_partkey % 20 = 0 THEN 'Parent' WHEN p_partkey % 10 = 0 THEN 'Ring' ELSE concat('Cls', CAST(p_partkey - 1 AS VARCHAR)) END AS base FROM part",
    "stub_methods": """WITH m AS (SELECT p_partkey AS k, concat('Cls', CAST(p_partkey AS VARCHAR)) AS c, concat('El', CAST(p_partkey AS VARCHAR)) AS e FROM part)
        SELECT c AS class_name, '_first_ngens' AS method, CASE k % 6 WHEN 0 THEN 'tuple' WHEN 2 THEN 'tuple' WHEN 1 THEN 'union' ELSE 'instance' END AS return_kind,
            CASE WHEN k % 6 IN (1, 2) THEN concat(e, ',int') ELSE e END AS elems FROM m WHERE k % 5 = 0
        UNION ALL SELECT c, '__call__', NULL, NULL FROM m WHERE k % 15 = 0 UNION ALL SELECT 'Parent', '__call__', NULL, NULL""",
    "stub_returns": """WITH m AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s FROM part)
        SELECT concat('fn', s) AS callee, concat('Cls', s) AS class_name FROM m WHERE k % 4 <> 3 UNION ALL SELECT concat('Cls', s), concat('Cls', s) FROM m
        UNION ALL SELECT * FROM (VALUES ('Parent', 'Parent'), ('Ring', 'Ring'), ('GF', 'Cls10'), ('make', 'Cls5')) AS t""",
    "stub_callable_attributes": """WITH m AS (SELECT p_partkey AS k, p_partkey - p_partkey % 10 AS j FROM part)
        SELECT concat('at', CAST(k AS VARCHAR)) AS name, j % 20 = 0 OR j % 15 = 0 OR (j + 5 <= k AND (j + 5) % 15 = 0) AS is_callable FROM m""",
    "stub_generator_types": """WITH m AS (SELECT p_partkey AS k, p_partkey - p_partkey % 5 AS g FROM part)
        SELECT k AS file_id, 'G' AS target, CASE WHEN k % 4 <> 3 THEN concat('Cls', CAST(k AS VARCHAR)) END AS class_name FROM m
        UNION ALL SELECT k, 'g', CASE WHEN k % 4 <> 3 AND g % 6 <> 1 THEN concat('El', CAST(g AS VARCHAR)) END FROM m""",
    "template_keys": f"WITH {_FILES} SELECT file_id, file_id % 3 < 2 AS terminal, CAST(0 AS BIGINT) AS editable, CAST({len(_KEYS)} AS BIGINT) AS templates FROM files",
    "caret_fixes": f"""WITH {_MISUSE}, marked AS (SELECT p.file_id, p.i, concat(CASE WHEN m.lexeme IS NOT NULL THEN '^' ELSE '' END, x) AS piece FROM placed p LEFT JOIN misuse m ON m.file_id = p.file_id AND m.start_at = p.spot)
        SELECT file_id, string_agg(piece, '' ORDER BY i) AS fixed_text FROM marked WHERE file_id IN (SELECT file_id FROM misuse) GROUP BY file_id""",
    "postfix_expand": f"""WITH {_FILES}, x AS (SELECT file_id, concat('v', CAST(file_id AS VARCHAR)) AS e, {_KEYS}[file_id % {len(_KEYS)} + 1] AS key FROM files WHERE ext = 'sage'),
        y AS (SELECT *, CASE key WHEN 'b2i' THEN concat('int.from_bytes(', e, ', "big")') WHEN 'i2b' THEN concat('int(', e, ').to_bytes(, "big")') ELSE concat(key, '(', e, ')') END AS expanded FROM x)
        SELECT file_id, key, expanded, CAST(CASE key WHEN 'i2b' THEN length(e) + 15 ELSE length(expanded) END AS INTEGER) AS caret FROM y""",
    "postfix_at_caret": f"""SELECT p_partkey AS file_id, start_at, text, caret FROM part
        JOIN (VALUES {", ".join(f"({v}, {start}, {_q(text)}, {caret})" for v, start, text, caret in _EXPANDED)}) AS t(v, start_at, text, caret) ON p_partkey % {len(corpus.CARETS)} = v""",
    "live_template_expand": f"""WITH {_FILES}, t AS ({_LIVE}), slots AS ({_SLOTS}), r AS (SELECT file_id AS request_id, key, string_split(value, '$') AS parts FROM files JOIN t ON i = file_id % {len(templates.LIVE)}),
        p AS (SELECT request_id, key, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM r)
        SELECT request_id, key, string_agg(CASE WHEN k % 2 = 1 THEN part WHEN part = 'X' THEN concat('t', CAST(request_id AS VARCHAR)) WHEN part = 'BODY' THEN 'return' ELSE preset END, '' ORDER BY k) AS expanded
        FROM p LEFT JOIN slots USING (key) WHERE k % 2 = 1 AND (slot IS NULL OR slot = (SELECT min(slot) FROM slots s WHERE s.key = p.key)) OR k % 2 = 0 AND slot = part GROUP BY request_id, key""",
    "wsl_path": f"""WITH runs AS ({_RUNS.replace('{supplier}', 'supplier').replace('{mode}', 'WSL')}), u AS (SELECT name, replace(script_path, chr(92), '/') AS p, script_parameters FROM runs)
        SELECT name, CASE WHEN regexp_matches(p, '^[A-Za-z]:/') THEN concat('/mnt/', lower(p[1]), p[3:]) ELSE p END AS mounted, CAST(len([x for x in string_split(script_parameters, ' ') if x <> '']) AS BIGINT) AS n_args FROM u""",
    "detected_tools": f"""WITH o AS ({_OUTPUT.replace('{supplier}', 'supplier')}), l AS (SELECT id, string_split(regexp_replace(stdout, '^\\s+|\\s+$', '', 'g'), chr(10)) AS x FROM o)
        SELECT id, nullif(x[1], '') AS executable, ([y for y in x if contains(lower(y), 'sage')])[1] AS image, CASE WHEN x[-1] <> '' THEN concat(trim(x[-1]), '/x') ELSE '~/x' END AS home_x FROM l""",
    "run_configurations": f"WITH {_FILES} SELECT path AS script_path, CASE WHEN file_id % 2 = 0 THEN concat('r', CAST(file_id AS VARCHAR)) ELSE CAST(file_id AS VARCHAR) END AS name, file_id % 2 <> 0 AS is_new FROM files WHERE ext = 'sage'",
} | {f"argv_{m.lower()}": _argv(m) for m in ("NATIVE", "WSL", "DOCKER", "OTHER")}
