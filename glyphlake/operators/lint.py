"""Caret misuse in bytes context (P5, P6, T4, M5): a native subset by neighbouring tokens, and the whole rule by parsing."""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lex import tokens
from .statements import scripts

#: Prefixes of bytes literals and the calls that give bytes.
BYTES_PREFIXES = ('b"', "b'", 'br"', "br'", 'rb"', "rb'")
BYTES_CALLS = ("bytes", "bytes.fromhex", "int.to_bytes", "int.from_bytes")
BYTES_TYPES = ("bytes", "bytearray")


def bytes_literal(text: Column) -> Column:
    """P5, first part: the operand's text starts like a bytes literal."""
    head = F.lower(F.left(F.ltrim(text), F.lit(3)))
    out = F.lit(False)
    for p in BYTES_PREFIXES:
        out = out | head.startswith(p)
    return out


def literal_misuse(files: DataFrame) -> DataFrame:
    """T4, native subset: (file_id, start, end, lexeme, fix) of a single caret next to a bytes literal.

    The neighbours are found within each file's own token array, so nothing is shuffled.
    """
    from .lex import lexemes, raw_type

    rows = scripts(files).where(F.col("text").contains("^") & F.lower("text").rlike("b[r]?[\"']|rb[\"']"))
    code = F.filter(lexemes(F.col("text")), lambda t: ~raw_type(t.lexeme).isin("SPACE", "COMMENT"))
    rows = rows.select("file_id", code.alias("c"))
    hit = F.transform("c", lambda t, i: F.when(t.lexeme.isin("^", "^=") & (bytes_literal(F.get("c", i + 1).lexeme) | ((i > 0) & bytes_literal(F.get("c", F.greatest(i - 1, F.lit(0))).lexeme))), t))
    rows = rows.select("file_id", F.explode(F.array_compact(hit)).alias("t"))
    return rows.select("file_id", F.col("t.start").alias("start"), (F.col("t.start") + F.length("t.lexeme")).alias("end"), F.col("t.lexeme").alias("lexeme"), F.concat(F.lit("^"), F.col("t.lexeme")).alias("fix"))


def apply_fixes(files: DataFrame, hits: DataFrame) -> DataFrame:
    """(file_id, fixed_text): a caret is added at every hit, from the last to the first, so offsets stay right."""
    places = hits.groupBy("file_id").agg(F.reverse(F.array_sort(F.collect_set("start"))).alias("at"))
    fixed = F.aggregate("at", F.col("text"), lambda t, i: F.concat(F.left(t, i), F.lit("^"), F.substr(t, i + 1)))
    return files.join(places, "file_id").select("file_id", fixed.alias("fixed_text"))


#: What decides where code is: strings, comments, carets, brackets, ends of lines.
_PIECE = re.compile(
    r"""(?P<string>"{3}(?:[^"\\]|\\[\s\S]|"{1,2}(?!"))*+"{3}|'{3}(?:[^'\\]|\\[\s\S]|'{1,2}(?!'))*+'{3}|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+')
    |(?P<comment>\#[^\n]*+)|(?P<caret>\^++)|(?P<range>(?<!\.)\.\.(?!\.))|(?P<empty>\[[ \t]*\])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<line>\\\n|\n)""",
    re.VERBOSE,
)
#: The generators of a top-level statement, between its first target and the "=".
_GENERATORS = re.compile(r"(?m)(?<=^)([^\W\d]\w*)([ \t]*\.[ \t]*<[ \t]*[^\W\d]\w*(?:[ \t]*,[ \t]*[^\W\d]\w*)*[ \t]*>)(?=[ \t]+=(?!=))")
_HEADER = re.compile(r"(?:elif|else|except|finally|case)\b")


def _python(text: str) -> tuple[str, dict[int, tuple[int, str]], list[tuple[int, int]]]:
    """The script as Python, for each caret's new place its old one and spelling, and the spans of the logical lines.

    ^ becomes ** and ^^ becomes ^; generators and empty subscripts become blanks, a range's two points a comma.
    """
    heads = {m.start(): m for m in _GENERATORS.finditer(text)}
    out, back, lines, at, n, depth, begin = [], {}, [], 0, 0, 0, 0
    pieces = list(_PIECE.finditer(text))
    # Brackets that nothing closes hold no lines together.
    opened, closed = [], set()
    for m in pieces:
        if m.lastgroup == "open":
            opened.append(m.start())
        elif m.lastgroup == "close" and opened:
            closed.add(opened.pop())

    def plain(stop: int) -> None:
        """Text without carets, less the generators of a statement that begins in it."""
        nonlocal n, at
        if m := heads.get(at) if depth == 0 and n == begin else None:
            if m.end() <= stop:
                out.append(m[1] + " " * len(m[2]))
                n += m.end() - at
                at = m.end()
        out.append(text[at:stop])
        n += stop - at
        at = stop

    for m in pieces:
        if m.start() < at:
            continue
        plain(m.start())
        piece = m[0]
        match m.lastgroup:
            case "caret":
                back[n] = (at, piece + ("=" if text.startswith("=", m.end()) else ""))
                piece = "**" if len(piece) == 1 else "^" if len(piece) == 2 or not text.startswith("=", m.end()) else "^ **"
            case "range":
                piece = ", "
            case "empty":
                before = re.search(r"(?:([^\W\d]\w*)|[\w)\]])$", text[max(0, at - 40) : at])
                if before and not keyword.iskeyword(before[1] or ""):
                    piece = " " * len(piece)
            case "open":
                depth += m.start() in closed
            case "close":
                depth = max(0, depth - 1)
        out.append(piece)
        n += len(piece)
        at = m.end()
        if piece == "\n" and depth == 0:
            lines.append((begin, n))
            begin = n
    plain(len(text))
    lines.append((begin, n))
    return "".join(out), back, lines


def _parsed(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _trees(source: str, lines: list[tuple[int, int]]) -> list[tuple[ast.Module, str, int]]:
    """Parse trees with their text and where it begins: of the whole script, else of each top-level statement, else of each of its lines."""
    if tree := _parsed(source):
        return [(tree, source, 0)]
    out = []
    for block in _blocks(source, lines):
        a, b = block[0][0], block[-1][1]
        if tree := _parsed(source[a:b]):
            out.append((tree, source[a:b], a))
            continue
        for a, b in block:
            text = source[a:b].lstrip(" \t")
            text = text[2:] if text.startswith("elif") else text
            at = b - len(text)
            for whole in (text, text.rstrip() + " pass"):
                if tree := _parsed(whole):
                    out.append((tree, whole, at))
                    break
    return out


class _Place:
    """Offsets of nodes in their source, whose columns count UTF-8 bytes."""

    def __init__(self, source: str):
        self.source, self.lines, self.starts = source, source.split("\n"), [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def at(self, line: int, col: int) -> int:
        text = self.lines[line - 1]
        return self.starts[line - 1] + (col if text.isascii() else len(text.encode()[:col].decode("utf-8", "ignore")))

    def text(self, node: ast.AST) -> str:
        return self.source[self.at(node.lineno, node.col_offset) : self.at(node.end_lineno, node.end_col_offset)]

    def between(self, left: ast.AST, right: ast.AST) -> range:
        return range(self.at(left.end_lineno, left.end_col_offset), self.at(right.lineno, right.col_offset))


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
#: The scopes around a node from outside in: whether it is a class, and for each name that it binds whether it is annotated as bytes.
_Chain = tuple[tuple[bool, dict[str, bool]], ...]


def _bytes_like(node: ast.AST, place: _Place, chain: _Chain) -> bool:
    if isinstance(node, ast.Call):
        return place.text(node.func) in BYTES_CALLS
    if isinstance(node, ast.Name):
        return next((names[node.id] for _, names in reversed(chain) if node.id in names), False)
    return place.text(node).lstrip()[:3].lower().startswith(BYTES_PREFIXES)


def _bound(scope: ast.AST) -> dict[str, bool]:
    """The names that a module, class, function or comprehension binds itself, and which of them it annotates as bytes."""
    out: dict[str, bool] = {}
    shared: set[str] = set()
    bind = lambda name, kind=None: out.update({name: out.get(name, False) or (isinstance(kind, ast.Name) and kind.id in BYTES_TYPES)})
    if isinstance(scope, _COMPREHENSIONS):
        stack: list[ast.AST] = [g.target for g in scope.generators]
    elif isinstance(scope, _FUNCTIONS):
        a = scope.args
        for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg):
            if x:
                bind(x.arg, x.annotation)
        stack = list(scope.body) if isinstance(scope.body, list) else [scope.body]
    else:
        stack = list(scope.body)
    while stack:
        n = stack.pop()
        match n:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                bind(n.name)
                continue
            case ast.Lambda() | ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp():
                continue
            case ast.Name(ctx=ast.Store()):
                bind(n.id)
            case ast.AnnAssign(target=ast.Name()):
                bind(n.target.id, n.annotation)
            case ast.alias():
                bind(n.asname or n.name.split(".")[0])
            case ast.ExceptHandler(name=str()) | ast.MatchAs(name=str()) | ast.MatchStar(name=str()):
                bind(n.name)
            case ast.Global() | ast.Nonlocal():
                shared.update(n.names)
        stack += ast.iter_child_nodes(n)
    return {name: kind for name, kind in out.items() if name not in shared}


def _inside(node: ast.AST, chain: _Chain) -> list[tuple[ast.AST, _Chain]]:
    """The children of a node with the scopes around each: a function does not see the names of a class around it."""
    outer = tuple(s for s in chain if not s[0])
    if isinstance(node, _COMPREHENSIONS):
        own = (*outer, (False, _bound(node)))
        return [(child, own) for child in ast.iter_child_nodes(node)]
    if isinstance(node, _FUNCTIONS):
        own, body = (*outer, (False, _bound(node))), node.body if isinstance(node.body, list) else [node.body]
    elif isinstance(node, ast.ClassDef):
        own, body = (*outer, (True, _bound(node))), node.body
    else:
        return [(child, chain) for child in ast.iter_child_nodes(node)]
    mine = set(map(id, body))
    return [(child, own if id(child) in mine else chain) for child in ast.iter_child_nodes(node)]


def misuse_in(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, operator, fix) in one script; null has none. What does not parse is retried by statements, then by lines, then skipped."""
    if not text or "^" not in text:
        return []
    # Form feeds and the like are no ends of lines to the parser, nor are they here.
    source, back, lines = _python(text.replace("\r", " ").replace("\f", " "))
    trees = _trees(source, lines)
    known: dict[str, bool] = {}
    for tree, _, _ in trees:
        for name, kind in _bound(tree).items():
            known[name] = known.get(name, False) or kind
    out: set[tuple[int, int, str, str]] = set()
    for tree, part, base in trees:
        place = _Place(part)
        stack: list[tuple[ast.AST, bool, _Chain]] = [(tree, False, ((False, known),))]
        while stack:
            node, inside, chain = stack.pop()
            if isinstance(node, ast.stmt):
                inside = False
            spots, lexeme = range(0), "^"
            if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow) and (inside or _bytes_like(node.left, place, chain) or _bytes_like(node.right, place, chain)):
                spots = place.between(node.left, node.right)
            elif isinstance(node, ast.AugAssign) and isinstance(node.op, ast.Pow) and (_bytes_like(node.target, place, chain) or _bytes_like(node.value, place, chain)):
                spots, lexeme = place.between(node.target, node.value), "^="
            for i in spots:
                if (found := back.get(base + i)) and found[1] == lexeme:
                    out.add((found[0], found[0] + len(lexeme), lexeme, "^" + lexeme))
            for child, around in _inside(node, chain):
                call = isinstance(node, ast.Call) and child is not node.func
                stack.append((child, isinstance(node.func, ast.Name) and node.func.id == "bytes" if call else inside, around))
    return sorted(out)


def misuse(files: DataFrame) -> DataFrame:
    """T4: (file_id, start, end, lexeme, fix, level) by parsing; only scripts with a caret reach Python, in Arrow batches."""
    rows = scripts(files).where(F.col("text").contains("^")).select("file_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in misuse_in(t)]
            c = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string())], names=["file_id", "start", "end", "lexeme", "fix"])

    return rows.mapInArrow(run, "file_id long, start int, end int, lexeme string, fix string").withColumn("level", F.lit("ERROR"))


def _blocks(source: str, lines: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The logical lines of each top-level statement."""
    blocks: list[list[tuple[int, int]]] = []
    for a, b in lines:
        text = source[a:b]
        if blocks and (not text.strip() or text[0] in " \t#" or _HEADER.match(text)):
            blocks[-1].append((a, b))
        else:
            blocks.append([(a, b)])
    return blocks


def errors_in(text: str | None, dialect: bool = True) -> list[tuple[int, str]]:
    """(line_no, message) of one script; the parser goes on behind each top-level statement that has an error."""
    if not text:
        return []
    text = text.replace("\r", " ").replace("\f", " ")
    # Other files are not translated, only cut into their lines.
    translated, _, lines = _python(text)
    source = translated if dialect else text
    if _parsed(source):
        return []
    if not dialect:
        lines, ends = [], [*(i + 1 for i, c in enumerate(text) if c == "\n"), len(text)]
        lines = list(zip([0, *ends[:-1]], ends, strict=True))
    out = []
    for block in _blocks(source, lines):
        a, b = block[0][0], block[-1][1]
        try:
            ast.parse(source[a:b])
        except SyntaxError as e:
            out.append((source.count("\n", 0, a) + max(1, e.lineno or 1) - 1, e.msg))
        except (ValueError, RecursionError, MemoryError) as e:
            out.append((source.count("\n", 0, a), str(e)))
    return out


def script_errors(files: DataFrame) -> DataFrame:
    """(file_id, line_no, message): the syntax errors of scripts and of other files, in Arrow batches; `statements.visible_errors` filters them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *e) for i, ext, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in errors_in(t, ext == "sage")]
            c = list(zip(*found, strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string())], names=["file_id", "line_no", "message"])

    return files.select("file_id", "ext", "text").mapInArrow(run, "file_id long, line_no int, message string")


__all__ = ["apply_fixes", "bytes_literal", "errors_in", "literal_misuse", "misuse", "misuse_in", "script_errors", "tokens"]
