"""Tokens of a script with the dialect's caret rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r"""[rRbBuUfF]*(?:\"{3}(?:[^\"\\]|\\[\s\S]|\"{1,2}(?!\"))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'{1,2}(?!'))*+'{3}|\"[^\"\\\n]*+(?:\\[\s\S][^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+')"""
#: One alternation covers every character, so the lexemes of a text joined are the text.
LEX = _STRING + r"""|#[^\n]*+|\^++=?|[\p{L}_][\p{L}\p{N}_]*+|\d[\d_]*+(?:\.\d*+)?(?:[eE][+-]?\d++)?|[ \t\r\f]++|\n|[\s\S]"""


def raw_type(x: Column) -> Column:
    return (
        F.when(x.rlike("^#"), "COMMENT")
        .when(x.rlike(r"^[rRbBuUfF]*[\"'][\s\S]*[\"']$"), "STRING")
        .when(x.startswith("^"), "CARET")
        .when(x == "\n", "NEWLINE")
        .when(x.rlike(r"^\s"), "SPACE")
        .when(x.rlike(r"^[\p{L}_]"), "NAME")
        .when(x.rlike(r"^\d"), "NUMBER")
        .otherwise("OP")
    )


def _caret_pieces(x: Column) -> Column:
    """M1: a caret run as (lexeme, type, offset within the run); three or more carets before "=" are two tokens."""
    n = F.length(F.regexp_replace(x, "=", ""))
    piece = lambda text, kind, at: F.struct(text.alias("lexeme"), F.lit(kind).alias("type"), at.cast("int").alias("shift"))
    zero = F.lit(0)
    return (
        F.when(~x.endswith("=") & (n == 1), F.array(piece(x, "EXP", zero)))
        .when(~x.endswith("="), F.array(piece(x, "XOR", zero)))
        .when(n == 1, F.array(piece(x, "EXPEQ", zero)))
        .when(n == 2, F.array(piece(x, "XOREQ", zero)))
        .otherwise(F.array(piece(F.left(x, n - 1), "XOR", zero), piece(F.lit("^="), "EXPEQ", n - 1)))
    )


#: Lexemes in a block of `lexemes`.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once; a plain column may be computed anew for every element of a lambda that reads it."""
    return F.transform(F.array(value), body)[0]


def _blocks(found: Column) -> Column:
    last = F.floor((F.size(found) - 1) / _BLOCK).cast("int")
    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(found, b * _BLOCK + 1, _BLOCK)))


def _placed(blocks: Column) -> Column:
    start = lambda kind: F.array().cast(f"array<{kind}>").alias("out")
    sizes = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + F.length(y)))
    before = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), start("int")), lambda a, n: F.struct((a.at + n).alias("at"), F.array_append(a.out, a.at).alias("out")))["out"]
    one = lambda block, at: F.aggregate(
        block,
        F.struct(at.alias("at"), start("struct<lexeme:string,start:int>")),
        lambda a, x: F.struct((a.at + F.length(x)).alias("at"), F.array_append(a.out, F.struct(x.alias("lexeme"), a.at.alias("start"))).alias("out")),
    )["out"]
    return F.flatten(F.zip_with(blocks, before, one))


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """What a fold of an int array holds after each element; step must be associative and start change nothing.

    Like offsets, it is found in blocks, so that a long array is not copied at every step.
    """
    empty = F.array().cast("array<int>").alias("out")

    def held(blocks: Column) -> Column:
        wholes = F.transform(blocks, lambda x: F.aggregate(x, start, step))
        before = F.aggregate(wholes, F.struct(start.alias("at"), empty), lambda a, x: F.struct(step(a.at, x).alias("at"), F.array_append(a.out, a.at).alias("out")))["out"]
        one = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty), lambda a, x: F.struct(step(a.at, x).alias("at"), F.array_append(a.out, step(a.at, x)).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, before, one))

    return let(values, lambda v: F.coalesce(let(_blocks(v), held), empty))


def lexemes(text: Column, pattern: str = LEX) -> Column:
    """Array of (lexeme, start): offsets are code points; built row by row, without a shuffle.

    A fold copies its array at every step, so offsets are summed in blocks: first of blocks, then inside each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = let(found, lambda f: let(_blocks(f), _placed))
    return F.when(text.isNotNull(), F.coalesce(placed, F.array().cast("array<struct<lexeme:string,start:int>>")))


def tokens(files: DataFrame) -> DataFrame:
    """(file_id, ord, start, end, lexeme, type), white space included; null text has no tokens."""
    rows = files.select("file_id", F.posexplode(lexemes(F.col("text"))).alias("ord", "t"))
    rows = rows.select("file_id", "ord", "t.start", "t.lexeme", raw_type(F.col("t.lexeme")).alias("raw"))
    one = F.array(F.struct("lexeme", F.col("raw").alias("type"), F.lit(0).alias("shift")))
    rows = rows.select("file_id", "ord", "start", F.explode(F.when(F.col("raw") == "CARET", _caret_pieces(F.col("lexeme"))).otherwise(one)).alias("p"))
    start = F.col("start") + F.col("p.shift")
    return rows.select("file_id", "ord", start.alias("start"), (start + F.length("p.lexeme")).alias("end"), F.col("p.lexeme").alias("lexeme"), F.col("p.type").alias("type"))


def caret_tokens(files: DataFrame) -> DataFrame:
    """The caret tokens; files without a caret never reach the lexer."""
    return tokens(files.where(F.col("text").contains("^"))).where(F.col("type").isin("EXP", "XOR", "EXPEQ", "XOREQ"))
