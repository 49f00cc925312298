"""Expressions that end at a caret, read from the text, and postfix templates applied to them.

A request is a text and a caret behind `expression.key`. The key and its operator are taken out, and windows over the
tokens of the caret's bracket, from the caret leftwards, find the operators on the right edge of the expression tree: those that no
looser operator follows. Every nested expression that ends at the caret starts behind one of them, or at a unary one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import settled
from .lex import raw_type
from .syntax import AUGMENTED, KEYWORDS, code_tokens
from .templates import expand

#: Binary operators of the dialect, the loosest first; `^` is a power, `^^` an exclusive or. Those of RIGHT group to the right.
BINARY = (
    ("else",),
    ("or",),
    ("and",),
    (),  # not
    ("in", "is", "<", ">", "<=", ">=", "==", "!="),
    ("|",),
    ("^^",),
    ("&",),
    ("<<", ">>"),
    ("+", "-"),
    ("*", "/", "//", "%", "@", "\\"),
    (),  # the signs
    ("^", "**"),
)
ELSE, NOT, COMPARE, SIGN, POWER, AWAIT = 1, 4, 5, 12, 13, 14
RIGHT = (ELSE, POWER)
CONSTANTS = ("None", "True", "False")
#: Keywords that stand within expressions.
INNER = ("and", "or", "not", "in", "is", "if", "else", "lambda", "await", *CONSTANTS)
_TIGHTEST = 99


def requested(requests: DataFrame) -> DataFrame:
    """(file_id, ext, path, key, at, text, rest): requests (file_id, ext, text, caret) whose caret stands behind an operator and a key.

    at: where the expression ends; text: the text without the operator and the key; rest: what follows the caret. Other requests give no row.
    """
    rows = requests.withColumn("key", F.regexp_extract(F.expr("left(text, caret)"), r"[.!]([A-Za-z_]\w*)\z", 1)).where("key <> ''")
    rows = rows.withColumns({"at": (F.col("caret") - F.length("key") - 1).cast("int"), "rest": F.expr("substring(text, caret + 1)")})
    return rows.select("file_id", "ext", F.lit("").alias("path"), "key", "at", F.concat(F.expr("left(text, at)"), "rest").alias("text"), "rest")


def _tokens(wanted: DataFrame) -> DataFrame:
    """The tokens before each caret in its logical line and bracket: those of the bracket itself at `below` 0, those nested in it deeper."""
    t = code_tokens(wanted).join(wanted.select("file_id", "at"), "file_id")
    order = Window.partitionBy("file_id", "line").orderBy("start")
    t = t.withColumns({"prev": F.lag("lexeme").over(order), "next": F.lead("lexeme").over(order), "word": F.first("lexeme").over(order)})
    # The caret's line is that of the token which ends there; without one there is no expression.
    t = t.withColumn("line_at", F.max(F.when(F.col("start") + F.length("lexeme") == F.col("at"), F.col("line"))).over(Window.partitionBy("file_id")))
    t = t.where("start < at AND line = line_at")
    back = Window.partitionBy("file_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    # Brackets that open to the left of the caret and are not closed before it: the first of them bounds the expression.
    t = t.withColumn("sum", F.sum("step").over(back))
    t = t.withColumn("opened", F.coalesce(F.max("sum").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.where("opened <= 0").withColumn("opener", F.col("sum") > 0)
    # How many brackets are around a token, from the caret on: a bracket itself counts as outside of it.
    return t.withColumn("below", F.when(F.col("opener"), F.lit(0)).otherwise(-F.col("sum") - F.when(F.col("step") == -1, 1).otherwise(0)))


def _operand_end(x: Column) -> Column:
    return x.isin(")", "]", "}", *CONSTANTS) | (x.rlike(r"^[\p{L}\p{N}_]|[\"']$") & ~x.isin(*KEYWORDS))


def _operators(t: DataFrame) -> DataFrame:
    """The tokens of the bracket itself, with what each is: `stop` (an expression ends before it), `level` (of an operator), `unary`."""
    x, prev, next_ = F.col("lexeme"), F.col("prev"), F.col("next")
    t = t.where("below = 0")
    right = Window.partitionBy("file_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    mark = lambda *kinds: F.when(x.isin(*kinds), x)
    t = t.withColumns(
        {
            "after": F.coalesce(_operand_end(prev), F.lit(False)),
            "owed": F.coalesce(F.sum(F.when(x == "else", 1).when((x == "if"), -1).otherwise(0)).over(right), F.lit(0)),
            "colon": F.first(mark("lambda", ":"), ignorenulls=True).over(Window.partitionBy("file_id").orderBy("start").rowsBetween(1, Window.unboundedFollowing)),
            "lambda": F.last(mark("lambda", ":"), ignorenulls=True).over(left) == "lambda",
            "loop": F.last(mark("for", "in"), ignorenulls=True).over(left) == "for",
        }
    )
    own = F.coalesce(F.col("lambda"), F.lit(False))
    in_loop = F.coalesce(F.col("loop"), F.lit(False))
    level = F.lit(None).cast("int")
    for i, group in enumerate(BINARY):
        level = F.when(x.isin(*group), F.lit(i + 1)).otherwise(level) if group else level
    level = F.when(x.rlike(r"^\^{2,}$"), F.lit(7)).otherwise(level)
    unary = x.isin("+", "-", "~") & ~F.col("after") | (x == "not") & ~F.coalesce(prev == "is", F.lit(False)) & ~F.coalesce(next_ == "in", F.lit(False)) | (x == "await") | (x == "lambda")
    skipped = (own & F.coalesce(F.col("colon") == ":", F.lit(False)) & (x != ":") & (x != "lambda")) | ((x == "if") & (F.col("owed") > 0) & F.col("after")) | ((x == "is") & (next_ == "not")) | ((x == "not") & (next_ == "in"))
    stop = (
        F.when(F.col("opener"), True)
        .when(skipped, False)
        .when(x == "lambda", F.coalesce(F.col("colon") != ":", F.lit(True)))
        .when(x == ":", ~own)
        .when(x == "in", in_loop)
        .when(x.isin("if", "else"), ~F.col("after") | (x == "if"))
        .when(x.isin(",", ";", "=", ":=", "->", "?", "!", "$", "`", *AUGMENTED), True)
        .when(x == ".", ~F.coalesce(next_.rlike(r"^[\p{L}_]"), F.lit(False)))
        .when(x.isin(*(k for k in KEYWORDS if k not in INNER)), True)
        .otherwise(level.isNotNull() & ~unary & ~F.col("after") & ~((x == "not") | (x == "in") & (prev == "not")))
    )
    level = (
        F.when(stop | skipped, None)
        .when(x == "lambda", F.lit(0))
        .when((x == ":") & own, F.lit(0))
        .when(x == "await", F.lit(AWAIT))
        .when(x == "not", F.when(prev == "is", F.lit(COMPARE)).otherwise(F.lit(NOT)))
        .when(unary, F.lit(SIGN))
        .otherwise(level)
    )
    return t.withColumns({"stop": stop, "level": level, "unary": unary | ((x == ":") & own)}).select("file_id", "start", "lexeme", "prev", "next", "word", "stop", "level", "unary", "opener")


def expressions_at(requests: DataFrame) -> DataFrame:
    """(file_id, key, start, end, rank, topmost, expr, kind) of the nested expressions that end where the key's operator stands, from the inside out.

    requests: (file_id, ext, text, caret), one row for each file_id; only scripts have expressions. topmost marks the outermost. kind is
    string, list, dict, set, tuple or None of a literal, else null. Tuples without brackets, named expressions (`:=`) and names that an import, a definition
    or a declaration binds are no expressions; a lambda in the default of a lambda ends the search. Null texts and carets outside the text give no rows.
    """
    wanted = requested(requests)
    t = settled(_tokens(wanted))  # three steps read the few tokens that are left
    spine = _operators(t)
    right = Window.partitionBy("file_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    spine = spine.withColumn("stopped", F.coalesce(F.max(F.col("stop").cast("int")).over(right), F.lit(0)) == 1).where("NOT stopped")
    binary = F.when(~F.col("unary"), F.col("level"))
    spine = spine.withColumn("looser", F.coalesce(F.min(binary).over(right), F.lit(_TIGHTEST)))
    on_edge = (F.col("level") < F.col("looser")) | ((F.col("level") == F.col("looser")) & (F.col("level").isin(*RIGHT) | F.col("unary")))
    order = Window.partitionBy("file_id").orderBy("start")
    spine = spine.withColumns({"behind": F.lead("start").over(order), "first": F.row_number().over(order) == 1, "last": F.row_number().over(order.orderBy(F.desc("start"))) == 1})
    ends = F.col("last") & ~_operand_end(F.col("lexeme"))
    # What a statement binds, or takes from a module, is no expression.
    bound = F.col("stop") & (F.col("lexeme").isin("def", "class", "as", "import", "from", "global", "nonlocal", "del") | (F.col("lexeme") == ".") | ((F.col("lexeme") == "<") & (F.col("prev") == ".")))
    taken = F.col("word").isin("import", "from", "global", "nonlocal")
    spine = spine.withColumn("none", F.max((ends | bound | taken).cast("int")).over(Window.partitionBy("file_id")) == 1).where("NOT none")
    begins = F.array_compact(F.array(F.when(F.col("first") & ~F.col("stop"), F.col("start")), F.when(F.col("stop") | (on_edge & (F.col("lexeme") != "lambda")), F.col("behind")), F.when(on_edge & F.col("unary") & (F.col("lexeme") != ":"), F.col("start"))))
    starts = spine.select("file_id", F.explode(begins).alias("start")).distinct()
    outward, inward = Window.partitionBy("file_id").orderBy(F.desc("start")), Window.partitionBy("file_id").orderBy("start")
    starts = starts.withColumns({"rank": F.row_number().over(outward), "topmost": F.row_number().over(inward) == 1})
    rows = starts.join(_kinds(t, starts), ["file_id", "rank"], "left").join(wanted, "file_id")
    return rows.select("file_id", "key", F.col("start").cast("int").alias("start"), F.col("at").alias("end"), "rank", "topmost", F.expr("substring(text, start + 1, at - start)").alias("expr"), "kind")


def _kinds(t: DataFrame, starts: DataFrame) -> DataFrame:
    """(file_id, rank, kind) of the innermost expressions that are literals."""
    inner = starts.where("rank = 1").select("file_id", F.col("start").alias("begin"))
    t = t.join(inner, "file_id").where("start >= begin")
    x, top, nested = F.col("lexeme"), F.col("below") == 0, F.col("below") == 1
    has = lambda what: F.max((nested & what).cast("int")) == 1
    facts = t.groupBy("file_id").agg(
        F.min_by("lexeme", "start").alias("head"),
        F.count_if(top).alias("n"),
        F.count("*").alias("tokens"),
        F.min((raw_type(x) == "STRING").cast("int")).alias("quoted"),
        has((x == ":") | (x == "**") & F.col("prev").isin("{", ",")).alias("pairs"),
        has(x == ",").alias("commas"),
        has(x == "for").alias("loop"),
    )
    head, bracket = F.col("head"), F.col("n") == 2
    kind = (
        F.when(F.col("quoted") == 1, "string")
        .when((F.col("n") == 1) & (head == "None"), "None")
        .when(bracket & (head == "["), "list")
        .when(bracket & (head == "{"), F.when(F.col("pairs") | (F.col("tokens") == 2), "dict").otherwise("set"))
        .when(bracket & (head == "(") & ~F.col("loop") & (F.col("commas") | (F.col("tokens") == 2)), "tuple")
    )
    return facts.select("file_id", F.lit(1).alias("rank"), kind.alias("kind"))


def expand_at(requests: DataFrame, templates: DataFrame, bases: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """(file_id, key, start, expanded, text, caret): what each request's template makes of the expressions at its caret.

    One row for each expression that the template fits; a topmost template is asked for the outermost one only, and not applied if
    that does not fit. text and caret are those of the whole script afterwards. The type of an expression is its literal kind, or that
    of the name in `types` (file_id, target, class_name); `bases` as in `templates.expand`. Keys that no template has give no rows.
    """
    found = expressions_at(requests).withColumn("type", F.col("kind"))
    if types is not None:
        named = types.groupBy("file_id", F.col("target").alias("expr")).agg(F.min("class_name").alias("named"))
        found = found.join(named, ["file_id", "expr"], "left").withColumn("type", F.coalesce("kind", "named"))
    # A key may have templates of both sorts, so the sort is part of what is joined on; rows of a request are told apart by their start.
    sort = F.struct("key", F.col("outermost").alias("topmost")).alias("key")
    asked = found.join(templates.select("key", F.col("topmost").alias("outermost")).distinct(), "key").where("topmost OR NOT outermost")
    asked = asked.select(F.struct("file_id", "start").alias("file_id"), F.lit("sage").alias("ext"), "expr", sort, F.col("type").alias("expr_type"))
    filled = expand(asked, templates.withColumn("key", F.struct("key", "topmost")), bases)
    made = filled.select(F.col("file_id.file_id").alias("file_id"), F.col("key.key").alias("key"), F.col("file_id.start").alias("start"), "expanded", F.col("caret").alias("within"))
    rows = made.join(requested(requests).drop("key"), "file_id")
    return rows.select("file_id", "key", "start", "expanded", F.concat(F.expr("left(text, start)"), "expanded", "rest").alias("text"), (F.col("start") + F.col("within")).cast("int").alias("caret"))
