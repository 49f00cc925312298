"""Names in scripts, what they are to their statement, and the scopes that bind them.

Scripts become rows of tokens. Windows over a file's tokens in order give brackets, logical lines, statements and the
neighbours of each token, and so its role. A scope is the suite of a function or class, the brackets of a comprehension
or what follows a lambda; each line knows the suites around it. A reference meets the bindings of its name
in the scopes around it, never all bindings of a file. Several steps read the result of `names`: settle it first (`catalog.settled`). Everything is partitioned by file, and a file's rows stream through its windows.

Both sides of the joins grow with the corpus, and Spark's estimates know nothing of the tokens that a text is exploded into: the
hints keep it from collecting a side on the driver.
"""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lex import _STRING, lexemes
from .statements import implicit_files, scripts

#: Like `lex.LEX`, but operators of several characters are one token, and so is a line end after a backslash.
CODE = _STRING + r"""|#[^\n]*+|\\\n|\^++=?|\*\*=?|//=?|>>=?|<<=?|:=|->|\.\.\.|[-+*/%&|@<>=!]=|[\p{L}_][\p{L}\p{N}_]*+|\d[\d_]*+(?:\.\d*+)?(?:[eE][+-]?\d++)?|[ \t\r\f]++|\n|[\s\S]"""
#: Names that every script has.
BUILTINS = tuple(x for x in dir(builtins) if not x.startswith("_"))
KEYWORDS = tuple(keyword.kwlist)
AUGMENTED = ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", ">>=", "<<=", "**=", "^=", "^^=")
#: Words whose statements have a suite after a colon.
COMPOUND = ("if", "elif", "else", "for", "while", "def", "class", "with", "try", "except", "finally", "match", "case")
#: Roles of names that bind; a name in an import binds if it is the one that the file sees.
BINDING = ("generator", "function", "class", "parameter", "lambda", "loop", "as", "walrus", "target", "import")
MODULE = -1


def code_tokens(files: DataFrame) -> DataFrame:
    """(file_id, start, lexeme, name, line, line_no, indent) of scripts less spaces and comments; line: the logical one, indent: of its first token."""
    # Texts are dealt out by file, not their tokens, which are many times as large; the windows and joins by file find them so.
    texts = scripts(files).where("text IS NOT NULL").select("file_id", "text").repartition("file_id")
    t = texts.select("file_id", F.explode(lexemes(F.col("text"), CODE)).alias("t")).select("file_id", "t.start", "t.lexeme")
    x = F.col("lexeme")
    t = t.where(~x.rlike(r"^(?:#|[ \t\r\f])"))
    t = t.withColumn("step", F.when(x.isin("(", "[", "{"), 1).when(x.isin(")", "]", "}"), -1).otherwise(0))
    order = Window.partitionBy("file_id").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("sum", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Brackets that nothing closes hold no lines together: what counts is the sum less the least one that follows.
    after = Window.partitionBy("file_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("open", F.col("sum") - F.min("sum").over(after))
    ends = (x == "\n") & (F.col("open") == 0)
    newlines = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    t = t.withColumns(
        {
            "line": F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)),
            "line_no": F.coalesce(F.sum(newlines).over(before), F.lit(0)).cast("int"),
            "indent": F.col("start") - F.coalesce(F.max(F.when(x == "\n", F.col("start") + 1)).over(before), F.lit(0)),
        }
    )
    return t.where(~x.isin("\n", "\\\n")).select("file_id", "start", "lexeme", "step", (x.rlike(r"^[\p{L}_]") & ~x.rlike("[\"']$") & ~x.isin(*KEYWORDS)).alias("name"), "line", "line_no", "indent")


def _placed(files: DataFrame) -> DataFrame:
    """Tokens with their place in line and statement."""
    line = Window.partitionBy("file_id", "line").orderBy("start")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    x, step = F.col("lexeme"), F.col("step")
    t = code_tokens(files)
    t = t.withColumns({"idx": F.row_number().over(line) - 1, "prev": F.lag(x).over(line), "next": F.lead(x).over(line), "next_at": F.lead("start").over(line), "depth": F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, 0))})
    # outer: brackets around the token; inner: those around what it opens or closes, else the same.
    t = t.withColumns({"outer": F.col("depth") - F.when(step == 1, 1).otherwise(0), "inner": F.col("depth") + F.when(step == -1, 1).otherwise(0)})
    whole = Window.partitionBy("file_id", "line")
    # An async statement is what its second word says.
    word = F.first(F.when(x == "async", F.col("next")).otherwise(x)).over(line)
    t = t.withColumns({"stmt": word, "line_indent": F.first("indent").over(line), "line_start": F.first("start").over(line), "end": F.max("start").over(whole)})
    suite = F.sum(((x == ":") & (F.col("outer") == 0) & F.col("stmt").isin(*COMPOUND)).cast("int")).over(before)
    t = t.withColumn("suite", F.least(F.coalesce(suite, F.lit(0)), F.lit(1)))
    t = t.withColumn("piece", F.coalesce(F.sum(((x == ";") & (F.col("outer") == 0)).cast("int")).over(before), F.lit(0)) + F.col("suite"))
    # A bracket's tokens lie at one depth, after the last that opened there.
    bracket = Window.partitionBy("file_id", "line", "inner").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("bracket", F.when(F.col("inner") > 0, F.last(F.when(step == 1, F.col("start")), ignorenulls=True).over(bracket)))
    last_at = F.max("start").over(Window.partitionBy("file_id", "line", "inner", "bracket"))
    return t.withColumn("bracket_end", F.when(F.col("bracket").isNotNull(), last_at).otherwise(F.col("end")))


def _roles(files: DataFrame) -> DataFrame:
    """The names among the tokens, with their roles."""
    t = _placed(files)
    x, prev, next_, idx, outer = (F.col(c) for c in ("lexeme", "prev", "next", "idx", "outer"))
    line = Window.partitionBy("file_id", "line").orderBy("start")
    before, whole = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file_id", "line")
    piece = Window.partitionBy("file_id", "line", "piece")
    piece_before = piece.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda what, value: F.last(F.when(what, value), ignorenulls=True).over(before)
    any_ = lambda what, w: F.coalesce(F.max(what.cast("int")).over(w), F.lit(0)) == 1
    t = t.withColumns(
        {
            "first": F.first(x).over(piece.orderBy("start")),
            "first_idx": F.min("idx").over(piece),
            "eq": F.max(F.when((x == "=") & (outer == 0), idx)).over(piece),
            "imported": any_(x == "import", piece_before),
            "arrow": any_(x == "->", before),
            "for_at": last(x == "for", idx),
            "in_at": last(x == "in", idx),
            "for_depth": last(x == "for", outer),
            "lambda_at": last(x == "lambda", idx),
            "lambda_start": last(x == "lambda", F.col("start")),
            "colon_at": last(x == ":", idx),
            "dotted": any_((idx == 1) & (x == "."), whole) & any_((idx == 2) & (x == "<"), whole) & (F.col("line_indent") == 0),
            "ends_at": F.min(F.when((x == ">") & (next_ == "="), idx)).over(whole),
            "typed": F.when(next_ == ":", F.lead(x, 2).over(line)),
            "after_type": F.lead(x, 3).over(line),
        }
    )
    in_import = F.col("first").isin("import", "from")
    listed = prev.isin("(", ",", "*", "**")
    in_loop = F.col("for_at").isNotNull() & (F.col("in_at").isNull() | (F.col("in_at") < F.col("for_at")))
    in_lambda = F.col("lambda_at").isNotNull() & (F.col("colon_at").isNull() | (F.col("colon_at") < F.col("lambda_at")))
    begins = (idx == F.col("first_idx")) | prev.isin(",", "=", "*")
    role = (
        F.when(F.col("dotted") & (idx < F.col("ends_at")), "generator")
        .when(prev == ".", "attribute")
        .when(in_import, F.when((prev == "as") | ((F.col("imported") | (prev == "import")) & (next_.isNull() | (next_ != "as")) & (F.coalesce(prev, F.lit("")) != ".")), "import").otherwise("source"))
        .when(prev == "def", "function")
        .when(prev == "class", "class")
        .when((F.col("stmt") == "def") & (F.col("suite") == 0) & (F.col("inner") == 1) & ~F.col("arrow") & listed, "parameter")
        .when(in_lambda & (listed | (prev == "lambda")), "lambda")
        .when(in_loop, "loop")
        .when(prev == "as", "as")
        .when(next_ == ":=", "walrus")
        .when(F.col("first").isin("global", "nonlocal"), F.col("first"))
        .when((next_ == "=") & (outer > 0) & prev.isin("(", ","), "keyword")
        .when((outer == 0) & next_.isin(*AUGMENTED), "target")
        .when((outer == 0) & (idx == F.col("first_idx")) & (next_ == ":"), "target")
        .when((outer == 0) & (idx < F.col("eq")) & begins & next_.isin(",", "="), "target")
        .otherwise("reference")
    )
    t = t.withColumn("role", role).withColumn("in_import", in_import).where("name")
    # The annotation is one name; anything else is no name.
    plain = F.col("after_type").isNull() | F.col("after_type").isin(",", ")", "=", ";")
    return t.withColumn("annotation", F.when(F.col("role").isin("parameter", "target") & plain & F.col("typed").rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.col("typed")))


def _suites(files: DataFrame) -> DataFrame:
    """(file_id, line, suites): the function and class lines around each logical line, (indent, start, kind) from outside in.

    A line lies in the suite of a line at a smaller indent if that is the last one before it at no greater indent. Lines are copied for
    each indent that the file has functions or classes at, as many as they are nested.
    """
    t = _placed(files).where("idx = 0").select("file_id", "line", "line_indent", F.col("line_start").alias("at"), "stmt")
    kind = F.when(F.col("stmt").isin("def", "class"), F.col("stmt"))
    t = t.withColumn("kind", kind).withColumn("levels", F.collect_set(F.when(kind.isNotNull(), F.col("line_indent"))).over(Window.partitionBy("file_id")))
    t = t.withColumn("level", F.explode("levels"))
    before = Window.partitionBy("file_id", "level").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.last(F.when(F.col("line_indent") <= F.col("level"), F.struct(F.col("line_indent").alias("indent"), F.col("at"), F.col("kind"))), ignorenulls=True).over(before)
    t = t.withColumn("o", opener).where("line_indent > level AND o.indent = level AND o.kind IS NOT NULL")
    return t.groupBy("file_id", "line").agg(F.array_sort(F.collect_list("o")).alias("suites"))


def names(files: DataFrame) -> DataFrame:
    """(file_id, line, piece, line_no, start, name, role, annotation, in_import, next_char, scopes, begin, end) of every name in the scripts.

    line: the logical line; piece: the statement in it.
    scopes: the module (-1) and the functions and classes around, by the offsets of their lines, from outside in; a
    class around a function is left out, for names in the function do not see it. begin, end: where a name of a lambda or comprehension holds.
    """
    t = _roles(files).join(_suites(files).hint("merge"), ["file_id", "line"], "left")
    own = F.struct(F.col("line_indent").alias("indent"), F.col("line_start").alias("at"), F.col("stmt").alias("kind"))
    inside = F.col("stmt").isin("def", "class") & ((F.col("suite") == 1) | (F.col("role") == "parameter"))
    around = F.concat(F.coalesce("suites", F.array().cast("array<struct<indent:int,at:int,kind:string>>")), F.when(inside, F.array(own)).otherwise(F.array().cast("array<struct<indent:int,at:int,kind:string>>")))
    seen = F.filter(around, lambda s, i: (s["kind"] == "def") | (i == F.size(around) - 1))
    scopes = F.concat(F.array(F.lit(MODULE)), F.transform(seen, lambda s: s["at"]))
    local = (F.col("role") == "lambda") | ((F.col("role") == "loop") & (F.col("for_depth") > 0))
    begin = F.when(F.col("role") == "lambda", F.col("lambda_start")).when(local, F.col("bracket"))
    next_char = F.when(F.col("next_at") == F.col("start") + F.length("lexeme"), F.left("next", F.lit(1))).otherwise("")
    return t.select("file_id", "line", "piece", "line_no", "start", F.col("lexeme").alias("name"), "role", "annotation", "in_import", next_char.alias("next_char"), scopes.alias("scopes"), begin.alias("begin"), F.when(local, F.col("bracket_end")).alias("end"))


def references(files: DataFrame) -> DataFrame:
    """(file_id, line_no, start, name, qualified, is_target, in_import, next_char) of every name, read from the text.

    Names of keyword arguments and of global and nonlocal statements refer to nothing and are left out.
    """
    t = names(files).where("role NOT IN ('keyword', 'global', 'nonlocal')")
    return t.select("file_id", "line_no", "start", "name", (F.col("role") == "attribute").alias("qualified"), (F.col("role").isin(*BINDING) & (F.col("role") != "import")).alias("is_target"), "in_import", "next_char")


def bindings(named: DataFrame) -> DataFrame:
    """(file_id, scope, name, annotations): what the module, functions and classes bind; a global name is the module's, a nonlocal one another function's."""
    here = F.element_at("scopes", -1)
    rows = named.where(F.col("role").isin(*BINDING) & F.col("begin").isNull()).select("file_id", here.alias("scope"), "name", "annotation")
    shared = named.where("role IN ('global', 'nonlocal')").groupBy("file_id", here.alias("scope"), "name").agg(F.min("role").alias("moved"))
    rows = rows.join(shared.hint("merge"), ["file_id", "scope", "name"], "left").where("moved IS NULL OR moved = 'global'")
    rows = rows.withColumn("scope", F.when(F.col("moved").isNotNull(), F.lit(MODULE)).otherwise(F.col("scope")))
    return rows.groupBy("file_id", "scope", "name").agg(F.collect_set("annotation").alias("annotations"))


def bound_references(named: DataFrame) -> DataFrame:
    """(file_id, line, piece, line_no, start, name, scope, annotations): each reference with its nearest binding; scope is null where nothing binds it.

    Scopes of comprehensions and lambdas are given by where they begin. Bindings of one scope are one, wherever in it they stand.
    """
    refs = named.where("role = 'reference'").select("file_id", "line", "piece", "line_no", "start", "name", "scopes")
    chain = refs.select("file_id", "start", "name", F.posexplode("scopes").alias("level", "scope")).join(bindings(named).hint("merge"), ["file_id", "scope", "name"])
    suite = chain.groupBy("file_id", "start").agg(F.max_by(F.struct("scope", "annotations"), "level").alias("suite"))
    local = named.where("begin IS NOT NULL").select("file_id", "line", "name", "begin", "end").distinct()
    inner = refs.join(local.hint("merge"), ["file_id", "line", "name"]).where("start BETWEEN begin AND end").groupBy("file_id", "start").agg(F.max("begin").alias("local"))
    rows = refs.join(suite.hint("merge"), ["file_id", "start"], "left").join(inner.hint("merge"), ["file_id", "start"], "left")
    none = F.array().cast("array<string>")
    return rows.select("file_id", "line", "piece", "line_no", "start", "name", F.coalesce("local", "suite.scope").alias("scope"), F.when(F.col("local").isNull(), F.coalesce("suite.annotations", none)).otherwise(none).alias("annotations"))


def open_references(named: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line_no, start, name, own): the references of implicit scripts that neither a scope nor the builtins bind.

    A generator statement's own names are left open inside it and marked, for its right side finds them by another way (J7).
    """
    rows = bound_references(named).where(~F.col("name").isin(*BUILTINS))
    own = named.where("role = 'generator'").select("file_id", "line", "piece", "name").distinct().withColumn("own", F.lit(True))
    rows = rows.join(own.hint("merge"), ["file_id", "line", "piece", "name"], "left").where("scope IS NULL OR own")
    rows = rows.join(implicit_files(files).select("file_id").hint("merge"), "file_id", "left_semi")
    return rows.select("file_id", "line_no", "start", "name", F.coalesce("own", F.lit(False)).alias("own"))


__all__ = ["bindings", "bound_references", "code_tokens", "names", "open_references", "references"]
