"""Generator statements and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lex import LEX, let, raw_type, running

#: A top-level statement `X.<a, b> = rhs`; what follows the "=" may be missing. A ">=" is one token, so it ends no target list.
GENERATOR = r"^([\p{L}_][\p{L}\p{N}_]*)[ \t]*\.[ \t]*<[ \t]*([\p{L}_][\p{L}\p{N}_]*(?:[ \t]*,[ \t]*[\p{L}_][\p{L}\p{N}_]*)*)[ \t]*>[ \t]+=([^=][\s\S]*|)$"
#: The right side is a call, or a subscript of one: its callee.
CALLEE = r"^[ \t]*([\p{L}_][\p{L}\p{N}_.]*)[ \t]*\("
EXPLICIT = r"^\s*from[ \t]+sage[ \t]*\.[ \t]*all[ \t]+import\b"


def _pieces(text: Column, marked: bool) -> Column:
    """The text with the inside of strings and comments blanked; marked: a line end inside a string follows a backslash."""

    def shown(x: Column) -> Column:
        kind = raw_type(x)
        inside = F.regexp_replace(x, r"[^\n\"']", "_")
        inside = F.replace(inside, F.lit("\n"), F.lit("\\\n")) if marked else inside
        return F.when(kind == "COMMENT", F.regexp_replace(x, r"[^\n]", " ")).when(kind == "STRING", inside).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(LEX), F.lit(0)), shown), "")


def code_only(text: Column) -> Column:
    """The text with the inside of strings and comments blanked, so that patterns see code alone; same length."""
    return _pieces(text, False)


def logical_lines(files: DataFrame) -> DataFrame:
    """(file_id, ext, line_no, last_line, line, code): line ends in brackets, in strings and after a backslash end no line.

    A bracket that is never closed holds no lines together. In `code` strings and comments are blanked and inner line
    ends are spaces, so that it is as long as `line`. All is found within each file's own arrays: prefix sums of the
    brackets that its lines open, less the least sum that follows.
    """
    of = lambda x: F.split(x, "\n", -1)
    text = F.col("text")
    count = lambda x, kinds: F.length(F.regexp_replace(x, rf"[^{kinds}]+", ""))
    opened = lambda t: F.transform(t["c"], lambda x: count(x, r"(\[{") - count(x, r")\]}"))
    sums = lambda t: running(opened(t), lambda a, x: a + x, F.lit(0))
    least = lambda s: F.reverse(running(F.reverse(s), lambda a, x: F.least(a, x), F.lit(2**31 - 1)))

    def joined(t: Column, first: Column, last: Column) -> Column:
        part = lambda x: F.array_join(F.slice(x, first + 1, last - first + 1), "\n")
        code = F.replace(F.replace(part(t["c"]), F.lit("\\\n"), F.lit("  ")), F.lit("\n"), F.lit(" "))
        return F.struct(first.alias("line_no"), last.alias("last_line"), part(t["l"]).alias("line"), code.alias("code"))

    def cut(t: Column, s: Column, least: Column) -> Column:
        more = lambda i: (F.get(s, i) > F.get(least, i)) | F.get(t["m"], i).endswith("\\")
        starts = F.filter(F.sequence(F.lit(0), F.size(t["l"]) - 1), lambda i: (i == 0) | ~more(i - 1))
        return let(starts, lambda b: F.transform(b, lambda first, k: joined(t, first, F.coalesce(F.get(b, k + 1), F.size(t["l"])) - 1)))

    # Each step is bound by `let`: a column that a lambda reads would be computed again for every line.
    whole = F.struct(of(text).alias("l"), of(code_only(text)).alias("c"), of(_pieces(text, True)).alias("m"))
    lines = let(whole, lambda t: let(sums(t), lambda s: let(least(s), lambda x: cut(t, s, x))))
    return files.where("text IS NOT NULL").select("file_id", "ext", F.inline(lines))


def scripts(files: DataFrame) -> DataFrame:
    """The gate in front of every dialect rule; the extension is compared as it is."""
    return files.where(F.col("ext") == "sage")


def generator_statements(files: DataFrame) -> DataFrame:
    """(file_id, line_no, last_line, factory_name, names, callee, rhs).

    Only the first statement of an unindented logical line is eligible; a right side may go on over several lines. An unfinished target list gives no row; a
    missing right side gives one without callee.
    """
    gated = scripts(files).where(F.col("text").rlike(r"\.[ \t]*<"))
    rows = logical_lines(gated).where(F.col("code").rlike(GENERATOR))
    part = lambda i: F.regexp_extract("code", GENERATOR, i)
    callee = F.regexp_extract(F.split(part(3), ";", -1)[0], CALLEE, 1)
    names = F.transform(F.split(part(2), ",", -1), F.trim)
    return rows.select(
        "file_id",
        "line_no",
        "last_line",
        part(1).alias("factory_name"),
        names.alias("names"),
        F.when(callee != "", callee).alias("callee"),
        F.trim(F.substr("line", F.length("line") - F.length(part(3)) + 1)).alias("rhs"),
    )


def statement_errors(files: DataFrame) -> DataFrame:
    """(file_id, line_no, message) of generator statements that end after the "="; they stay statements."""
    return generator_statements(files).where("rhs = ''").select("file_id", "line_no", F.lit("expression expected").alias("message"))


def has_explicit_import(code: Column) -> Column:
    return code.rlike(r"(?m)" + EXPLICIT)


def explicit_imports(files: DataFrame) -> DataFrame:
    """Ids of files with the star or named import; comments and strings do not count."""
    return files.where(F.col("text").contains("sage")).where(has_explicit_import(code_only(F.col("text")))).select("file_id").distinct()


def implicit_files(files: DataFrame) -> DataFrame:
    """Scripts whose namespace stays implicit."""
    return scripts(files).join(explicit_imports(files).hint("merge"), "file_id", "left_anti")


def visible_errors(errors: DataFrame, files: DataFrame) -> DataFrame:
    """Errors (file_id, line_no, message) less those inside generator statements of scripts.

    Statements do not overlap, so an error is inside one only if it is inside the last one that begins before it:
    one pass over a file's statements and errors in order, however many there are of either.
    """
    kind = lambda name: F.lit(None).cast(name)
    spans = generator_statements(files).select("file_id", "line_no", "last_line", kind("string").alias("message"))
    rows = spans.unionByName(errors.select("file_id", "line_no", kind("int").alias("last_line"), "message"))
    so_far = Window.partitionBy("file_id").orderBy("line_no", F.col("last_line").isNull())
    end = F.last("last_line", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).where("message IS NOT NULL AND (end IS NULL OR end < line_no)").select("file_id", "line_no", "message")
