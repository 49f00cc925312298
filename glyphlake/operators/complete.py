"""Completion over the implicit namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import callable_names, entry_targets, namespace, settled
from .statements import implicit_files
from .syntax import references

#: Letters of a plain prefix that the index holds.
INDEXED = 3


def humps(name: Column) -> Column:
    """The name in lower case with a bar before each hump: one begins at the start, at a capital after anything else, at a
    capital before a small letter, and after underscores, which are dropped."""
    cut = F.regexp_replace(name, r"(?<=[^\p{Lu}_])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|^(?=[^_])|_+", "|")
    return F.lower(cut)


def _parts(prefix: Column) -> Column:
    """A prefix's own humps; every capital begins one, so that GF may be one hump or two."""
    return F.filter(F.split(F.lower(F.regexp_replace(prefix, r"(?<=.)(?=\p{Lu})|_+", "|")), r"\|", -1), lambda x: x != "")


def prefix_matches(name: Column, prefix: Column) -> Column:
    """The name begins with the prefix, whatever the case, or the prefix's humps begin humps of the name.

    The first hump of a prefix must begin the first of the name; the others follow in order, and humps may be left out: gF
    and getF match getField, fG does not. An empty prefix matches nothing.
    """
    quoted = F.transform(_parts(prefix), lambda x: F.concat(F.lit(r"\|\Q"), x, F.lit(r"\E[^|]*")))
    pattern = F.concat(F.lit("^"), F.array_join(quoted, r"(?:\|[^|]*)*?"))
    by_humps = (F.size(quoted) > 1) & F.regexp_like(humps(name), pattern)
    return (prefix != "") & (F.lower(name).startswith(F.lower(prefix)) | by_humps)


def name_keys(name: Column) -> Column:
    """Index keys of a name: its first letters, and the first letter of its first hump with that of each later one."""
    low = F.lower(name)
    plain = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(INDEXED), F.length(name)))), lambda n: F.concat(F.lit("="), F.left(low, n)))
    first = F.transform(F.filter(F.split(humps(name), r"\|", -1), lambda x: x != ""), lambda x: F.left(x, F.lit(1)))
    pairs = F.transform(F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))), lambda x: F.concat(F.lit("+"), first[0], x))
    return F.array_distinct(F.concat(plain, F.when(F.size(first) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def prefix_keys(prefix: Column) -> Column:
    """The keys to look a prefix up by: one by its letters, and one by its first two humps if it has as many."""
    parts = _parts(prefix)
    plain = F.concat(F.lit("="), F.left(F.lower(prefix), F.lit(INDEXED)))
    pair = F.concat(F.lit("+"), F.left(F.get(parts, F.lit(0)), F.lit(1)), F.left(F.get(parts, F.lit(1)), F.lit(1)))
    return F.array_compact(F.array(plain, F.when(F.size(parts) > 1, pair)))


def matches(prefixes: DataFrame, names: DataFrame) -> DataFrame:
    """(prefix, name): every pair that matches once. Both sides meet by exact keys of an inverted index, then the whole rule decides."""
    wanted = prefixes.select("prefix").where("prefix <> ''").distinct().withColumn("key", F.explode(prefix_keys(F.col("prefix"))))
    index = names.select("name").distinct().withColumn("key", F.explode(name_keys(F.col("name"))))
    return wanted.join(index.hint("merge"), "key").where(prefix_matches(F.col("name"), F.col("prefix"))).select("prefix", "name").distinct()


def insertion(name: Column, is_callable: Column, next_char: Column) -> tuple[Column, Column]:
    """(text to insert, caret from its start): a callable gets brackets with the caret inside, unless one follows."""
    opened = F.coalesce(next_char, F.lit("")) == "("
    text = F.when(is_callable & ~opened, F.concat(name, F.lit("()"))).otherwise(name)
    return text, F.length(name) + F.when(is_callable, 1).otherwise(0)


def entries(symbols: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """All names of the namespace with kind and callability, once per catalog."""
    targets = entry_targets(namespace(symbols), symbols)
    return targets.join(callable_names(targets, symbols, methods, bases).hint("merge"), "name").select("name", F.col("target_kind").alias("kind"), "is_callable")


def positions(files: DataFrame) -> DataFrame:
    """A completion position (file_id, pos, prefix, next_char, qualified, is_target, in_import) at the end of every name in the scripts' text."""
    rows = references(files)
    return rows.select("file_id", (F.col("start") + F.length("name")).alias("pos"), F.col("name").alias("prefix"), "next_char", "qualified", "is_target", "in_import")


def completions(positions: DataFrame, files: DataFrame, symbols: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """Positions (file_id, pos, prefix, next_char, qualified, is_target, in_import) to their entries.

    Gates first: unqualified, no target, not in an import (P8), implicit namespace (P1), a prefix (P9). Each prefix is
    looked up once, however many positions have it.
    """
    # Read twice, for the prefixes and for the result, so the names of the text are found once.
    open_ = positions.where("NOT qualified AND NOT is_target AND NOT in_import AND prefix <> ''").join(implicit_files(files).select("file_id").hint("merge"), "file_id", "left_semi")
    open_ = settled(open_)
    names = entries(symbols, methods, bases)
    rows = open_.join(matches(open_, names).hint("merge"), "prefix").join(names.hint("merge"), "name")
    text, caret = insertion(F.col("name"), F.col("is_callable"), F.col("next_char"))
    return rows.select("file_id", "pos", "name", "kind", F.lit("sage.all").alias("type_text"), "is_callable", text.alias("insert_text"), caret.cast("int").alias("caret"))
