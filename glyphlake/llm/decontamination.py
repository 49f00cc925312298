"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in DataFrame operations only.

A window is `size` consecutive words of an item (all its words, if it has fewer). Words are ordered by rarity:
the number of documents that hold them, over the whole corpus. A document contains a window only if it contains
every word of it, so for containment 1 the necessary prefix is the window's single rarest word. Documents are
joined with windows on that word; the window must fit into the document at the position which the word implies
(positional and length bounds), and its words are then compared with the document's, in order.

Each document row carries away only its positions with a prefix word, each with the few words around it, in a
scratch table. The set of prefix words goes into the plan as a literal if it has at most `max_tokens` members;
a larger one is joined by a shuffle instead. The windows are broadcast behind the same check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

#: What is between words; a word is a run of digits, letters a-z and anything beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
#: Most words of the benchmark that go into the plan as literals, and most windows that are broadcast.
MAX_TOKENS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP, -1), "")


def _windows(items: DataFrame, size: int) -> DataFrame:
    """win (words), win_len, item_ids: one row per distinct window."""
    long = F.size("w") - size
    starts = F.sequence(F.lit(1), F.greatest(long + 1, F.lit(1)))
    return (
        items.where(F.size("w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
        .groupBy("win")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"), F.size("win").alias("win_len"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of a window is hit. Null or empty texts, of documents or items, have
    no words; an item without words has no window. Repeated document rows are judged one by one; items with the
    same id count as one. Windows of an item without an id hit, but are not in n_items and items_sha256. An empty
    benchmark hits nothing. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), words_of(text_of(text_col)).alias("w"))
    items = items.select(F.col(item_col).alias("item_id"), words_of(text_of(item_text_col)).alias("w"))
    windows = materialize(_windows(items, size))
    vocabulary = windows.select(F.explode("win").alias("tok")).distinct()
    small = windows.count() <= max_tokens and len(known := [r.tok for r in vocabulary.limit(max_tokens + 1).collect()]) <= max_tokens

    # The words' rarity: in how many documents each occurs.
    if small:
        seen = texts.select(F.explode(F.array_distinct(F.filter("w", lambda x: x.isin(known)))).alias("tok"))
    else:
        seen = texts.select(F.explode(F.array_distinct("w")).alias("tok")).join(vocabulary, "tok", "left_semi")
    rarity = seen.groupBy("tok").agg(F.count("*").alias("df"))
    if small:
        rarity = F.broadcast(materialize(rarity))
    rarest = (
        windows.select("win", F.posexplode("win").alias("off", "tok"))
        .join(rarity, "tok", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok", "off")).alias("p"))
        .where("p.df > 0")  # no document has that word, so none has the window
    )
    windows = materialize(windows.join(rarest, "win").select("win", "win_len", "item_ids", F.col("p.tok").alias("tok"), F.col("p.off").alias("off")))

    # Where documents have a prefix word, with the words around it.
    reach = size - 1
    around = lambda w, i: F.struct(i.alias("i"), w.alias("tok"), F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1).alias("ctx"))
    if small:
        tokens = [r.tok for r in windows.select("tok").distinct().collect()]
        found = F.array_compact(F.transform("w", lambda w, i: F.when(w.isin(tokens), i))) if tokens else F.array().cast("array<int>")
        found = F.transform(found, lambda i: around(F.get("w", i), i))
        rows = materialize(texts.select("rid", "doc_id", F.size("w").alias("n_words"), found.alias("c")))
        base, candidates = rows.select("rid", "doc_id", "n_words"), rows.select("rid", "n_words", F.inline("c"))
        windows = F.broadcast(windows)
    else:
        rows = materialize(texts)
        base = rows.select("rid", "doc_id", F.size("w").alias("n_words"))
        at = rows.select("rid", F.posexplode("w").alias("i", "tok")).join(windows.select("tok").distinct(), "tok", "left_semi")
        at = at.groupBy("rid").agg(F.collect_list("i").alias("at"))
        candidates = rows.join(at, "rid").select("rid", F.size("w").alias("n_words"), F.inline(F.transform("at", lambda i: around(F.get("w", i), i))))
    start = F.col("i") - F.col("off")
    hits = (
        candidates.join(windows, "tok")
        .where((start >= 0) & (start + F.col("win_len") <= F.col("n_words")))
        .where(F.slice("ctx", start - F.greatest(F.col("i") - reach, F.lit(0)) + 1, F.col("win_len")) == F.col("win"))
        .select("rid", F.struct(start.alias("s"), (start + F.col("win_len")).alias("e")).alias("span"), "item_ids")
    )
    covered = F.aggregate(
        F.array_sort(F.collect_set("span")),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a.end, x.e).alias("end"), (a.n + F.greatest(x.e - F.greatest(a.end, x.s), F.lit(0))).alias("n")),
    )
    hits = hits.groupBy("rid").agg(covered["n"].alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return base.join(hits, "rid", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
