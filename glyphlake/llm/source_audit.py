"""Source divergence audit: how far the word frequencies of the sources of a language lie from each other.

The terms of each language are dealt to vocabulary chunks by hash, and every group (language, source) has one
packed vector of counts for each chunk. The groups of a language lie in blocks of BLOCK; a task of the tiling is a
pair of blocks over a slab of SLAB chunks. Vectors are replicated to the tasks of their block, sorted by chunk and
streamed: a task holds the vectors of one chunk, adds its share of the pair submatrix and goes on to the next. The
shares of the slabs are summed by a shuffle, so neither a large vocabulary nor many sources meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, parts, text_of, trim
from .tally import LETTERS, Tally, bounded, runs

#: Terms in fewer documents of a language are left out.
LEAST_DOCS = 3
#: Terms that a source stands out by, at most.
TOP = 200
SCALE = 1_000_000_000
#: Groups in a block, chunks in a slab, counts of a chunk on average.
BLOCK, SLAB, CHUNK = 16, 16, 1 << 16

_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term, and documents with it, summed within each task."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[tuple[str, str], int] = {}
        held = Tally()

        def out() -> Iterator[pa.RecordBatch]:
            names = list(ids)
            for group, term, n, having in held.take():
                lang, source = (pa.array([names[g][k] for g in group.tolist()], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(having, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            group = np.array([ids.setdefault(k, len(ids)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            for a, b, data, starts in runs(batch.column(2), LETTERS):
                held.add(data, starts, group[a:b])
                if held.full():
                    yield from out()
        yield from out()
        trim()

    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exactly."""
    if len(n) and int(n.max()) >= 2**63 // SCALE - 1:
        return np.array([1 + SCALE * (x + 1) // total for x in n.tolist()], np.int64)
    return 1 + SCALE * (n + 1) // total


def _vectors(rows: list[tuple], size: int) -> np.ndarray:
    """The shares of each group of a chunk in full: a term that a group lacks has the share of no occurrence."""
    out = np.empty((len(rows), size), np.int64)
    for p, (idx, n, total) in zip(out, rows, strict=True):
        p[:] = 1 + SCALE // max(total, 1)
        p[idx] = shares(n, total)
    return out


def submatrix(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The divergence of each row group from each column group: the sum over the terms of floor((p - q) ** 2 / q)."""
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, p in enumerate(rows):
        for j, q in enumerate(columns):
            d = p - q
            out[i, j] = (d * d // q).sum()
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted vectors to (lang, source, item, value), the share of a slab in each pair of sources."""
    tile: tuple | None = None
    chunk: tuple | None = None
    held: list[tuple] = []
    sums: dict[tuple[str, str], int] = {}

    def add() -> None:
        """Both directions of the pairs between the two blocks, or within the one."""
        if not held:
            return
        i, j, size = tile[1], tile[2], held[0][0]
        p = _vectors([x[3:] for x in held], size)
        one, two = ([k for k, x in enumerate(held) if x[1] == b] for b in (i, j))
        for a, b in [(one, two)] if i == j else [(one, two), (two, one)]:
            for x, line in zip(a, submatrix(p[a], p[b]).tolist(), strict=True):
                for y, value in zip(b, line, strict=True):
                    if x != y:
                        key = held[x][2], held[y][2]
                        sums[key] = sums.get(key, 0) + value
        held.clear()

    def out() -> Iterator[pa.RecordBatch]:
        if sums:
            a, b = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(a)), pa.array(a), pa.array(b), pa.array(sums.values(), pa.int64())], names=["lang", "source", "item", "value"])
            sums.clear()

    for batch in batches:
        c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        keys = list(zip(*(c[x].to_pylist() for x in ("lang", "i", "j", "slab", "chunk", "terms", "block", "source", "total")), strict=True))
        for r, (lang, i, j, slab, at, size, block, source, total) in enumerate(keys):
            if (lang, i, j, slab, at) != chunk:
                add()
                if (lang, i, j, slab) != tile:
                    yield from out()
                    tile = lang, i, j, slab
                chunk = lang, i, j, slab, at
            idx, n = (c[x][r].values for x in ("idx", "n"))
            idx, n = (np.empty(0, np.int64) if x is None else x.to_numpy(zero_copy_only=False) for x in (idx, n))
            held.append((size, block, source, idx, n, total))
    add()
    yield from out()


def source_audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, slab: int = SLAB) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows compare two sources of a language, `term` rows name what a source overuses.

    A share p is 1 + floor(10^9 (count + 1) / (N + V)) over the V terms that at least 3 documents (rows) of the
    language have; a value is floor((p - q)^2 / q), summed over the terms for a pair, with q the other source's
    share, and with q the language's for a term. Nulls in text, language or source are empty; a language whose
    terms are all rare has pairs of value 0 and no terms; a source alone in its language has no pairs; an empty
    table gives no rows. Repeated rows count each. Ranks follow value, then the item's bytes. Other columns are not read.
    """
    spark = docs.sparkSession
    lean(spark)
    groups = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    counts = term_counts(docs, lang_col, source_col, text_col)
    # All sources of a term together are as many rows as there are sources.
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("all_n", F.sum("n").over(of_term))
    counts = materialize(counts.where(F.col("in_docs") >= LEAST_DOCS).select("lang", "source", "term", "n", "all_n"))

    # One row for each language: its terms, their occurrences and the chunks that they are dealt to.
    rows_of = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    vocabulary = counts.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    langs = groups.select("lang").distinct().join(vocabulary, "lang", "left").join(rows_of.groupBy("lang").agg(F.sum("rows").alias("rows")), "lang", "left").fillna(0)
    langs = langs.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("rows") / chunk)).cast("int"))
    langs = materialize(langs)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(rows_of.select("lang", "source", "total"), ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    groups = groups.withColumn("block", F.floor(place / block).cast("int")).withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    groups = materialize(groups.select("lang", "source", (F.col("total") + F.col("v")).alias("total"), "block", "blocks", "chunks"))

    # Packed vectors. A term's number is its place in its chunk.
    dealt = counts.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("idx", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    packed = dealt.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("idx", "n")).alias("x"))
    packed = materialize(packed.select("lang", "source", "chunk", F.col("x.idx").alias("idx"), F.col("x.n").alias("n"), (F.array_max("x.idx") + 1).alias("terms")))
    sizes = packed.groupBy("lang", "chunk").agg(F.max("terms").alias("terms"))
    grid = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    grid = grid.join(sizes, ["lang", "chunk"], "left").fillna(0, ["terms"]).join(packed.drop("terms"), ["lang", "source", "chunk"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = grid.select("lang", "source", "block", "total", "terms", "chunk", F.floor(F.col("chunk") / slab).cast("int").alias("slab"), "idx", "n", other)
    tiles = tiles.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    order = ["lang", "i", "j", "slab", "chunk", "block", "source"]
    tiles = tiles.repartition(parts(spark), "lang", "i", "j", "slab").sortWithinPartitions(*order)
    pairs = tiles.mapInArrow(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked(pairs).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    known = counts.join(langs.select("lang", (F.col("all_total") + F.col("v")).alias("of_lang")), "lang").join(groups.select("lang", "source", "total"), ["lang", "source"])
    share = lambda n, total: F.expr(f"1 + (CAST({SCALE} AS DECIMAL(19, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) div CAST({total} AS DECIMAL(19, 0))")
    known = known.select("lang", "source", F.col("term").alias("item"), share("n", "total").alias("p"), share("all_n", "of_lang").alias("q")).where("p > q")
    known = ranked(known.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))).where(F.col("rank") <= top)
    return pairs.unionByName(known.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
