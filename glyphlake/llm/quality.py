"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, one per language.

Trusted documents (labelled good and not toxic) are counted per task in numpy; the n-gram counts are summed by
a shuffle, so what the model gathers grows with the trusted text. Counts are sharded by the last byte of the
context: an n-gram, all its suffixes and all their contexts are in one shard, so each shard turns its counts
into probabilities and back-off weights on its own. Scoring joins n-grams with the shards inside the tasks:
blocks of at most MAX_ENTRIES n-grams are broadcast, and every block adds its share of each document's log
probability; the texts themselves are never shuffled. A document is rejected if its perplexity lies above
a high quantile of that of the trusted documents held out of training in its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialize, trim

ORDER = 5
#: The threshold of a language: this quantile of its held-out trusted documents.
QUANTILE = 0.98
#: One in so many trusted documents is held out for the thresholds.
FOLDS = 5
#: Bytes at which a document counts as much as the mean of its language: short texts are judged less sharply.
PRIOR = 200
#: Most n-grams and contexts of a broadcast block (16 bytes each).
MAX_ENTRIES = 4_000_000
SHARDS = 64
#: Labels are broadcast up to so many rows (16 bytes each), joined by a shuffle beyond.
MAX_LABELS = 1_000_000
CHUNK = 1 << 20
#: Rows that are scored at a time.
ROWS = 1000
PAD = b"\n" * (ORDER - 1)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about CHUNK bytes: first, last, their bytes with padding, where each text starts."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(PAD + t.encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= CHUNK or i == len(texts) - 1:
            starts = np.cumsum([0, *map(len, held)])
            yield first, i + 1, np.frombuffer(b"".join(held), np.uint8), starts
            first, size, held = i + 1, 0, []


def _keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of a text proper, as an integer, and the number of such bytes per text."""
    x = data.astype(np.uint64)
    key = x[ORDER - 1 :].copy() if len(x) >= ORDER else np.empty(0, np.uint64)
    for k in range(1, ORDER):
        key |= x[ORDER - 1 - k : len(x) - k][: len(key)] << np.uint64(8 * k)
    inside = np.ones(len(data), bool)
    for k in range(ORDER - 1):
        inside[starts[:-1] + k] = False
    return key[inside[ORDER - 1 :]], np.diff(starts) - (ORDER - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, key, n), summed within the task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts):
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, weights=n).astype(np.int64)

    def out():
        for lang, parts in held.items():
            keys, n = merge(parts)
            for i in range(0, len(keys), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[s])), pa.array(keys[s].astype(np.int64)), pa.array(n[s])], names=["lang", "key", "n"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            for _, _, data, starts in _chunks([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                mine = held.setdefault(lang, [])
                mine.append(np.unique(_keys(data, starts)[0], return_counts=True))
                if len(mine) > 8:
                    held[lang] = [merge(mine)]
        if sum(len(p[0]) for parts in held.values() for p in parts) > 6_000_000:  # bounds the task's memory
            yield from out()
            held = {}
    yield from out()


@dataclass
class Table:
    """An open-addressing hash table from 64-bit keys to float32, all operations on whole arrays."""

    keys: np.ndarray
    values: np.ndarray
    shift: np.uint64

    EMPTY = np.uint64(2**64 - 1)
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        bits = max(4, int(2 * len(keys)).bit_length())
        out = cls(np.full(1 << bits, cls.EMPTY), np.zeros(1 << bits, np.float32), np.uint64(64 - bits))
        keys, values = keys.astype(np.uint64), values.astype(np.float32)
        at = ((keys * cls.FACTOR) >> out.shift).astype(np.int64)
        while len(keys):
            free = out.keys[at] == cls.EMPTY
            slot, first = np.unique(at[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            out.keys[slot], out.values[slot] = keys[mine], values[mine]
            rest = np.ones(len(keys), bool)
            rest[mine] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) % len(out.keys)
        return out

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and which keys are there."""
        at = ((keys * self.FACTOR) >> self.shift).astype(np.int64)
        seen = self.keys[at]
        there = seen == keys
        values = np.where(there, self.values[at], np.float32(0))
        open_ = np.flatnonzero(~there & (seen != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            values[open_[hit]] = self.values[at[open_[hit]]]
            there[open_[hit]] = True
            open_ = open_[~hit & (seen != self.EMPTY)]
        return values, there


def _tag(order: int) -> np.uint64:
    return np.uint64(order << 48)


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * order)) - 1)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and at least 3; mild fixed ones where a class is empty."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _build(keys: np.ndarray, counts: np.ndarray, unigram: np.ndarray, ds: dict[int, tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one shard: tagged n-grams (log probability) and contexts (log back-off weight, tag + 8)."""
    levels = {ORDER: (keys, counts.astype(np.float64))}
    for m in range(ORDER - 1, 1, -1):
        k, n = np.unique(levels[m + 1][0] & _mask(m), return_counts=True)
        levels[m] = (k, n.astype(np.float64))
    out_k, out_v = [], []
    lower_k, lower_p = np.arange(256, dtype=np.uint64), unigram
    for m in range(2, ORDER + 1):
        k, c = levels[m]
        d = np.array([0.0, *ds[m]])
        context, at = np.unique(k >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, weights=c)
        taken = d[np.minimum(c, 3).astype(int)]
        gamma = np.bincount(at, weights=taken) / total
        p = (c - taken) / total[at] + gamma[at] * lower_p[np.searchsorted(lower_k, k & _mask(m - 1))]
        out_k += [k | _tag(m), context | _tag(m + 8)]
        out_v += [np.log(p), np.log(gamma)]
        lower_k, lower_p = k, p
    return np.concatenate(out_k), np.concatenate(out_v)


@dataclass
class Model:
    """blocks: tables (language, shards) that are broadcast; unigrams and thresholds per language."""

    blocks: list
    unigrams: dict[str, np.ndarray]
    mean: dict[str, float]
    threshold: dict[str, float]


def _score_fn(block, unigrams, lang_at: int, text_at: int, keep: list[int], names: list[str], total_at: int | None):
    """Adds to each row the log probability of its bytes in this block, and its number of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {lang: (Table.of(k, v), shards) for lang, (k, v, shards) in block.value.items()}
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            langs, texts = batch.column(lang_at).to_pylist(), batch.column(text_at).to_pylist()
            lp, size = np.zeros(len(langs)), np.zeros(len(langs), np.int64)
            for lang in {x for x in langs if x in tables}:
                table, shards = tables[lang]
                uni = np.log(unigrams[lang])
                rows = np.array([i for i, x in enumerate(langs) if x == lang])
                for a, b, data, starts in _chunks([texts[i] or "" for i in rows]):
                    keys, n = _keys(data, starts)
                    value, open_ = np.zeros(len(keys)), np.arange(len(keys))
                    if len(shards) < SHARDS:
                        open_ = open_[np.isin((keys >> np.uint64(8)) % np.uint64(SHARDS), shards)]
                    for m in range(ORDER, 1, -1):
                        v, there = table.get((keys[open_] & _mask(m)) | _tag(m))
                        value[open_[there]] += v[there]
                        open_ = open_[~there]
                        value[open_] += table.get(((keys[open_] & _mask(m)) >> np.uint64(8)) | _tag(m + 8))[0]
                    value[open_] += uni[(keys[open_] & np.uint64(255)).astype(int)]
                    owner = np.repeat(np.arange(a, b), n)
                    lp[rows] += np.bincount(owner, weights=value, minlength=len(rows))
                    size[rows[a:b]] = n
            if total_at is not None:
                lp += np.asarray(batch.column(total_at))
                size = np.maximum(size, np.asarray(batch.column(total_at + 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(lp), pa.array(size)], names=names)
        del tables
        trim()

    return run


def score(docs: DataFrame, model: Model, lang_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """The columns to keep, and _lp_ (log probability) and _n_ (bytes); 0 and 0 for a language without a model."""
    spark = docs.sparkSession
    keep_all = list(dict.fromkeys([*keep, lang_col, text_col]))
    df, total = docs.select(*keep_all), None
    for i, block in enumerate(model.blocks):
        wanted = keep if i == len(model.blocks) - 1 else keep_all
        fields = [df.schema[c] for c in wanted] + [T.StructField("_lp_", T.DoubleType()), T.StructField("_n_", T.LongType())]
        fn = _score_fn(spark.sparkContext.broadcast(block), model.unigrams, df.columns.index(lang_col), df.columns.index(text_col), [df.columns.index(c) for c in wanted], [*wanted, "_lp_", "_n_"], total)
        df = df.mapInArrow(fn, T.StructType(fields))
        total = len(wanted)
    return df if model.blocks else df.select(*keep, F.lit(0.0).alias("_lp_"), F.lit(0).cast("long").alias("_n_"))


def train(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, max_entries: int = MAX_ENTRIES) -> Model:
    """The model and the thresholds, from doc_id, text and lang of docs and doc_id, quality and toxic of labels."""
    spark = docs.sparkSession
    lean(spark)
    good = labels.where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    if good.limit(MAX_LABELS + 1).count() <= MAX_LABELS:
        good = F.broadcast(good)
    trusted = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text").join(good, "doc_id", "left_semi")
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    counts = trusted.where(~held).select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("shard", (F.shiftright("key", 8) % SHARDS).cast("int")))
    # Counts of counts of every order, and the unigrams: a few rows for each language.
    level, ds = counts.select("lang", "key", "n"), {}
    for m in range(ORDER, 1, -1):
        if m < ORDER:
            level = level.select("lang", F.col("key").bitwiseAND(F.lit((1 << (8 * m)) - 1)).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
            level = materialize(level)
        for r in level.groupBy("lang").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).collect():
            ds.setdefault(r.lang, {})[m] = discounts(r.n1, r.n2, r.n3, r.n4)
    unigrams: dict[str, np.ndarray] = {}
    for r in level.groupBy("lang", F.col("key").bitwiseAND(F.lit(255)).alias("b")).agg(F.count("*").alias("n")).collect():
        unigrams.setdefault(r.lang, np.zeros(256))[r.b] = r.n
    for lang, n in unigrams.items():  # interpolated with the uniform distribution
        unigrams[lang] = (n * 0.98 / n.sum()) + 0.02 / 256

    # Shards to probabilities, on the executors.
    def build(table: pa.Table) -> pa.Table:
        lang, shard = table.column("lang")[0].as_py(), table.column("shard")[0].as_py()
        keys, n = np.asarray(table.column("key")).astype(np.uint64), np.asarray(table.column("n"))
        order = np.argsort(keys)
        k, v = _build(keys[order], n[order], unigrams[lang], ds[lang])
        return pa.table({"lang": [lang] * len(k), "shard": pa.array([shard] * len(k), pa.int32()), "k": k.astype(np.int64), "v": v.astype(np.float32)})

    entries = materialize(counts.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, k long, v float"))
    sizes = sorted((r.lang, r.shard, r["count"]) for r in entries.groupBy("lang", "shard").count().collect())
    groups, filled = [[]], 0
    for lang, shard, n in sizes:
        if filled + n > max_entries and groups[-1]:
            groups.append([])
            filled = 0
        groups[-1].append((lang, shard))
        filled += n
    blocks = []
    for group in groups if sizes else []:
        table = entries.where(F.struct("lang", "shard").isin([F.struct(F.lit(a), F.lit(b)) for a, b in group]) if len(groups) > 1 else F.lit(True)).toArrow()
        langs, shards = np.asarray(table.column("lang").to_pandas(), object), np.asarray(table.column("shard"))
        k, v = np.asarray(table.column("k")).astype(np.uint64), np.asarray(table.column("v"))
        blocks.append({x: (k[langs == x], v[langs == x], np.unique(shards[langs == x]).astype(np.uint64)) for x in {a for a, _ in group}})
    for lang in unigrams:  # shards without an n-gram belong to the language's first block: their bytes count too
        missing, home = np.arange(SHARDS, dtype=np.uint64), None
        for block in blocks:
            if lang in block:
                home = home or block
                missing = np.setdiff1d(missing, block[lang][2])
        if home:
            k, v, shards = home[lang]
            home[lang] = (k, v, np.concatenate([shards, missing]))
    model = Model(blocks, unigrams, {}, {})
    scored = materialize(score(trusted.where(held), model, "lang", "text", ["lang"]).where("_n_ > 0"))
    for r in scored.groupBy("lang").agg(F.sum("_lp_").alias("lp"), F.sum("_n_").alias("n")).collect():
        model.mean[r.lang] = r.lp / r.n
    for r in scored.groupBy("lang").agg(F.percentile_approx(-_rate(model), F.lit(quantile), F.lit(10_000)).alias("q")).collect():
        model.threshold[r.lang] = r.q
    return model


def _by_lang(values: dict[str, float]) -> F.Column:
    out = F.lit(None).cast("double")
    for lang, v in sorted(values.items()):
        out = F.when(F.col("lang") == lang, F.lit(float(v))).otherwise(out)
    return out


def _rate(model: Model) -> F.Column:
    """Log probability per byte, drawn to the language's mean for short texts."""
    return (F.col("_lp_") + PRIOR * _by_lang(model.mean)) / (F.col("_n_") + PRIOR)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], quantile: float = QUANTILE, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The named columns of docs (which has doc_id, text, lang), with perplexity, threshold and kept.

    Null or empty texts have perplexity null and are kept, as is every document whose language is null or has
    no trusted text: nothing is known against it. Ties with the threshold are kept. Repeated rows are judged
    alike; empty tables give no rows. Other columns pass untouched if named, but for those named like an output.
    """
    keep = [c for c in keep if c not in ("perplexity", "threshold", "kept")]
    model = train(docs, labels, quantile, max_entries)
    work = ["_lp_", "_n_"]
    rest = [c for c in keep if c not in ("lang",)]
    df = score(docs, model, "lang", "text", [*rest, "lang"])
    bits = -_rate(model)
    limit = _by_lang(model.threshold)
    known = (F.col("_n_") > 0) & limit.isNotNull()
    return df.withColumns({"perplexity": F.when(known, F.exp(bits)), "threshold": F.exp(limit), "kept": F.coalesce(~known | (bits <= limit), F.lit(True))}).drop(*work).select(*keep, "perplexity", "threshold", "kept")
