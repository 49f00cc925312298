"""Language identification by a linear-chain conditional random field over words.

Every word has affix features (first and last one to three letters), a lexicon feature (the word itself) and
n-gram features (its letter pairs), all hashed into one weight table; transitions between the languages of
neighbouring words are learned too. The field is fitted on the driver to a bounded sample: SAMPLE_DOCS documents
of each language, one window of SAMPLE_CHARS letters each, cut into sequences that switch language. The weights
(WIDTH x languages) are broadcast, and executors label whole texts by forward-backward, all documents of an
Arrow batch at once. A document's language is the one with the most expected words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, lean, mix, powers, text_of

WIDTH = 1 << 18
#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 4000
#: Features times languages at most: with more languages more features share a weight (64 MB of weights).
MAX_WEIGHTS = 1 << 24
STEPS, LENGTH = 40, 48
CHUNK = 1 << 21


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def features(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' words in order: 7 feature ids each; ids of their letter pairs; where each word's pairs
    begin; and the number of words of each text."""
    joined = "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[np.minimum(cp, 0x10FFFF)]
    edge = np.diff(is_letter.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.flatnonzero(cp == 10)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    if not len(start):
        return np.empty((0, 7), np.int32), np.empty(0, np.int32), np.empty(0, np.int64), counts
    x = cp.astype(np.uint64) + np.uint64(1)
    size = end - start
    fold = lambda h, tag: (mix(h * np.uint64(8) + np.uint64(tag)) % np.uint64(width - 1) + np.uint64(1)).astype(np.int32)
    ids = np.empty((len(start), 7), np.int32)
    head = tail = np.zeros(len(start), np.uint64)
    shift = np.uint64(21)
    for k in range(3):
        inside = size > k
        head = (head << shift) | np.where(inside, x[np.minimum(start + k, len(x) - 1)], 0).astype(np.uint64)
        tail = (tail << shift) | np.where(inside, x[np.maximum(end - 1 - k, 0)], 0).astype(np.uint64)
        ids[:, k], ids[:, 3 + k] = fold(head, k), fold(tail, 3 + k)
    place = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x)))).astype(np.int64) if start[0] == 0 else np.arange(len(x)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(x))))])
    inside = np.flatnonzero(is_letter)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    ids[:, 6] = fold(np.add.reduceat(mix(x[inside]) * powers(int(size.max()), BASE)[place[inside]], first), 6)
    before = np.where(place[inside] == 0, np.uint64(0), x[np.maximum(inside - 1, 0)])
    pairs = fold((before << shift) | x[inside], 7)
    return ids, pairs, first, counts


def emissions(weights: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the words of the texts (words x languages), and the number of words of each text."""
    out, counts, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            ids, pairs, first, n = features(held, len(weights))
            counts.append(n)
            if len(ids):
                e = weights[ids[:, 0]].copy()
                for k in range(1, 7):
                    e += weights[ids[:, k]]
                length = np.diff(np.append(first, len(pairs)))[:, None]
                for k in range(weights.shape[1]):
                    e[:, k] += (np.add.reduceat(weights[pairs, k], first) / length[:, 0]).astype(np.float32)
                out.append(e)
            held, size = [], 0
    return (np.concatenate(out) if out else np.empty((0, weights.shape[1]), np.float32)), (np.concatenate(counts) if counts else np.empty(0, np.int64))


def forward_backward(e: np.ndarray, counts: np.ndarray, trans: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals of every word; pairs (languages x languages), if given, gets the expected transitions added.

    Sequences lie one after another in e. They run in step, longest first, so step t holds a prefix of them.
    """
    e = np.exp(e - e.max(axis=1, keepdims=True, initial=-np.inf)) if len(e) else e
    order = np.argsort(-counts, kind="stable")
    size = counts[order]
    start = (np.cumsum(counts) - counts)[order]
    step = np.exp(trans - trans.max())
    alpha = np.empty_like(e)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    a = None
    for t, n in enumerate(active):
        at = start[:n] + t
        a = e[at] if t == 0 else (a[:n] @ step) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    out = np.empty_like(e)
    b = np.ones((0, e.shape[1]), e.dtype)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        grown = np.ones((n, e.shape[1]), e.dtype)
        if len(b):
            if pairs is not None:
                joint = alpha[at[: len(b)]][:, :, None] * step[None] * b[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            grown[: len(b)] = b @ step.T
        g = alpha[at] * grown
        out[at] = g / g.sum(axis=1, keepdims=True)
        b = grown * e[at]
        b /= b.sum(axis=1, keepdims=True)
    return out


def fit(samples: dict[str, list[str]], steps: int = STEPS, seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights and transitions: full-batch AdaGrad on the likelihood of sequences that switch language."""
    langs = sorted(samples)
    rng = np.random.default_rng(seed)
    texts = [" ".join(samples[x]) for x in langs]
    width = WIDTH
    while width * len(langs) > MAX_WEIGHTS:
        width //= 2
    ids, pairs, first, counts = features(texts, width)
    label = np.repeat(np.arange(len(langs)), counts)
    length = np.diff(np.append(first, len(pairs)))
    word = np.repeat(np.arange(len(ids)), length)
    # Sequences: runs of 8 to LENGTH words of one language; half of them are followed by a run of another.
    runs, at = [], 0
    for n in counts:
        i = 0
        while i < n:
            k = int(rng.integers(8, LENGTH + 1))
            runs.append(np.arange(at + i, at + min(n, i + k)))
            i += k
        at += n
    runs = [runs[i] for i in rng.permutation(len(runs))]
    sequences = []
    while runs:
        sequences.append(np.concatenate([runs.pop() for _ in range(min(len(runs), int(rng.integers(1, 4))))]))
    order, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    weights, trans = np.zeros((width, len(langs)), np.float32), np.eye(len(langs), dtype=np.float32)
    squares, tsquares = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    gold = np.zeros((len(ids), len(langs)), np.float32)
    gold[np.arange(len(ids)), label] = 1
    follow = np.zeros_like(trans)
    inner = np.ones(len(order), bool)
    inner[np.cumsum(sizes) - 1] = False
    np.add.at(follow, (label[order[:-1]][inner[:-1]], label[order[1:]][inner[:-1]]), 1)
    n = len(ids)
    for _ in range(steps):
        e = weights[ids].sum(axis=1)
        e += np.stack([np.bincount(word, weights=weights[pairs, k], minlength=n) for k in range(len(langs))], axis=1).astype(np.float32) / length[:, None]
        seen = np.zeros(trans.shape)
        m = np.empty_like(e)
        m[order] = forward_backward(e[order], sizes, trans, seen)
        g = (gold - m) / n
        grad = np.empty_like(weights)
        for k in range(len(langs)):
            grad[:, k] = np.bincount(ids.ravel(), weights=np.repeat(g[:, k], 7), minlength=width) + np.bincount(pairs, weights=(g[:, k] / length)[word], minlength=width)
        grad -= 1e-7 * weights
        squares += (grad * n) ** 2
        weights += 0.3 * (grad * n) / np.sqrt(squares)
        tgrad = (follow - seen).astype(np.float32)
        tsquares += tgrad**2
        trans = trans + 0.1 * tgrad / np.sqrt(tsquares)
    return langs, weights, trans.astype(np.float32)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the share of expected words).

    Learns from rows that are not held out and have a text and a language; language, source and id are not
    used to predict. A null text, or one without a letter, is `und` with score 0, and so is everything if
    there is nothing to learn from. Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    lean(spark)
    known = docs.where(~held_out(F.col(id_col))).where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    counts = known.groupBy("lang").count().collect()
    samples: dict[str, list[str]] = {}
    if counts:
        # sample_docs rows of each language at most, by hash, and a window of each.
        share = F.lit(0)
        for r in counts:
            share = F.when(F.col("lang") == r.lang, F.lit(max(1, r["count"] // sample_docs))).otherwise(share)
        n = F.length("t")
        at = F.when(n > SAMPLE_CHARS, F.pmod(F.shiftright("h", 20), n - SAMPLE_CHARS)).otherwise(0).cast("int") + 1
        rows = known.withColumn("share", share).where("pmod(h, share) = 0").select("lang", "h", F.col("t").substr(at, F.lit(SAMPLE_CHARS)).alias("t"))
        # Up to twice as many may pass the share, and of repeated rows, which have one hash, any number.
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= sample_docs)
        for r in rows.orderBy("lang", "k").collect():
            samples.setdefault(r.lang, []).append(r.t)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_of(text_col).alias("t"))
    if not samples:
        return out.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = spark.sparkContext.broadcast(fit(samples))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights, trans = model.value
        for batch in batches:
            e, counts = emissions(weights, batch.column(2).to_pylist())
            m = forward_backward(e, counts, trans)
            some = np.flatnonzero(counts)
            total = np.zeros((len(counts), len(langs)))
            if len(some):
                total[some] = np.add.reduceat(m.astype(np.float64), (np.cumsum(counts) - counts)[some], axis=0)
            best = total.argmax(axis=1)
            score = np.clip(total[np.arange(len(best)), best] / np.maximum(counts, 1), 0.0, 1.0)
            pred = [langs[b] if n else "und" for b, n in zip(best, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = out.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
