"""N-gram Jaccard join by grouped prefix join, and the components of its links.

Shingles are hashed in numpy, whole Arrow batches at a time. To order them by rarity, each shingle travels once,
packed to 6 bytes with a 2-byte row number, to the bucket of its hash; the bucket counts in how many documents
it occurs, and sends back only shingles that occur more than once. A document's prefix are its rarest shingles,
so many that two documents which link must share one; as single occurrences come first, a document that has
enough of them has no partner and takes no further part.

Documents with identical sets count as one (`rep`), those with identical prefixes and size as one group. Groups
that share a prefix shingle are chained to the smallest of them, never paired; the chains' components bound where
links can lie. Inside them, documents of fitting sizes are expanded and verified: exact intersections of all
pairs of a block of at most BLOCK by BLOCK documents, as matrix products inside one task, of which only a
spanning forest of the links is returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, components, discard, lean, materialize, mix, parts, release, salted_join, text_of, trim
from .words import blobs_of, dealt, word_hashes

SHINGLE, PERCENT = 3, 90
CHUNK, CHUNK_DOCS = 1 << 20, 50_000
BLOCK = 1000
VOCABULARY = 8192
#: Numbers of sets travel in 2 bytes; this one means so many or more.
MANY = 65535


def shingle_hashes(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct k-word shingles of each text; a text of fewer words is one shingle."""
    words, start = word_hashes(b"\n".join(texts))
    counts = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])), prepend=0) if texts else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    full = np.flatnonzero(np.arange(len(words)) + k <= np.cumsum(counts)[owner]) if len(words) else np.empty(0, np.int64)
    h = words[full]
    for i in range(1, k):
        h = mix(h + words[full + i] * np.uint64(0x9FB21C651E98DF25))
    who = owner[full]
    first = np.cumsum(counts) - counts
    for n in range(1, k):
        some = np.flatnonzero(counts == n)
        g = words[first[some]]
        for i in range(1, n):
            g = mix(g + words[first[some] + i] * np.uint64(0x9FB21C651E98DF25))
        h, who = np.concatenate([h, mix(g + np.uint64(n))]), np.concatenate([who, some])
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return who[new], h[new]


def six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


ROW = "part int, unit long, head boolean, ids binary, n binary, toks binary"


def _spread(sets: Callable, buckets: int):
    """(id, text) to rows of ROW: a head row for each unit of documents (ids, sizes, signatures), and its tokens by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def emit(ids: list, texts: list[bytes], unit: int) -> pa.RecordBatch:
            who, h = sets(texts)
            n = np.bincount(who, minlength=len(ids))
            first = np.cumsum(n) - n
            sig = np.zeros((len(ids), 2), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                sig[some, 0], sig[some, 1] = np.add.reduceat(mix(h), first[some]), np.add.reduceat(mix(h ^ BASE), first[some])
            tok = h >> np.uint64(16)
            part = (tok % np.uint64(buckets)).astype(np.int32)
            order, spans = dealt(part)
            part, tok, who = part[order], tok[order], who[order].astype("<u2")
            home = int(mix(np.array([unit], np.uint64))[0] % np.uint64(buckets))
            rows = [(home, True, np.array(ids, "<i8").tobytes(), n.astype("<i8").tobytes(), sig.tobytes())]
            rows += [(int(part[a]), False, who[a:b].tobytes(), None, six(tok[a:b])) for a, b in spans]
            p, head, i, c, t = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([unit] * len(p), pa.int64()), pa.array(head), pa.array(i, pa.binary()), pa.array(c, pa.binary()), pa.array(t, pa.binary())], names=["part", "unit", "head", "ids", "n", "toks"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                ids.append(i), texts.append(t)
                size += len(t)
                if size >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield emit(ids, texts, unit)
                    unit += 1
                    ids, texts, size = [], [], 0
        if ids:
            yield emit(ids, texts, unit)
        trim()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """One bucket: keeps the tokens that more than one set has, with their numbers of sets."""
    head = np.asarray(table.column("head").to_pandas(), bool)
    heads = table.filter(pa.array(head)).select(["unit", "head", "ids", "n", "toks"])
    rows = table.filter(pa.array(~head))
    unit = rows.column("unit").to_pylist()
    del table
    tok = np.concatenate([np.empty(0, np.uint64), *map(unsix, blobs_of(rows, "toks"))])
    # Numbers of sets, by the sorted tokens' runs.
    order = np.argsort(tok)
    new = np.flatnonzero(np.concatenate([[True], tok[order[1:]] != tok[order[:-1]]])) if len(tok) else np.empty(0, np.int64)
    count = np.diff(new, append=len(tok))
    df = np.empty(len(tok), "<u2")
    df[order] = np.repeat(np.minimum(count, MANY).astype("<u2"), count)
    del order, new, count
    out, begin = [], 0
    for u, i in zip(unit, blobs_of(rows, "ids"), strict=True):
        who = np.frombuffer(i, "<u2")
        s = slice(begin, begin + len(who))
        begin += len(who)
        keep = df[s] > 1
        if keep.any():
            out.append((u, False, who[keep].tobytes(), df[s][keep].tobytes(), six(tok[s][keep])))
    u, f, i, n, t = zip(*out, strict=True) if out else ([], [], [], [], [])
    new = pa.table({"unit": pa.array(u, pa.int64()), "head": pa.array(f, pa.bool_()), "ids": pa.array(i, pa.binary()), "n": pa.array(n, pa.binary()), "toks": pa.array(t, pa.binary())})
    return pa.concat_tables([heads.cast(new.schema), new])


SETS = "id long, n long, s1 long, s2 long, single long, pre array<long>, pre_df array<int>, toks binary"


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """So many of a set's rarest tokens that a set with this Jaccard similarity must have one of them."""
    return n - (percent * n + 99) // 100 + 1


def _assemble(percent: int):
    """One unit: every set, with its prefix and its repeated tokens if it may have a partner."""

    def run(table: pa.Table) -> pa.Table:
        head = table.column("head").to_pylist()
        at = head.index(True)
        ids = np.frombuffer(table.column("ids")[at].as_py(), "<i8")
        n = np.frombuffer(table.column("n")[at].as_py(), "<i8")
        sig = np.frombuffer(table.column("toks")[at].as_py(), np.uint64).reshape(-1, 2).view(np.int64)
        rest = [i for i, x in enumerate(head) if not x]
        who = np.concatenate([np.empty(0, "<u2"), *(np.frombuffer(table.column("ids")[i].as_py(), "<u2") for i in rest)]).astype(np.int64)
        df = np.concatenate([np.empty(0, "<u2"), *(np.frombuffer(table.column("n")[i].as_py(), "<u2") for i in rest)]).astype(np.int64)
        tok = np.concatenate([np.empty(0, np.uint64), *(unsix(table.column("toks")[i].as_py()) for i in rest)])
        single = n - np.bincount(who, minlength=len(ids))
        p = np.where(n > 0, prefix_length(n, percent), 0)
        order = np.lexsort((tok, df, who))
        tok, df, begin = tok[order], df[order], np.concatenate([[0], np.cumsum(n - single)])
        pre, pre_df, toks = [], [], []
        for i in range(len(ids)):
            if single[i] < p[i]:
                s, e = begin[i], begin[i + 1]
                k = min(e, s + p[i] - single[i])
                pre.append(tok[s:k].astype(np.int64)), pre_df.append(df[s:k].astype(np.int32)), toks.append(six(np.sort(tok[s:e])))
            else:
                pre.append(None), pre_df.append(None), toks.append(None)
        return pa.table({"id": ids, "n": n, "s1": np.ascontiguousarray(sig[:, 0]), "s2": np.ascontiguousarray(sig[:, 1]), "single": single, "pre": pa.array(pre, pa.list_(pa.int64())), "pre_df": pa.array(pre_df, pa.list_(pa.int32())), "toks": pa.array(toks, pa.binary())})

    return run


def _verify(percent: int):
    """One block pair of a cluster: a spanning forest (a, b) of the links between its sets."""

    def run(table: pa.Table) -> pa.Table:
        ids, n = np.asarray(table.column("id")), np.asarray(table.column("n"))
        near = np.asarray(table.column("near").to_pandas(), bool)
        if len(ids) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        toks = [unsix(t) for t in table.column("toks").to_pylist()]
        who = np.repeat(np.arange(len(ids)), [len(t) for t in toks])
        _, tok, count = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
        common = count > 1
        new = np.cumsum(common) - 1
        who, tok = who[common[tok]], new[tok[common[tok]]]
        order = np.argsort(tok, kind="stable")
        who, tok = who[order], tok[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, int(common.sum()), VOCABULARY):
            a, b = np.searchsorted(tok, [lo, lo + VOCABULARY])
            m = np.zeros((len(ids), min(VOCABULARY, int(common.sum()) - lo)), np.float32)
            m[who[a:b], tok[a:b] - lo] = 1
            rows = np.flatnonzero(m.any(axis=1))
            m = m[rows]
            both[np.ix_(rows, rows)] += m @ m.T
        inter = both.astype(np.int64)
        link = (100 * inter >= percent * (n[:, None] + n[None, :] - inter)) & (near[:, None] | near[None, :]) & (n[:, None] > 0)
        label = np.arange(len(ids))
        while True:
            new = np.minimum(label, np.where(link, label[None, :], len(ids)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        child = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[child], "b": ids[label[child]]})

    return run


def linked(rows: DataFrame, sets: Callable = shingle_hashes, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(id, n, rep, component) of rows (id, t): set size, smallest id with the same set, smallest id reachable by links."""
    spark = rows.sparkSession
    lean(spark)
    buckets = 4 * max(16, parts(spark))
    spread = rows.mapInArrow(_spread(sets, buckets), ROW)
    counted = spread.groupBy("part").applyInArrow(_repeated, "unit long, head boolean, ids binary, n binary, toks binary")
    table = materialize(counted.groupBy("unit").applyInArrow(_assemble(percent), SETS))
    release(spark)
    classes = table.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    classes = materialize(classes)
    reps = salted_join(table.where("pre IS NOT NULL"), classes, ["n", "s1", "s2"]).where("rep IS NULL OR rep = id").select("id", "n", "single", "pre", "pre_df", "toks", F.coalesce("c", F.lit(1)).alias("c"))
    # Repeated rows of one id are one set here.
    reps = materialize(reps.dropDuplicates(["id", "n"]))
    # Groups: identical prefixes and sizes. A prefix with a single occurrence is nobody else's.
    key = F.xxhash64("pre")
    groups = reps.where("single = 0").groupBy("n", key.alias("k")).agg(F.min("id").alias("gid"), F.count("*").alias("members")).where("members > 1")
    grouped = salted_join(reps.select("id", "n", "single", "pre", "pre_df", "c").withColumn("k", F.when(F.col("single") == 0, key)), groups, ["n", "k"])
    grouped = materialize(grouped.select("id", F.coalesce("gid", "id").alias("gid"), "c", "pre", "pre_df"))
    # A token that only copies of one set have joins nothing; of MANY or more it is not known.
    postings = grouped.where("id = gid").select("gid", "c", F.explode(F.arrays_zip("pre", "pre_df")).alias("x")).where((F.col("x.pre_df") > F.col("c")) | (F.col("x.pre_df") >= MANY)).select("gid", F.col("x.pre").alias("tok"))
    leaders = postings.groupBy("tok").agg(F.min("gid").alias("leader"), F.count("*").alias("m")).where("m > 1").select("tok", "leader")
    chains = salted_join(postings, leaders, ["tok"], "inner").where("gid <> leader").select(F.col("gid").alias("a"), F.col("leader").alias("b")).distinct()
    chains = chains.unionByName(grouped.where("id <> gid").select(F.col("id").alias("a"), F.col("gid").alias("b")))
    clusters = components(chains)
    discard(grouped)
    # Members, dealt to units of neighbouring size bands, each cut into blocks.
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).cast("int")
    members = reps.join(clusters, "id").select("component", "id", "n", "toks", band.alias("band"))
    members = materialize(members)
    discard(reps)
    spans = members.select("component", F.explode(F.array("band", F.col("band") - 1)).alias("u"), "band")
    spans = spans.groupBy("component", "u").agg(F.count("*").alias("m"), F.count_if(F.col("u") == F.col("band")).alias("own")).where("m > 1 AND own > 0")
    spans = spans.select("component", "u", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks"))
    dealt = members.withColumn("u", F.explode(F.array("band", F.col("band") - 1))).join(spans, ["component", "u"])
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", "u", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "n", (F.col("band") == F.col("u")).alias("near"), "toks")
    links = dealt.groupBy("component", "u", "i", "j").applyInArrow(_verify(percent), "a long, b long")
    found = components(links)
    discard(members)
    out = salted_join(table.select("id", "n", "s1", "s2"), classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("id", "n", F.coalesce("rep", "id").alias("rep"))
    return salted_join(out, found.select(F.col("id").alias("rep"), "component"), ["rep"]).select("id", "n", "rep", F.coalesce("component", "rep").alias("component"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, set_id.

    Two documents link when 100 * intersection >= percent * union of their distinct word shingles. A null
    or empty text has an empty set and links with nothing. Rows with one id are one document if their texts
    agree. Null ids are dropped, for they name nothing; an empty table gives no rows.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("t"))
    return linked(rows, partial(shingle_hashes, k=shingle), percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("rep").alias("set_id"))
