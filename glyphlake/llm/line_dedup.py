"""Line dedup by an exact set-similarity join of lines.

Tokens are the distinct words of a line, ordered by rarity: how often they occur in the corpus. The counts of
the VOCABULARY most frequent words are broadcast; all others are rarest, and a fixed bitmap of the repeated ones
tells most words that occur once, which join nothing. A line set posts its prefix, with its size, its place, the
token's position and a parity sketch of its words: the bits in which two sketches differ are at most the words
in which two sets do. Postings meet by token; length, positional and sketch bounds leave few pairs. In order of
place, each set takes the earliest sets that pass the bounds as its candidates, until STRONG of them have near
sketches, and their exact similarities decide. Sets which their candidates do not settle, and that may have
further ones, are open: a second round pairs just those with everything that passes. So a family of near copies
costs its size, no pair goes unverified that could matter, and nothing is chained.

A prefix token above HOT occurrences would gather an unbounded list. All tokens after it in the order are as
frequent, so it is replaced by pairs of hot tokens in the prefix that is one longer, of which matching sets
share two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, discard, lean, materialize, mix, parts, release, text_of, trim
from .ngram_join import prefix_length
from .words import bitmap_of, blobs_of, dealt, in_bitmap, packed, unpacked, word_hashes

PERCENT = 80
#: Most frequent words whose counts are broadcast (12 bytes each); rarer ones count as rarest, results do not change.
VOCABULARY = 1 << 20
#: Bits of the broadcast bitmaps (8 MB); a full one filters nothing and changes no result.
BITS = 1 << 26
#: Words that occur more often are posted in pairs.
HOT = 1 << 16
#: In the first round, a list gives a set as many candidates as it has, but ends after so many, or so many strong ones.
TRIED, STRONG = 64, 1
#: Words in the smallest class of set sizes; a class's sketches have as many bits as its sets have words at most.
SMALLEST = 128
CHUNK = 1 << 20
#: Up to so many documents are looked up by their ids.
FEW = 5000
#: Bytes of postings in a bucket, about.
GROUP = 24 << 20
_NOTHING = np.empty(0, np.int64)


@dataclass
class Counts:
    """Words in order of their hashes, with their numbers of occurrences; a bitmap of all repeated words; most frequent sets and where each stands first."""

    words: np.ndarray
    seen: np.ndarray
    repeated: bytes
    heavy: np.ndarray
    place: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        """Occurrences of distinct words: 2 for repeated ones beyond the vocabulary, 1 for words that occur once."""
        words = words.view(np.int64)
        out = np.where(in_bitmap(self.repeated, words), 2, 1)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            out = np.where(self.words[at] == words, self.seen[at], out)
        return out

    def later(self, sig: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Which lines repeat a frequent set that stands first elsewhere."""
        if not len(self.heavy):
            return np.zeros(len(sig), bool)
        at = np.minimum(np.searchsorted(self.heavy, sig), len(self.heavy) - 1)
        return (self.heavy[at] == sig) & ((self.place[at, 0] != doc) | (self.place[at, 1] != line))


def _feeds(text: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(text, np.uint8) == 10)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Documents cut at line feeds into units of about CHUNK bytes: document, number and text of the lines."""
    ids, first, texts, size = [], [], [], 0

    def unit():
        text = b"\n".join(texts)
        end = np.cumsum([len(t) + 1 for t in texts])
        n = np.diff(np.searchsorted(_feeds(text), end - 1), prepend=-1)
        line = np.arange(n.sum()) + np.repeat(np.array(first) - np.cumsum(n) + n, n)
        return np.repeat(np.array(ids, np.int64), n), line, text

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t, at, line = t.as_py(), 0, 0
            while at <= len(t):
                cut = t.find(b"\n", at + CHUNK) if len(t) - at > CHUNK else -1
                cut = len(t) if cut < 0 else cut
                ids.append(i), first.append(line), texts.append(t[at:cut])
                size += cut - at + 1
                if cut < len(t):
                    line += texts[-1].count(b"\n") + 1
                at = cut + 1
                if size >= CHUNK or len(ids) >= CHUNK >> 4:
                    yield unit()
                    ids, first, texts, size = [], [], [], 0
    if ids:
        yield unit()
    trim()


SCAN = "part int, words binary, n binary, sig long, doc_id long, line long"


def _scan(buckets: int):
    """Words with their numbers of occurrences in some units, packed by bucket; with part null, the set of each line that has words, and with sig null too, numbers of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            k, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return k, np.bincount(at, weights=np.concatenate([x[1] for x in held])).astype("<i8")

        def out():
            k, n = merged()
            part = (k % np.uint64(buckets)).astype(np.int32)
            order, spans = dealt(part)
            part, k, n = part[order], k[order], n[order]
            no = pa.nulls(len(spans), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array([k[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()), no, no, no], names=["part", "words", "n", "sig", "doc_id", "line"])

        for doc, line, text in _units(batches):
            x = Sets.read(text, len(doc))
            held.append((x.known, x.occurrences))
            last = np.flatnonzero(np.append(line[1:] <= line[:-1], True) | np.append(doc[1:] != doc[:-1], True))
            size = len(x.some) + len(last)
            no, sig = pa.nulls(size, pa.binary()), pa.concat_arrays([pa.array(x.sig[x.some]), pa.nulls(len(last), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int32()), no, no, sig, pa.array(np.concatenate([doc[x.some], doc[last]])), pa.array(np.concatenate([line[x.some], line[last] + 1]))], names=["part", "words", "n", "sig", "doc_id", "line"])
            if len(held) == 8:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:  # bounds the task's memory
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def _sum(table: pa.Table) -> pa.Table:
    """One bucket of words: those that occur more than once, with their numbers of occurrences."""
    k, at = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in blobs_of(table, "words")]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([np.frombuffer(x, "<i8") for x in blobs_of(table, "n")]))
    return pa.table({"key": k[n > 1].view(np.int64), "n": n[n > 1].astype(np.int64)})


class Sets:
    """Lines as sets: n distinct words and a hash of each line; tok and seen by (line, rarity) if counts are given."""

    @classmethod
    def read(cls, text: bytes, lines: int, counts: Counts | None = None, holding: bytes | None = None) -> Sets:
        """The lines of a unit. holding: a bitmap, of whose words a line needs one to be read; other lines count as empty."""
        words, start = word_hashes(text)
        who = np.repeat(np.arange(lines), np.diff(np.searchsorted(start, _feeds(text)), prepend=0, append=len(start))) if lines else _NOTHING
        if holding is not None:
            read = np.zeros(lines, bool)
            read[who[in_bitmap(holding, words.view(np.int64))]] = True
            words, who = words[read[who]], who[read[who]]
        return cls(words, who, lines, counts)

    def __init__(self, words: np.ndarray, who: np.ndarray, lines: int, counts: Counts | None = None):
        known, at = np.unique(words, return_inverse=True)
        if counts is None:
            seen, rank = None, at
            self.known, self.occurrences = known, np.bincount(at, minlength=len(known))
        else:  # ranks by (count, hash) among the unit's words make one sortable number of a line and a word
            seen = counts.of(known)
            order = np.argsort(seen, kind="stable")
            rank = np.empty(len(known), np.int64)
            rank[order] = np.arange(len(known))
            rank, known, seen = rank[at], known[order], seen[order]
        key = np.sort(who * max(1, len(known)) + rank)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        self.who, at = np.divmod(key, max(1, len(known)))
        self.tok, self.seen = known[at], None if seen is None else seen[at]
        self.n = np.bincount(self.who, minlength=lines).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.sig = np.zeros(lines, np.uint64)
        self.some = np.flatnonzero(self.n)
        if len(self.some):
            self.sig[self.some] = np.add.reduceat(mix(self.tok + BASE), self.first[self.some])
        self.sig = mix(self.sig + self.n.astype(np.uint64)).view(np.int64)

    def sketches(self, rows: np.ndarray, bits: int) -> np.ndarray:
        """Of some lines: bit k of a sketch is the parity of the number of words that hash to k."""
        n = self.n[rows]
        at = np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        slot = mix(self.tok[at]) >> np.uint64(64 - int(bits).bit_length() + 1)
        bit, lane = np.uint64(1) << (slot & np.uint64(63)), slot >> np.uint64(6)
        out, cut = np.zeros((len(rows), bits // 64), np.uint64), np.cumsum(n) - n
        for k in range(bits // 64):
            out[:, k] = np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), cut)
        return out


def post(bits: int) -> np.dtype:
    return np.dtype([("tok", "<u8"), ("sig", "<i8"), ("doc", "<i8"), ("line", "<u4"), ("n", "<u4"), ("at", "<u4"), ("sketch", "<u8", (bits // 64,))])


def _keys(x: Sets, rows: np.ndarray, percent: int, hot: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys by which the sets in rows are posted: set, key and position."""
    size = prefix_length(x.n, percent)
    wanted = np.zeros(len(x.n), bool)
    wanted[rows] = True
    at = np.arange(len(x.tok)) - x.first[x.who]
    use = wanted[x.who] & (at < size[x.who]) & (x.seen > 1)
    warm = use & (x.seen <= hot)
    who, key, place = [x.who[warm]], [x.tok[warm]], [at[warm]]
    for r in np.unique(x.who[use & (x.seen > hot)]).tolist():
        a, e = x.first[r], x.first[r] + min(x.n[r], size[r] + 1)
        tok = x.tok[a:e][x.seen[a:e] > hot]
        i, j = np.triu_indices(len(tok), 1)
        who.append(np.full(len(i), r)), key.append(mix(mix(tok[i]) + tok[j])), place.append(i + (e - a - len(tok)))
    return np.concatenate(who), np.concatenate(key), np.concatenate(place)


def _post(model: Broadcast, buckets: int, percent: int, hot: float, only: Broadcast | None):
    """Lines to postings, packed by class and bucket. only: a bitmap of the keys to post."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, line, text in _units(batches):
            x = Sets.read(text, len(doc), model.value, only and only.value)
            order = np.lexsort((line, doc))
            use = np.zeros(len(x.n), bool)
            use[order[np.unique(x.sig[order], return_index=True)[1]]] = True
            # Of two different sets, the smaller of size n has a similarity of at most n / (n + 1): equal sets need no join.
            use &= (x.n > 0) & (100 * x.n >= percent * (x.n + 1)) & ~model.value.later(x.sig, doc, line)
            out, bits, most = [], SMALLEST, int(x.n.max(initial=0))
            while bits < 2 * most or bits == SMALLEST:
                # A class holds its own sets, and larger ones that may match them.
                rows = np.flatnonzero(use & (percent * x.n <= 100 * bits) & (x.n > (bits // 2 if bits > SMALLEST else 0)))
                if len(rows):
                    who, key, at = _keys(x, rows, percent, hot)
                    if only is not None:
                        keep = in_bitmap(only.value, key.view(np.int64))
                        who, key, at = who[keep], key[keep], at[keep]
                    part = (key % np.uint64(buckets)).astype(np.int32)
                    order, spans = dealt(part)
                    part, who, key, at = part[order], who[order], key[order], at[order]
                    posts = np.empty(len(key), post(bits))
                    sketch = np.zeros((len(x.n), bits // 64), np.uint64)
                    sketch[rows] = x.sketches(rows, bits)
                    posts["tok"], posts["sig"], posts["doc"], posts["line"], posts["n"], posts["at"], posts["sketch"] = key, x.sig[who], doc[who], line[who], x.n[who], at, sketch[who]
                    out += [(bits, int(part[a]), packed(posts[a:b])) for a, b in spans]
                bits *= 2
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], names=["bits", "part", "posts"])

    return run


def _open_keys(model: Broadcast, percent: int, hot: float):
    """The words of open sets to the keys of their postings, and of a pair the first word too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(0)]
            x = Sets(np.concatenate([np.empty(0, "<u8"), *sets]), np.repeat(np.arange(len(sets)), [len(t) for t in sets]), len(sets), model.value)
            who, key, at = _keys(x, np.flatnonzero(x.n), percent, hot)
            yield pa.RecordBatch.from_arrays([pa.array(np.union1d(key, x.tok[x.first[who] + at]).view(np.int64))], names=["key"])

    return run


def _lines(text: bytes, wanted: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The wanted lines of a unit: their rows and their text."""
    rows = np.flatnonzero(wanted)
    if not len(rows):
        return rows, b""
    feeds = np.concatenate([[-1], _feeds(text), [len(text)]])
    return rows, b"\n".join([text[a:b] for a, b in zip((feeds[rows] + 1).tolist(), feeds[rows + 1].tolist(), strict=True)])


def name_of(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place, for bitmaps."""
    return mix(mix(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)).view(np.int64)


PAIRS = "name long, doc long, line long, name2 long, doc2 long, line2 long, more boolean, gap int"


def candidates(x: np.ndarray, bits: int, percent: int, tried: int, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings by (key, place): later and earlier posting of the pairs to verify, and whether the later has more.

    Without open_, each set's earlier ones that pass the bounds, up to `tried` or up to STRONG whose sketches differ by
    half the bound at most; with it, all pairs of the open postings.
    """
    new = np.concatenate([[True], x["tok"][1:] != x["tok"][:-1]])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    alive = np.flatnonzero(~new if open_ is None else ~new & open_)
    # Repeats of a set in its list are the same set.
    same = mix(x["tok"] + mix(x["sig"].view(np.uint64)))
    first = np.zeros(len(x), bool)
    first[np.unique(same, return_index=True)[1]] = True
    alive = alive[first[alive]]
    # Where two sets have their first common token, at most the tokens from there on are common; all pairs meet there.
    n, sketch = x["n"].astype(np.int64), np.ascontiguousarray(x["sketch"])
    rest, share = (100 + percent) * (n - x["at"]), percent * n
    passed, strong = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    left, right, step, slab = [], [], 0, max(1, (1 << 22) // bits)
    while len(alive):
        alive = alive[start[alive] + step < alive]
        done = []
        for lo in range(0, len(alive), slab):
            i = alive[lo : lo + slab]
            j = start[i] + step
            ok = np.minimum(rest[i], rest[j]) >= share[i] + share[j]
            i, j = i[ok], j[ok]
            ok = (np.minimum(n[i], n[j]) <= bits) & first[j]
            i, j = i[ok], j[ok]
            both = n[i] + n[j]
            most = both - 2 * -(-percent * both // (100 + percent))
            far = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
            ok = far <= most
            i, j = i[ok], j[ok]
            left.append(i), right.append(j)
            passed[i] += 1
            strong[i] += 2 * far[ok] <= most[ok]
            done.append(i[(strong[i] == STRONG) | (passed[i] == tried)])
        if done and open_ is None:
            stop = np.zeros(len(x), bool)
            stop[np.concatenate(done)] = True
            alive = alive[~stop[alive]]
        step += 1
    i, j = (np.concatenate(y) if y else _NOTHING for y in (left, right))
    if open_ is None:
        return i, j, ((strong == STRONG) | (passed == tried))[i]
    return i, j, np.zeros(len(i), bool)


def _meet(percent: int, tried: int, open_: Broadcast | None):
    """One bucket of a class: the pairs to verify."""

    def run(table: pa.Table) -> pa.Table:
        bits = table.column("bits")[0].as_py()
        x = unpacked(list(blobs_of(table, "posts")), post(bits))
        del table
        x = x[np.argsort(x["tok"], kind="stable")]
        alone = np.ones(len(x), bool)
        alone[1:] &= x["tok"][1:] != x["tok"][:-1]
        alone[:-1] &= x["tok"][1:] != x["tok"][:-1]
        x = x[~alone]
        x = x[np.lexsort((x["line"], x["doc"], x["tok"]))]
        i, j, more = candidates(x, bits, percent, tried, None if open_ is None else in_bitmap(open_.value, name_of(x["doc"], x["line"]))) if len(x) else (_NOTHING, _NOTHING, np.empty(0, bool))
        a, b = name_of(x["doc"][i], x["line"][i]), name_of(x["doc"][j], x["line"][j])
        one = np.unique(mix(a.view(np.uint64) + mix(b.view(np.uint64))), return_index=True)[1]
        one = np.union1d(one, np.flatnonzero(more))
        i, j, a, b, more = i[one], j[one], a[one], b[one], more[one]
        # In thousandths of the words of both sets: by how many, at least, the two differ.
        gap = 1000 * np.bitwise_count(x["sketch"][i] ^ x["sketch"][j]).sum(axis=1, dtype=np.int64) // (x["n"][i].astype(np.int64) + x["n"][j])
        return pa.table({"name": a, "doc": x["doc"][i], "line": x["line"][i].astype(np.int64), "name2": b, "doc2": x["doc"][j], "line2": x["line"][j].astype(np.int64), "more": pa.array(more), "gap": pa.array(gap.astype(np.int32))})

    return run


def _words(wanted: Broadcast):
    """Words of the lines that the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, line, text in _units(batches):
            rows, text = _lines(text, in_bitmap(wanted.value, name_of(doc, line)))
            x = Sets.read(text, len(rows))
            toks = [x.tok[a : a + n].tobytes() for a, n in zip(x.first.tolist(), x.n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(line[rows]), pa.array(toks, pa.binary())], names=["doc", "line", "toks"])

    return run


def _verify(percent: int):
    """Pairs with the words of both sets: the places of later sets whose similarity is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                left, right = ([np.frombuffer(x.as_buffer(), "<u8") for x in b.column(k)] for k in (2, 3))
                n, m = (np.array([len(x) for x in y]) for y in (left, right))
                pair = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
                tok = np.concatenate([*left, *right])
                order = np.lexsort((tok, pair))
                tok, pair = tok[order], pair[order]
                both = np.bincount(pair[1:][(tok[1:] == tok[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n))
                enough = pa.array(100 * both >= percent * (n + m - both))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(enough), b.column(1).filter(enough)], names=["doc", "line"])

    return run


def _matching(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """(doc, line): later sets of the pairs that match their earlier one."""
    # The earlier set of a family is its members' candidate: a hot key, which adaptive execution splits.
    both = pairs.select("doc", "line", "doc2", "line2").join(words.toDF("doc2", "line2", "toks2"), ["doc2", "line2"]).join(words, ["doc", "line"])
    return both.select("doc", "line", "toks", "toks2").mapInArrow(_verify(percent), "doc long, line long").distinct()


def _verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """(doc, line): later sets of the pairs that match an earlier one.

    A set of a family has a candidate in each of its lists. One match is enough, so its nearest by sketches is
    tried first, and its others only if that one does not match.
    """
    pairs = materialize(pairs.groupBy("doc", "line", "doc2", "line2").agg(F.min("gap").alias("gap")))
    nearest = pairs.groupBy("doc", "line").agg(F.min_by(F.struct("doc2", "line2"), F.struct("gap", "doc2", "line2")).alias("x")).select("doc", "line", "x.*")
    settled = materialize(_matching(nearest, words, percent))
    rest = pairs.join(settled, ["doc", "line"], "left_anti")
    late = materialize(settled.unionByName(_matching(rest, words, percent)))
    discard(pairs, settled)
    return late


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, vocabulary: int = VOCABULARY, hot: int = HOT, tried: int = TRIED) -> DataFrame:
    """One row per document: doc_id, n_lines, removed (sorted numbers of the lines to remove, from 0).

    A line is what line feeds separate. It is removed if an earlier line (smaller doc_id, or the same document
    and a smaller number) has a Jaccard similarity of at least percent / 100 over distinct lower-cased (A-Z)
    words; lines are judged on the input, not on what is left. Lines without words stay. Null or empty texts have
    one empty line. Null ids are dropped, for nothing could be earlier or later than they. Rows with one id and
    one text are one document; of rows with one id and different texts, a line number stands for all lines of
    that number, which go if any of them does. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    lean(spark)
    send = spark.sparkContext.broadcast
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("t"))
    scanned = materialize(texts.mapInArrow(_scan(4 * max(16, parts(spark))), SCAN))
    counts = materialize(scanned.where("part IS NOT NULL").select("part", "words", "n").groupBy("part").applyInArrow(_sum, "key long, n long"))
    lines = scanned.where("part IS NULL AND sig IS NOT NULL").select("sig", "doc_id", "line")
    heads = scanned.where("part IS NULL AND sig IS NULL").groupBy("doc_id").agg(F.max("line").alias("n_lines"))
    sets = materialize(lines.groupBy("sig").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count("*").alias("c")).where("c > 1"))
    release(spark)
    words, seen, histogram = _most_frequent(counts, "n", vocabulary, "key")
    # Frequent sets are posted where they stand first only; others come so rarely that a bucket can drop their repeats.
    heavy, doc, line, _, _ = _most_frequent(sets, "c", vocabulary, "sig", "at.doc_id", "at.line")
    model = send(Counts(words, np.minimum(seen, 1 << 30).astype(np.int32), bitmap_of(counts, F.col("key"), BITS), heavy, np.stack([doc, line], axis=1)))
    discard(counts)
    # About one word in five is posted.
    buckets = max(16, parts(spark), histogram * post(SMALLEST).itemsize // 5 // GROUP)
    warmest = hot if percent > 50 else float("inf")  # matching sets share two words if percent is above 50

    def pairs_of(only=None, open_=None) -> DataFrame:
        posts = texts.mapInArrow(_post(model, buckets, percent, warmest, only), "bits int, part int, posts binary")
        return materialize(posts.groupBy("bits", "part").applyInArrow(_meet(percent, tried, open_), PAIRS))

    def words_of(pairs: DataFrame) -> DataFrame:
        both = pairs.select("name", "doc").unionByName(pairs.select(F.col("name2").alias("name"), F.col("doc2").alias("doc")))
        few = [r.doc for r in both.select("doc").distinct().limit(FEW + 1).collect()]
        some = texts.where(F.col("doc_id").isin(few)) if len(few) <= FEW else texts
        words = some.mapInArrow(_words(send(bitmap_of(both, F.col("name"), BITS))), "doc long, line long, toks binary")
        return materialize(words.dropDuplicates(["doc", "line"]))  # repeated rows have them twice

    pairs = pairs_of()
    release(spark)
    words = words_of(pairs)
    late = _verified(pairs, words, percent)
    release(spark)
    open_ = materialize(pairs.where("more").select("name", "doc", "line").distinct().join(late, ["doc", "line"], "left_anti"))
    discard(pairs)
    if open_.limit(1).count():
        keys = words.join(open_, ["doc", "line"]).select("toks").mapInArrow(_open_keys(model, percent, warmest), "key long")
        rest = pairs_of(send(bitmap_of(keys, F.col("key"), BITS)), send(bitmap_of(open_, F.col("name"), BITS)))
        more = words_of(rest)
        late = late.unionByName(_verified(rest, more, percent))
        discard(rest, more)
    discard(words, open_)
    # A set stays where it stands first, if it has no earlier match there.
    again = lines.join(sets, "sig").where("at.doc_id <> doc_id OR at.line <> line").select("doc_id", "line")
    gone = again.unionByName(late.select(F.col("doc").alias("doc_id"), "line")).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    return heads.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))


def _most_frequent(rows: DataFrame, count: str, most: int, key: str, *more: str) -> tuple:
    """key, further columns and count of the rows with the greatest counts, `most` at most, in order of key; the sum of all counts."""
    band = F.floor(4 * F.log2(count))
    kinds = rows.groupBy(band.alias("band")).agg(F.count("*").alias("kinds"), F.sum(count).alias("n")).collect()
    least, held = 1 << 30, 0
    for at, n, _ in sorted(kinds, reverse=True):
        if held + n > most:
            break
        least, held = at, held + n
    listed = rows.where(band >= least).select(key, *(F.col(c).alias(f"c{i}") for i, c in enumerate(more)), count).toArrow()
    columns = [np.asarray(c).astype(np.int64) for c in listed.columns]
    order = np.argsort(columns[0])
    return (*(c[order] for c in columns), sum(r.n for r in kinds))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs, all columns and rows, with the text less its removed lines; null texts stay null, rows with null ids are as they were."""
    gone = removed_lines(docs, id_col, text_col, percent).where(F.size("removed") > 0).select(F.col("doc_id").alias("_id"), F.col("removed").alias("_removed"))
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains("_removed", i.cast("long"))), "\n")
    out = docs.join(gone, docs[id_col].cast("long") == F.col("_id"), "left")
    return out.withColumn(text_col, F.when(F.col("_id").isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)
