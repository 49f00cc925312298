"""Exact substring dedup: removes every byte of a 100-byte string that also starts earlier.

Suffixes that start with the same 100 bytes must be found, corpus-wide, without shuffling every position. As in
difference-cover construction, a cover sample of the positions is sorted and its ranks stand for the other suffixes;
here the cover is chosen by content: of the k-mers in each 100-byte window the one with the least hash. Equal
windows choose the same k-mer at the same offset, so all suffixes that tie for 100 bytes meet in the bucket of
their sample, and one sample in some thirty positions is all that travels. A sample owns the windows that chose
it, which are consecutive.

1. Samples, with a hash of all the text that their windows cover, are dealt to buckets by k-mer. A sample that
   meets only different k-mers is done. One whose covered text occurred earlier (128 bits of hashes and the shape
   agree) loses all its windows.
2. Only where a k-mer occurs with different surroundings are the windows looked at one by one: the first sample
   of each surrounding sends its covered text (at most 168 bytes). A bucket is sorted one block of k-mers at a
   time: the samples' texts to the right, and those to the left read backwards, are ranked once, with the common
   prefix of neighbours in the order. Two suffixes at equal offset from their samples tie for 100 bytes if the
   ranks lie in one run of long enough common prefixes on both sides. No suffix itself is sorted or stored.
   K-mers with very many surroundings are dealt once more, by the nearest bytes on one side.
3. Documents are joined with what they lose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, BYTE_CODE, discard, lean, materialize, mix, parts, powers, release, text_of, trim
from .words import blobs_of, dealt

LENGTH = 100
K = 32
WIDTH = LENGTH - K + 1
CHUNK = 1 << 20
POSITION = np.uint64((1 << 24) - 1)
#: A k-mer with more different surroundings is dealt by k-mer and the nearest bytes.
HOT = 4000
#: Windows that reach back at least so far from their sample go with its left side, others with its right side.
HALF = WIDTH // 2


class Roll:
    """Hashes of any substring of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, BASE_INV)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def samples(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, k-mer hash, covered-text hash, first window, further windows and offset of each sample."""
    n = len(data)
    none = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < LENGTH:
        return none
    roll = Roll(data)
    at = np.arange(n - K + 1)
    h = roll.of(at, at + K)
    # The least hash of each window, leftmost among equals: the position is in the low bits.
    m = (h & ~POSITION) | at.astype(np.uint64)
    width = 1
    while 2 * width <= WIDTH:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = WIDTH - width
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    doc = np.searchsorted(ends, np.arange(len(m)), side="right")
    p = np.flatnonzero(np.arange(len(m)) + LENGTH <= ends[doc])
    if not len(p):
        return none
    chosen = (m[p] & POSITION).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (p[1:] != p[:-1] + 1)]))
    p1, p2, a = p[new], p[np.append(new[1:], len(p)) - 1], chosen[new]
    span, off = p2 - p1, a - p1
    covered = mix(roll.of(p1, p2 + LENGTH) + (span * 128 + off).astype(np.uint64))
    doc = doc[p1]
    begin = np.concatenate([[0], ends[:-1]])
    return doc, h[a], covered, p1 - begin[doc], span, off


def _units(batches: Iterator[pa.RecordBatch], *more: int) -> Iterator[tuple]:
    """Lists of ids, texts (bytes) and further columns, of about CHUNK bytes; a longer text is a unit of its own."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in (0, 1, *more)]
        for r in range(batch.num_rows):
            row = [c[r].as_py() for c in columns]
            if size + len(row[1]) > CHUNK and held:
                yield tuple(map(list, zip(*held, strict=True)))
                held, size = [], 0
            held.append(row)
            size += len(row[1])
    if held:
        yield tuple(map(list, zip(*held, strict=True)))
    trim()


def _pieces(ids: list, texts: list[bytes], step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, bytes, ends and offsets; a text beyond `step` comes in pieces that overlap by LENGTH - 1, so that each window is in one."""
    if len(texts) == 1 and len(texts[0]) > step:
        data = np.frombuffer(texts[0], np.uint8)
        for at in range(0, len(data) - LENGTH + 1, step):
            piece = data[at : at + step + LENGTH - 1]
            yield np.array(ids, np.int64), piece, np.array([len(piece)]), np.array([at])
    else:
        yield np.array(ids, np.int64), np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), np.zeros(len(ids), np.int64)


SAMPLES = "part int, docs binary, doc binary, key binary, cover binary, p binary, span binary, off binary"


def _deal(buckets: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _units(batches):
            for names, data, ends, shift in _pieces(ids, texts, step):
                doc, key, cover, p, span, off = samples(data, ends)
                p = p + shift[doc]
                part = (key % np.uint64(buckets)).astype(np.int32)
                order, spans = dealt(part)
                part, doc, key, cover, p, span, off = (x[order] for x in (part, doc, key, cover, p, span, off))
                out = []
                for a, b in spans:
                    have, local = np.unique(doc[a:b], return_inverse=True)
                    out.append((int(part[a]), names[have].astype("<i8").tobytes(), local.astype("<u4").tobytes(), key[a:b].tobytes(), cover[a:b].tobytes(), p[a:b].astype("<i8").tobytes(), span[a:b].astype(np.uint8).tobytes(), off[a:b].astype(np.uint8).tobytes()))
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], names=["part", "docs", "doc", "key", "cover", "p", "span", "off"])

    return run


WANT = np.dtype([("key", "<u8"), ("p", "<i8"), ("span", "u1"), ("off", "u1"), ("hot", "?")])


def _by_doc(doc: np.ndarray, rows: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(doc, kind="stable")
    doc, rows = doc[order], rows[order]
    cut = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
    return {int(doc[a]): rows[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False) if b > a}


def _meet(hot: int):
    """One bucket of samples: per document, byte ranges to remove and samples to look at."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in blobs_of(table, name))])
        key = get("key", "<u8")
        order = np.argsort(key)
        many = np.zeros(len(key), bool)
        same = key[order[1:]] == key[order[:-1]]
        many[order[1:][same]] = many[order[:-1][same]] = True
        del order, same
        key, cover, p, span, off = key[many], get("cover", "<u8")[many], get("p", "<i8")[many], get("span", "u1")[many], get("off", "u1")[many]
        doc = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(d, "<i8")[np.frombuffer(i, "<u4")] for d, i in zip(blobs_of(table, "docs"), blobs_of(table, "doc"), strict=True))])[many]
        del table, many
        shape = span.astype(np.int64) * 128 + off
        order = np.lexsort((p, doc, shape, cover, key))
        doc, key, cover, p, span, off, shape = (x[order] for x in (doc, key, cover, p, span, off, shape))
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        first = new_key.copy()
        first[1:] |= (cover[1:] != cover[:-1]) | (shape[1:] != shape[:-1])
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.empty(0, np.int64)
        late = (doc != doc[lead]) | (p != p[lead])
        ranges = np.stack([p[late], p[late] + span[late] + LENGTH], axis=1).astype("<i8")
        gone = _by_doc(doc[late], ranges)
        kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1] if len(first) else np.empty(0, np.int64)
        ask = first & (kinds > 1)
        want = np.empty(int(ask.sum()), WANT)
        want["key"], want["p"], want["span"], want["off"], want["hot"] = key[ask], p[ask], span[ask], off[ask], kinds[ask] > hot
        wanted = _by_doc(doc[ask], want)
        ids = sorted(gone.keys() | wanted.keys())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "gone": pa.array([gone.get(i) for i in ids], pa.binary()), "want": pa.array([wanted.get(i) for i in ids], pa.binary())})

    return run


def _halves(w: np.ndarray, text: bytes) -> np.ndarray:
    """Hot samples as two each: windows that hold HALF bytes to the left of their sample, and the others, which hold enough to its right."""
    hot = w[w["hot"]]
    if not len(hot):
        return w
    out = [w[~w["hot"]]]
    for x in hot:
        at, off, span = int(x["p"]) + int(x["off"]), int(x["off"]), int(x["span"])
        cut = max(0, off - HALF + 1)  # so many of its windows hold the left bytes
        for skip, n, side in ((0, min(cut, span + 1), text[at - HALF : at]), (cut, span + 1 - cut, text[at : at + LENGTH - HALF + 1])):
            if n > 0:
                half = x.copy().reshape(1)
                near = int.from_bytes(hashlib.blake2b(side, digest_size=8).digest(), "little")
                half["key"] = mix(half["key"] + np.uint64(near))
                half["p"], half["span"], half["off"] = int(x["p"]) + skip, n - 1, off - skip
                out.append(half)
    return np.concatenate(out)


def _send(buckets: int):
    """(doc, text, lists of WANT) to the covered texts of the wanted samples, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, wants in _units(batches, 2):
            w = [_halves(np.unique(np.frombuffer(b"".join(x), WANT)), t) for x, t in zip(wants, texts, strict=True)]
            doc = np.repeat(np.array(ids, np.int64), [len(x) for x in w])
            w, owner = np.concatenate(w), np.repeat(np.arange(len(ids)), [len(x) for x in w])
            part = (w["key"] % np.uint64(buckets)).astype(np.int32)
            order, spans = dealt(part)
            part, doc, w, owner = part[order], doc[order], w[order], owner[order]
            begin, size = w["p"].tolist(), (w["span"].astype(np.int64) + LENGTH).tolist()
            owner, out = owner.tolist(), []
            for a, b in spans:
                cover = b"".join([texts[owner[i]][begin[i] : begin[i] + size[i]] for i in range(a, b)])
                out.append((int(part[a]), doc[a:b].astype("<i8").tobytes(), w[a:b].tobytes(), cover))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], names=["part", "doc", "want", "cover"])

    return run


def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row of bytes in their order, and the length of the common prefix of each rank with the one before."""
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows
    order = np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1]) if n else np.empty(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    other = rows[order[1:]] != rows[order[:-1]]
    return rank, np.where(other.any(axis=1), other.argmax(axis=1), width) if n > 1 else np.empty(0, np.int64)


def late_windows(text: np.ndarray, begin: np.ndarray, doc: np.ndarray, p: np.ndarray, span: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of the windows of some samples that equal an earlier one. begin: where a sample's covered text is."""
    m, at = len(begin), begin + off
    padded = np.concatenate([np.zeros(WIDTH, np.uint8), text, np.zeros(LENGTH, np.uint8)])
    reach = np.arange(LENGTH)
    right = np.where(reach < (span + LENGTH - off)[:, None], padded[WIDTH + at[:, None] + reach], 0).astype(np.uint8)
    reach = np.arange(WIDTH - 1)
    left = np.where(reach < off[:, None], padded[WIDTH - 1 + at[:, None] - reach], 0).astype(np.uint8)
    (right, right_common), (left, left_common) = ranked(right), ranked(left)
    docs, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for back in range(WIDTH):  # bytes of a window to the left of its sample
        mine = np.flatnonzero((off >= back) & (off - back <= span))
        if len(mine) < 2:
            continue
        # Runs of ranks with enough common bytes on the right and on the left.
        a = np.concatenate([[0], np.cumsum(right_common < LENGTH - back)])[right[mine]]
        b = np.concatenate([[0], np.cumsum(left_common < back)])[left[mine]]
        run = a * m + b
        order = np.argsort(run)
        tied = np.zeros(len(run), bool)
        same = run[order[1:]] == run[order[:-1]]
        tied[order[1:][same]] = tied[order[:-1][same]] = True
        mine, run = mine[tied], run[tied]
        d, q = doc[mine], p[mine] + off[mine] - back
        order = np.lexsort((q, d, run))
        d, q, run = d[order], q[order], run[order]
        new = np.concatenate([[True], run[1:] != run[:-1]])[: len(run)]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(run) else np.empty(0, np.int64)
        late = (d != d[lead]) | (q != q[lead])
        docs.append(d[late]), places.append(q[late])
    return np.concatenate(docs), np.concatenate(places)


def _resolve(table: pa.Table) -> pa.Table:
    """One bucket of covered texts, a block of k-mers at a time: windows that equal an earlier one, as byte ranges."""
    doc = np.concatenate([np.frombuffer(x, "<i8") for x in blobs_of(table, "doc")])
    want = np.concatenate([np.frombuffer(x, WANT) for x in blobs_of(table, "want")])
    data = np.frombuffer(b"".join(blobs_of(table, "cover")), np.uint8)
    del table
    size = want["span"].astype(np.int64) + LENGTH
    begin = np.cumsum(size) - size
    order = np.argsort(want["key"], kind="stable")
    total = np.cumsum(size[order])
    ends = np.append(np.flatnonzero(want["key"][order[1:]] != want["key"][order[:-1]]) + 1, len(order))
    out_doc, out_range, lo = [], [], 0
    while lo < len(order):  # whole k-mers, of about CHUNK bytes
        hi = int(ends[np.searchsorted(ends, min(len(order), np.searchsorted(total, total[lo] + CHUNK)))])
        rows = order[lo:hi]
        lo = hi
        text = np.concatenate([data[a:b] for a, b in zip(begin[rows].tolist(), (begin + size)[rows].tolist(), strict=True)])
        d, q = late_windows(text, np.cumsum(size[rows]) - size[rows], doc[rows], want["p"][rows], size[rows] - LENGTH, want["off"][rows].astype(np.int64))
        out_doc.append(d), out_range.append(q)
    d, q = np.concatenate(out_doc), np.concatenate(out_range)
    by = np.lexsort((q, d))
    d, q = d[by], q[by]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (q[1:] > q[:-1] + LENGTH)
    starts = np.flatnonzero(new)
    merged = np.stack([q[starts], q[np.append(starts[1:], len(q))[: len(starts)] - 1] + LENGTH], axis=1).astype("<i8")
    gone = _by_doc(d[starts], merged)
    return pa.table({"doc_id": pa.array(list(gone), pa.int64()), "gone": pa.array(list(gone.values()), pa.binary())})


def ranges_of(gone: list[bytes] | None) -> np.ndarray:
    """Maximal byte ranges [start, stop) of a union of ranges."""
    r = np.frombuffer(b"".join(gone or []), "<i8").reshape(-1, 2)
    if not len(r):
        return r
    r = r[np.argsort(r[:, 0], kind="stable")]
    stop = np.maximum.accumulate(r[:, 1])
    new = np.ones(len(r), bool)
    new[1:] = r[1:, 0] > stop[:-1]
    at = np.flatnonzero(new)
    return np.stack([r[at, 0], stop[np.append(at[1:], len(r)) - 1]], axis=1)


def kept_bytes(text: bytes, ranges: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in ranges.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, gone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = text.as_py()
            r = ranges_of(gone)
            rows.append((len(data), int((r[:, 1] - r[:, 0]).sum()), len(r), hashlib.sha256(kept_bytes(data, r)).hexdigest()))
        n, removed, spans, sha = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("t"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = CHUNK, hot: int = HOT) -> DataFrame:
    """(doc_id, gone): byte ranges to remove, as arrays of packed 64-bit pairs; only documents that lose any.

    Longer texts are read in pieces of `step` bytes; k-mers with more than `hot` surroundings are dealt more finely.
    """
    spark = docs.sparkSession
    lean(spark)
    buckets = 4 * max(16, parts(spark))
    texts = _texts(docs, id_col, text_col).where("doc_id IS NOT NULL").where(F.octet_length("t") >= LENGTH)
    met = materialize(texts.mapInArrow(_deal(buckets, step), SAMPLES).groupBy("part").applyInArrow(_meet(hot), "doc_id long, gone binary, want binary"))
    release(spark)
    wants = met.where("want IS NOT NULL").groupBy("doc_id").agg(F.collect_list("want").alias("w"))
    sent = texts.join(wants, "doc_id").mapInArrow(_send(buckets), "part int, doc binary, want binary, cover binary")
    more = materialize(sent.groupBy("part").applyInArrow(_resolve, "doc_id long, gone binary"))
    release(spark)
    gone = materialize(met.where("gone IS NOT NULL").select("doc_id", "gone").unionByName(more).groupBy("doc_id").agg(F.collect_list("gone").alias("gone")))
    discard(met, more)
    release(spark)
    return gone


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = CHUNK, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null an empty one; texts of fewer than 100 bytes lose nothing. Rows with one doc_id
    are one document: a string that stands at one place of several of them is one occurrence, and a range that any
    of them loses all lose, as far as their texts reach. A null id neither matches nor loses anything. An empty
    table gives no rows; other columns are not read.
    """
    gone = repeated_ranges(docs, id_col, text_col, step, hot)
    return _texts(docs, id_col, text_col).join(gone, "doc_id", "left").select("doc_id", "t", "gone").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
