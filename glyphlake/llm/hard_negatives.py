"""Hard negatives by vantage-point trees over norm-augmented vectors.

A row x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, an anchor a 0 there. Then
|a - x|^2 = |a|^2 + M^2 - 2 <a, x>: higher scores are nearer, and a window of scores is a ring of distances.

The top of the tree is built on a bounded sample and cuts space into regions; every row is dealt to its region, and
the least and largest distance of a region's rows from each vantage point above it are taken from all rows. Regions are split into
blocks of bounded size, each with a tree of its own. An anchor first searches its own block, whose best rows narrow
its rings, then every block of the regions that its rings can touch. Inside a block leaves are visited nearest first,
until k rows of every ring are nearer than the next leaf. Bounds are floats with slack; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, parts, trim
from .tally import bounded

#: Components become floor(GRID * x).
GRID = 256
#: Rows that the top of the tree is built on, and regions, at most; both are fewer for long vectors (BYTES).
SAMPLE, REGIONS = 16_384, 2048
#: Rows of a block and of a leaf, at most.
BLOCK, LEAF = 8192, 128
BYTES = 1 << 25
#: Slack of a bound, as a share of M.
SLACK = 1e-6
_WIDE = 2**62


def _padded(vectors: list[bytes], dims: int) -> np.ndarray:
    """Vectors (little-endian 64-bit integers) as rows of `dims` components, the missing ones 0."""
    if vectors and all(len(v) == 8 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        x = np.frombuffer(v, "<i8")[:dims]
        row[: len(x)] = x
    return out


def _kind(norm: float, other: float) -> type:
    """A type in which inner products of vectors of such squared norms are exact, the fastest first."""
    most = (norm * other) ** 0.5
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


@dataclass
class Tree:
    """A vantage-point tree as a heap: node k has the halves 2k + 1, the nearer one, and 2k + 2."""

    levels: int
    points: np.ndarray  # vantage points of the inner nodes, plain coordinates
    norms: np.ndarray  # their squared norms
    cuts: np.ndarray  # distance at which a node's rows are halved
    top: float  # M^2

    @classmethod
    def of(cls, x: np.ndarray, levels: int, top: float) -> tuple[Tree, list[np.ndarray]]:
        """The tree of rows x, and the rows of each leaf."""
        nodes = [np.arange(len(x))]
        points, cuts = [], []
        for _ in range(levels):
            halves = []
            for rows in nodes:
                v = x[rows[len(rows) // 2]] if len(rows) else np.zeros(x.shape[1], x.dtype)
                d = between(x[rows], v[None], top)[:, 0]
                rows = rows[np.argsort(d, kind="stable")]
                half = len(rows) // 2
                points.append(v)
                cuts.append(np.partition(d, half)[half] if len(rows) else 0.0)
                halves += [rows[:half], rows[half:]]
            nodes = halves
        points = np.array(points, np.int64).reshape(len(points), x.shape[1])
        return cls(levels, points, (points.astype(np.float64) ** 2).sum(axis=1), np.array(cuts), top), nodes

    def above(self) -> np.ndarray:
        """For each leaf, the inner node at each level."""
        leaf = np.arange(1 << self.levels)
        return np.array([(1 << k) - 1 + (leaf >> (self.levels - k)) for k in range(self.levels)], np.int64).reshape(self.levels, len(leaf)).T

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distance from each vantage point on the way."""
        node, path = np.zeros(len(x), np.int64), np.empty((len(x), self.levels))
        x = x.astype(np.float64)
        room = np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0))
        for k in range(self.levels):
            near = np.einsum("nd,nd->n", x, self.points[node]) + room * np.sqrt(np.maximum(self.top - self.norms[node], 0))
            path[:, k] = np.sqrt(np.maximum(2 * self.top - 2 * near, 0))
            node = 2 * node + 1 + (path[:, k] >= self.cuts[node])
        return node - ((1 << self.levels) - 1), path

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of each query from the rows of each leaf; low, high: (leaf, level) distances of the leaf's rows."""
        q = queries.astype(np.float64)
        norms = (q**2).sum(axis=1)
        d = np.sqrt(np.maximum(norms[:, None] + self.top - 2 * (q @ self.points.T.astype(np.float64)), 0))
        least, most = np.zeros((len(q), len(low))), np.full((len(q), len(low)), np.inf)
        for k, node in enumerate(self.above().T):
            np.maximum(least, low[:, k] - d[:, node], out=least)
            np.maximum(least, d[:, node] - high[:, k], out=least)
            np.minimum(most, d[:, node] + high[:, k], out=most)
        return least, most


def between(x: np.ndarray, y: np.ndarray, top: float) -> np.ndarray:
    """Distances of augmented rows."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    room = lambda v: np.sqrt(np.maximum(top - (v**2).sum(axis=1), 0))
    return np.sqrt(np.maximum(2 * top - 2 * (x @ y.T) - 2 * np.outer(room(x), room(y)), 0))


class Block:
    """The rows of a block under a tree of their own."""

    def __init__(self, rows: list[tuple], top: float):
        self.top, self.rid, self.ids = top, np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        labels = {x: i for i, x in enumerate(dict.fromkeys(r[2] for r in rows))}
        self.labels, self.label = labels, np.array([labels[r[2]] for r in rows])
        self.dims = max(len(r[3]) // 8 for r in rows)
        x = _padded([r[3] for r in rows], self.dims)
        self.norm = float(max(r[4] for r in rows))
        self.tree, leaves = Tree.of(x, max(0, (-(-len(rows) // LEAF) - 1).bit_length()), top)
        order, sizes = np.concatenate(leaves), np.array([len(s) for s in leaves])
        self.cut = np.concatenate([[0], np.cumsum(sizes)])
        path = self._paths(x, order)
        at = np.minimum(self.cut[:-1], len(rows) - 1)
        self.low, self.high = np.minimum.reduceat(path, at, axis=0), np.maximum.reduceat(path, at, axis=0)
        self.low[sizes == 0], self.high[sizes == 0] = np.inf, -np.inf  # nothing is there
        self.x, self.rid, self.ids, self.label = x[order], self.rid[order], self.ids[order], self.label[order]
        self.as_kind: dict[type, np.ndarray] = {}
        self.visited = 0  # leaves that were read

    def _paths(self, x: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Distances of the rows, leaf by leaf, from the vantage points above their leaf."""
        d = between(x[order], self.tree.points, self.top)
        node = np.repeat(self.tree.above(), np.diff(self.cut), axis=0)
        return np.take_along_axis(d, node, axis=1)

    def search(self, queries: list[tuple], same: bool, k: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(query's rid, ring, score, id, rid): the first k rows of every ring of each query, of its label or of others."""
        q = _padded([x[3] for x in queries], self.dims)
        kind = _kind(self.norm, float(max(x[4] for x in queries)))
        rows = self.as_kind.setdefault(kind, self.x.astype(kind))
        slack = SLACK * self.top**0.5
        for (rid, _, label, _, norm, lows, highs), v, least, most in zip(queries, q.astype(kind), *self.tree.bounds(q, self.low, self.high), strict=True):
            rings = [(i, a, b) for i, (a, b) in enumerate(zip(lows, highs, strict=True)) if a <= b]
            if not rings:
                continue
            a, b = min(r[1] for r in rings), max(r[2] for r in rings)
            far = lambda s, n=norm: max(n + self.top - 2 * s, 0) ** 0.5
            leaves = np.flatnonzero((least <= far(a) + slack) & (most >= far(b) - slack))
            leaves = leaves[np.argsort(least[leaves], kind="stable")]
            mine = self.labels.get(label, -1)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            open_ = rings
            for i, leaf in enumerate(leaves.tolist()):
                self.visited += 1
                s = slice(self.cut[leaf], self.cut[leaf + 1])
                score = (rows[s] @ v).astype(np.int64)
                ok = np.flatnonzero((score >= a) & (score <= b) & ((self.label[s] == mine) == same) & (self.rid[s] != rid))
                if len(ok):
                    held.append((score[ok], ok + self.cut[leaf]))
                if i + 1 == len(leaves):
                    break
                # What is nearer than all that is left is settled; a ring with k such rows, or behind which all that is left lies, is done.
                next_ = max(least[leaves[i + 1]] - slack, 0)
                settled = (norm + self.top - next_ * next_) / 2
                open_ = [r for r in open_ if far(r[1]) + slack >= next_ and sum(np.count_nonzero((x > settled) & (x >= r[1]) & (x <= r[2])) for x, _ in held) < k]
                if not open_:
                    break
            if held:
                score, at = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((self.rid[at], self.ids[at], -score))
                score, at = score[order], at[order]
                for ring, a, b in rings:
                    for j in np.flatnonzero((score >= a) & (score <= b))[:k].tolist():
                        yield rid, ring, int(score[j]), int(self.ids[at[j]]), int(self.rid[at[j]])


_ROW = ["rid", "id", "label", "vec", "norm"]
_FOUND = "arid long, ring int, score long, id long, rid long"


def _rows(batch: pa.RecordBatch, names: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True))


def _searched(blocks: DataFrame, queries: DataFrame, top: float, same: bool, k: int) -> DataFrame:
    """The queries (region, piece, …, lo, hi) against their blocks: a task holds one block and its queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            asked: list[tuple] = []
            found: list[tuple] = []
            for r in _rows(batch, ["region", "piece", *_ROW, "lo", "hi"]):
                if r[:2] != at:
                    if asked:
                        found += block.search(asked, same, k)
                    at, held, block, asked = r[:2], [], None, []
                if r[7] is None:
                    held.append(r[2:7])
                elif held:
                    block = block or Block(held, top)
                    asked.append(r[2:])
            if asked:
                found += block.search(asked, same, k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["arid", "ring", "score", "id", "rid"])
        trim()

    none = F.lit(None).cast("array<long>")
    both = blocks.select("region", "piece", *_ROW, none.alias("lo"), none.alias("hi")).unionByName(queries.select("region", "piece", *_ROW, "lo", "hi"))
    both = both.repartition(parts(blocks.sparkSession), "region", "piece").sortWithinPartitions("region", "piece", F.col("lo").isNotNull(), "rid")
    return both.mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each ring."""
    order = Window.partitionBy("arid", "ring").orderBy(F.desc("score"), "id", "rid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _floor(a: Column, b: int) -> Column:
    """floor(a / b) of exact decimals, as long."""
    rest = a % F.lit(b).cast("decimal(19,0)")
    return ((a - rest) / F.lit(b)).cast("decimal(38,0)").cast("long") - F.when(rest < 0, 1).otherwise(0)


def hard_negatives(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is a multiple of `every`. An anchor's positives are the first rows of its label but
    itself, by score (the inner product of the vectors, in steps of 1 / GRID), then id. For each positive the first rows of other labels
    follow whose score is from `low` to `high` percent of the positive's; a negative positive_score has none.

    Rows without id or label, and rows whose vector is null, empty of numbers at some place or not finite, take no part,
    nor do those whose squared norm exceeds 2^62, for their scores would not fit a long. Vectors of unequal length
    are filled with zeros. Each of repeated rows counts: an anchor's copies are among its positives. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    lean(spark)
    bounded(spark)

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
            ends = np.cumsum(np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            keep, vecs, norms = [], [], []
            for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)):
                with np.errstate(over="ignore"):
                    x = np.floor(flat[a:b] * GRID)
                    norm = float(x @ x)
                if lists[i].is_valid and norm <= _WIDE * 0.999:  # false for what is not finite
                    keep.append(i)
                    vecs.append(x.astype("<i8").tobytes())
                    norms.append(int(norm))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(vecs, pa.binary()), pa.array(norms, pa.int64())], names=["id", "label", "vec", "norm"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.mapInArrow(prepared, "id long, label string, vec binary, norm long").withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows)
    size = rows.agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max(F.octet_length("vec")).alias("bytes")).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size.n:
        return spark.createDataFrame([], shape)

    # The top of the tree, on a bounded sample; the number of its regions follows the rows as far as the sample goes.
    top, dims = float(size.top), max(1, size.bytes // 8)
    sample, block = max(1, min(sample, BYTES // (8 * dims))), max(1, min(block, BYTES // (8 * dims)))
    some = [r.vec for r in rows.orderBy(F.xxhash64("rid"), "rid").limit(sample).select("vec").collect()]
    levels = min((-(-size.n // block) - 1).bit_length(), (REGIONS - 1).bit_length(), max(0, (len(some) // 8).bit_length() - 1))
    tree = Tree.of(_padded(some, dims), levels, top)[0]
    del some
    sent = spark.sparkContext.broadcast(tree)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, path = sent.value.walk(_padded(batch.column(batch.schema.get_field_index("vec")).to_pylist(), dims))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in _ROW]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(region, pa.int32()), pa.array(list(path), pa.list_(pa.float64()))], names=[*_ROW, "region", "path"])

    shape_of_row = "rid long, id long, label string, vec binary, norm long"
    rows = materialize(rows.select(*_ROW).mapInArrow(dealt, f"{shape_of_row}, region int, path array<double>"))
    ends = [f(F.get("path", F.lit(k))).alias(f"{name}{k}") for k in range(levels) for f, name in ((F.min, "a"), (F.max, "b"))]
    regions = rows.groupBy("region").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"), *ends)
    low_at, high_at, pieces = np.full((1 << levels, levels), np.inf), np.full((1 << levels, levels), -np.inf), np.zeros(1 << levels, np.int64)
    for r in regions.collect():  # REGIONS rows at most
        pieces[r.region] = r.pieces
        for k in range(levels):
            low_at[r.region, k], high_at[r.region, k] = r[f"a{k}"], r[f"b{k}"]
    count = F.get(F.array(*map(F.lit, pieces.tolist())), F.col("region"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("rid"), count).cast("int")).drop("path")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each anchor for every block but its own that its rings can touch."""
        slack = SLACK * top**0.5
        for batch in batches:
            c = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            least, most = sent.value.bounds(_padded(c["vec"].to_pylist(), dims), low_at, high_at)
            at, region, piece = [], [], []
            for i, (home, own, norm, lows, highs) in enumerate(_rows(batch, ["region", "piece", "norm", "lo", "hi"])):
                rings = [(a, b) for a, b in zip(lows, highs, strict=True) if a <= b]
                if not rings:
                    continue
                far = lambda s, n=norm: max(n + top - 2 * s, 0) ** 0.5
                near = np.zeros(len(pieces), bool)
                for a, b in rings:
                    near |= (least[i] <= far(a) + slack) & (most[i] >= far(b) - slack)
                for r in np.flatnonzero(near & (pieces > 0)).tolist():
                    for p in range(pieces[r]):
                        if (r, p) != (home, own):
                            at.append(i)
                            region.append(r)
                            piece.append(p)
                if len(at) >= 4096:
                    yield out(c, at, region, piece)
                    at, region, piece = [], [], []
            yield out(c, at, region, piece)

    def out(c: dict[str, pa.Array], at: list[int], region: list[int], piece: list[int]) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        names = [*_ROW, "lo", "hi"]
        return pa.RecordBatch.from_arrays([pa.array(region, pa.int32()), pa.array(piece, pa.int32()), *(c[n].take(take) for n in names)], names=["region", "piece", *names])

    def nearest(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """First an anchor's own block, whose k best rows narrow its rings, then the others."""
        home = materialize(_searched(rows, asked, top, same, k))
        full = home.groupBy("arid", "ring").agg(F.count("*").alias("c"), F.min("score").alias("least")).where(F.col("c") == k)
        full = full.groupBy("arid").agg(F.map_from_entries(F.collect_list(F.struct("ring", "least"))).alias("least"))  # one entry a ring
        narrowed = asked.join(full, asked.rid == full.arid, "left").withColumn("lo", F.transform("lo", lambda x, i: F.greatest(x, F.element_at("least", i))))
        narrowed = narrowed.select("region", "piece", *_ROW, "lo", "hi")
        rest = narrowed.mapInArrow(routed, f"region int, piece int, {shape_of_row}, lo array<long>, hi array<long>")
        return materialize(_first(home.unionByName(_searched(rows, rest, top, same, k)), k))

    anchors = rows.where(F.col("id") % every == 0)
    whole = lambda x: F.array(F.lit(x).cast("long"))
    liked = nearest(anchors.withColumn("lo", whole(-_WIDE)).withColumn("hi", whole(_WIDE)), True, positives)
    liked = liked.select("arid", (F.col("place") - 1).alias("ring"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    percent = lambda x, p: x.cast("decimal(20,0)") * F.lit(p).cast("decimal(10,0)")
    score = F.col("positive_score")
    rings = liked.select("arid", F.struct("ring", (-_floor(-percent(score, low), 100)).alias("lo"), _floor(percent(score, high), 100).alias("hi")).alias("x"))
    rings = rings.groupBy("arid").agg(F.array_sort(F.collect_list("x")).alias("x"))  # as many as positives
    asked = anchors.join(rings, anchors.rid == rings.arid).select("region", "piece", *_ROW, F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    unlike = nearest(asked, False, negatives).select("arid", "ring", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = unlike.join(liked, ["arid", "ring"]).join(anchors.select(F.col("rid").alias("arid"), F.col("id").alias("anchor_id")), "arid")
    return found.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
