"""Best-fit packing by a configuration linear program over the length histogram.

Texts are tokenized once, in Arrow batches; what is kept of a document is a narrow row per piece. The histogram
of piece lengths (at most `capacity` rows, whatever the input) goes to the driver. There the covering program
    min sum(x_c)  subject to  sum(c_l * x_c) >= n_l  for every length l
is solved by multiplicative weights: a length's weight falls exponentially with the share of it that is covered, and
each round a knapsack dynamic program prices all configurations. For every length that lags behind, the dearest
configuration that holds it is bought. Weights over the dearest configuration's value are a dual solution, so each
round also bounds the program from below. The solution is rounded down; what is left is solved again, and then its
full configurations are rounded up as long as pieces for them are left. The last pieces go best fit, longest first.
The program is run twice, with weights that change a length's price freely and with weights that only decide
between equally full configurations; the better plan counts.

A plan is a list of slots; the executors place the pieces of a length into its slots by their rank, which is
counted in hashed buckets, so no length meets in one task.
"""

from __future__ import annotations

import base64
import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, parts, text_of

CAPACITY = 1024
END = 2
#: Entries of a worker's table of word tokens before it is emptied; bounds its memory.
CACHE = 400_000
#: Rounds of a solution, the learning rate, and how often what is left is solved again.
ROUNDS, STEP, PASSES = 120, 0.5, 3
SPECIAL = "<|endoftext|>"


class ByteBpe:
    """Token ids of the byte-level vocabulary as packed little-endian 32-bit integers.

    Where no two white-space characters meet, the vocabulary's own pre-tokenizer never joins what a single
    space separates, so each space-led word is encoded alone and remembered. Other texts are encoded whole,
    those that spell the special token by the `tokenizers` library.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.json_path, self._slow = json_path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.runs = re.compile(r"\s\s")
        encode = self.fast.encode_ordinary

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                self[word] = out = np.array(encode(" " + word), dtype="<u4").tobytes()
                return out

        self.words = Words()

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.json_path)
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.runs.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        if len(self.words) > CACHE:
            self.words.clear()
        return np.array(self.fast.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


def vocabulary(json_path: str | None = None) -> tuple[str, str, str]:
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    return json_path, json_path.removesuffix(".json") + ".tiktoken", public_tokenizers.PATTERN


def _pieces(vocab: tuple[str, str, str], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(*vocab)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.encode(text.as_py()) + end
                n = len(data) // 4
                at = 0
                for k, size in enumerate(([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)):
                    ids.append(doc_id), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(data[at * 4 : (at + size) * 4]))
                    at += size
            for i in range(0, len(ids), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s], pa.int64()), pa.array(piece[s], pa.int32()), pa.array(start[s], pa.int64()), pa.array(length[s], pa.int64()), pa.array(crc[s], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest configuration's value, and for every room the length that the dearest way to fill it takes first; 0 where nothing fits."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        if k := fits[room]:
            worth = best[room - sizes[:k]] + value[:k]
            i = worth.argmax()
            best[room], pick[room] = worth[i], sizes[i]
    return float(best[capacity]), pick


def _configuration(anchor: int, pick: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The dearest configuration that holds the anchor, no length more often than it is in demand."""
    out, room = {anchor: 1}, capacity - anchor
    while room > 0 and (size := int(pick[room])):
        room -= size
        if out.get(size, 0) < demand[size]:
            out[size] = out.get(size, 0) + 1
    return tuple(sorted(out.items()))


def _program(left: np.ndarray, capacity: int, rounds: int, free: bool) -> tuple[dict[tuple, float], float]:
    """Configurations with their fractional numbers, and the best lower bound of the program."""
    bought: dict[tuple, float] = {}
    sizes = np.flatnonzero(left)
    covered, bound = np.zeros(capacity + 1), 0.0
    for t in range(1, rounds + 1):
        weight = np.clip(STEP * (t - 1 - rounds * covered[sizes] / left[sizes]), -4, 4)
        value = sizes * np.exp(weight) if free else sizes + np.tanh(weight) / 8
        top, pick = _knapsack(value, sizes, capacity)
        bound = max(bound, float(left[sizes] @ value) / top)
        # Until a further 1 / rounds of every length is covered, the longest first.
        for anchor in sizes[::-1]:
            need = left[anchor] * t / rounds - covered[anchor]
            if need <= 0:
                continue
            config = _configuration(int(anchor), pick, left, capacity)
            need /= dict(config)[int(anchor)]
            bought[config] = bought.get(config, 0.0) + need
            for size, copies in config:
                covered[size] += copies * need
    return bought, bound


def _take(config: tuple, times: int, left: np.ndarray, plan: Counter) -> int:
    """Moves so many of a configuration into the plan, as far as pieces are left; how many."""
    times = min(times, *(int(left[size]) // copies for size, copies in config))
    if times > 0:
        plan[config] += times
        for size, copies in config:
            left[size] -= copies * times
    return max(times, 0)


def _best_fit(left: np.ndarray, capacity: int, plan: Counter) -> None:
    """The last pieces, longest first, each where the least room is left that holds it."""
    room: list[tuple[int, int]] = []  # (room left, sequence)
    made: list[list[int]] = []
    for size in range(capacity, 0, -1):
        for _ in range(int(left[size])):
            at = bisect.bisect_left(room, (size, -1))
            if at == len(room):
                made.append([])
                space, k = capacity, len(made) - 1
            else:
                space, k = room.pop(at)
            made[k].append(size)
            if space > size:
                bisect.insort(room, (space - size, k))
    for sequence in made:
        plan[tuple(sorted(Counter(sequence).items()))] += 1


def _half_bound(whole: np.ndarray, capacity: int) -> int:
    """Lower bound from pieces above half the capacity: two of them never share a sequence, nor do they with what exceeds their room."""
    size, best = np.arange(capacity + 1), 0
    for small in range(1, capacity // 2 + 1):
        large, middle, few = size > capacity - small, (2 * size > capacity) & (size <= capacity - small), (size >= small) & (2 * size <= capacity)
        room = int(whole[middle] @ (capacity - size[middle]))
        rest = max(0, int(whole[few] @ size[few]) - room)
        best = max(best, int(whole[large].sum() + whole[middle].sum()) - (-rest // capacity))
    return best


@dataclass
class Solution:
    """plan: (((length, copies), ...), times) so that every piece has exactly one place; bound: no packing has fewer sequences;
    placed: pieces that configurations of the program hold, the others went best fit."""

    plan: list[tuple[tuple[tuple[int, int], ...], int]]
    bound: int
    placed: int

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.plan)


def solved(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Solution:
    whole = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        whole[size] += n
    full = int(whole[capacity])
    out, bound = [], _half_bound(whole, capacity)
    for free in (True, False):
        left, plan = whole.copy(), Counter()
        if full:
            plan[((capacity, 1),)] = full
            left[capacity] = 0
        ranked: list[tuple[tuple, float]] = []
        for again in range(PASSES):
            if not left.any():
                break
            bought, least = _program(left, capacity, rounds, free)
            if not again:
                bound = max(bound, math.ceil(full + least - 1e-6))
            ranked = sorted(bought.items(), key=lambda x: (-x[1], x[0]))
            if not sum(_take(config, int(times), left, plan) for config, times in ranked):
                break
        for up in (True, False):  # rounded up or not, what is left goes best fit
            rest, both = left.copy(), plan.copy()
            for config, times in ranked if up else ():
                if sum(size * copies for size, copies in config) >= capacity - capacity // 1000:
                    _take(config, math.ceil(times), rest, both)
            placed = int(whole.sum() - rest.sum())
            _best_fit(rest, capacity, both)
            out.append(Solution(sorted(both.items()), 0, placed))
    best = min(out, key=lambda x: (x.sequences, -x.placed))
    best.bound = bound
    return best


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(((length, copies), ...), times) so that every piece of the histogram has exactly one place."""
    return solved(histogram, capacity, rounds).plan


def _slots(plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of its runs of slots, by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for config, times in plan:
        offset = 0
        for size, copies in config:
            for _ in range(copies):
                runs.setdefault(size, []).append((taken[size], base, offset))
                taken[size] += times
                offset += size
        base += times
    return {size: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for size, r in runs.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, json_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the end id; a longer one than `capacity` is cut, the first piece being the
    shorter. A null text is an empty one and packs as the end id alone. Repeated rows are packed each; an empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    lean(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    pieces = materialize(texts.mapInArrow(_pieces(vocabulary(json_path), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(solve(histogram, capacity)))
    # Ranks within a length: by bucket, then within the bucket.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(16, parts(spark)))).cast("int"))
    before = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                first, base, at = table[int(size)]
                run = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[run] + rank[rows] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
