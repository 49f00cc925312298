"""Terms of whole texts, cut and counted in numpy, a few megabytes of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .words import word_hashes

#: Bytes of text that are cut at once; one longer text is cut alone.
RUN = 1 << 21
#: A task hands over what it has counted once it holds so many terms or counts.
MOST_TERMS, MOST_COUNTS = 300_000, 1_200_000
#: Rows that go out at once.
ROWS = 100_000
#: A-Z lower-cased, everything else as it is: words are runs of anything but ASCII white space.
WORDS = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Letters alone: A-Z lower-cased, a-z and all beyond ASCII; the rest becomes a space.
LETTERS = bytes(WORDS[x] if x >= 128 or 97 <= WORDS[x] <= 122 else 32 for x in range(256))


def bounded(spark: SparkSession, size: int = 1 << 24) -> None:
    """Arrow batches end at about `size` bytes, whatever the rows hold, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).removesuffix("b")) <= size:
        spark.conf.set(key, str(size))


def runs(texts: pa.Array, table: bytes, size: int = RUN) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Consecutive texts (null: empty) of about `size` bytes: first, last, their bytes by the table with a line feed after each, and where each begins."""
    held, first, n = [], 0, 0
    for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        held.append((text or b"").translate(table) + b"\n")
        n += len(held[-1])
        if n >= size or i == len(texts) - 1:
            yield first, i + 1, b"".join(held), np.cumsum([0, *map(len, held)])
            held, first, n = [], i + 1, 0


def terms(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms in order, and the number of the text that each is in."""
    h, at = word_hashes(data)
    return h, np.repeat(np.arange(len(starts) - 1), np.diff(np.searchsorted(at, starts)))


class Tally:
    """Occurrences, and documents that have one, of each term in each group of a task's texts.

    Within a task terms are told apart by 64 bits of hash, between tasks by their text.
    """

    def __init__(self) -> None:
        self.names: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, data: bytes, starts: np.ndarray, group: np.ndarray | None = None) -> None:
        """The texts of a run; group: a small number for each. Without one all are one group, and documents are not counted."""
        h, doc = terms(data, starts)
        if not len(h):
            return
        u, first, term, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        words = data.split()
        self.names.update(zip(u.tolist(), (words[i] for i in first.tolist()), strict=True))
        if group is None:
            self.parts.append((u, np.zeros(len(u), np.int64), n, np.zeros(len(u), np.int64)))
            self.size += len(u)
            return
        docs, groups = len(starts) - 1, int(group.max()) + 1
        pair, tf = np.unique(term * docs + doc, return_counts=True)
        key, at = np.unique(pair // docs * groups + group[pair % docs], return_inverse=True)
        part = u[key // groups], key % groups, np.bincount(at, weights=tf).astype(np.int64), np.bincount(at)
        self.parts.append(part)
        self.size += len(key)

    def full(self) -> bool:
        return len(self.names) > MOST_TERMS or self.size > MOST_COUNTS

    def take(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
        """(group, term, occurrences, documents) in pieces of ROWS; what was counted is given up."""
        if not self.parts:
            return
        h, group, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((group, h))
        h, group, n, docs = h[order], group[order], n[order], docs[order]
        cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (group[1:] != group[:-1])]))
        n, docs = np.add.reduceat(n, cut), np.add.reduceat(docs, cut)
        h, group = h[cut], group[cut]
        for i in range(0, len(h), ROWS):
            s = slice(i, i + ROWS)
            yield group[s], pa.array([self.names[x] for x in h[s].tolist()], pa.binary()).cast(pa.string()), n[s], docs[s]
        self.__init__()
