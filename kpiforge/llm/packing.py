"""Packing by Karmarkar-Karp multiway differencing.

Every document is encoded whole and ends with the end id. It is cut into full
windows and a rest of near-equal pieces of at most ``PIECE`` ids. Pieces of
consecutive documents (``GROUP`` ids or more, never across tasks) are dealt
into windows: every piece starts as a partial partition with one filled
window; the two partitions with the largest imbalance are merged, the fullest
windows of one with the emptiest of the other, until one partition is left.
The window count starts at the least possible and rises whenever the fullest
window exceeds the capacity. Windows come out near-equal, so little is padded:
a window is padded to the capacity unless its length is a power of two.

Defined results: a null or empty text is the end id alone; a text of any
length is cut as above; repeated rows are packed separately; a null doc_id
stays null; an empty table gives no rows; extra columns are ignored. Which
windows share pieces follows the order in which rows are stored; a task that
is run again reads the same rows and gives the same windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kpiforge.llm.common import ship_package
from kpiforge.llm.vocab import encode_words
from kpiforge.llm.wordblocks import BatchEncoder, chunk_spans, row_offsets

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 1024
PIECE = 256
GROUP = 64 * CAPACITY
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


@lru_cache(maxsize=2)
def _encoder(path: str) -> BatchEncoder:
    return BatchEncoder(chunk_spans, lambda words: encode_words(path, words))


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, list[list[int]]]:
    """(sums, items per window) of ``windows`` windows, by largest differencing first.

    A partial partition is its window sums in falling order, less the
    smallest one, and for each window a node of a tree whose leaves are items.
    """
    n = len(sizes)
    left, right = [], []  # of inner nodes n, n + 1, ...
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        nodes = np.full(windows, -1, np.int64)
        nodes[0] = i
        heap.append((-size if windows > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        b, bn = b[::-1], bn[::-1]
        sums = a + b
        nodes = np.where(an < 0, bn, an)
        both = np.flatnonzero((an >= 0) & (bn >= 0))
        if len(both):
            nodes[both] = n + len(left) + np.arange(len(both))
            left.extend(an[both].tolist())
            right.extend(bn[both].tolist())
        rank = np.argsort(-sums, kind="stable")
        sums, nodes = sums[rank], nodes[rank]
        if windows > 1:
            sums = sums - sums[-1]
        order += 1
        heapq.heappush(heap, (-int(sums[0]) if windows > 1 else 0, order, sums, nodes))
    items = []
    for node in heap[0][3].tolist() if heap else []:
        out, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += [right[x - n], left[x - n]]
        items.append(out)
    return np.array([sum(sizes[i] for i in w) for w in items], np.int64), items


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of items, each at most ``capacity``; more windows until none exceeds it."""
    if not sizes:
        return []
    windows = -(-sum(sizes) // capacity)
    while True:
        sums, items = differencing(sizes, windows)
        over = int(sums.max()) - capacity
        if over <= 0:
            return [w for w in items if w]
        # The mean must fall by about the excess for the fullest window to fit.
        windows += max(1, windows * over // (2 * capacity))


def cut_document(tokens: int, capacity: int = CAPACITY, piece: int = PIECE) -> tuple[int, list[int]]:
    """(full windows, lengths of the rest's near-equal pieces)."""
    full, rest = divmod(tokens, capacity)
    if not rest:
        return full, []
    parts = -(-rest // piece)
    return full, [rest * (i + 1) // parts - rest * i // parts for i in range(parts)]


class _Packer:
    """Pieces of a task's documents; full windows leave at once, rests are dealt by group."""

    def __init__(self, base: int, capacity: int, piece: int, group: int):
        self.next, self.capacity, self.piece, self.group = base, capacity, piece, group
        self.rows, self.rests, self.waiting = [], [], 0

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        raw, step = ids.tobytes(), ids.itemsize
        full, rest = cut_document(n, self.capacity, self.piece)
        for size in [self.capacity] * full + rest:
            row = (doc, at, size, zlib.crc32(raw[at * step:(at + size) * step]), n)
            at += size
            if size == self.capacity:
                self.rows.append((*row, self.next, 0))
                self.next += 1
            else:
                self.rests.append(row)
                self.waiting += size
        if self.waiting >= self.group:
            self.deal()

    def deal(self) -> None:
        for window in pack([r[2] for r in self.rests], self.capacity):
            at = 0
            for k in window:
                self.rows.append((*self.rests[k], self.next, at))
                at += self.rests[k][2]
            self.next += 1
        self.rests, self.waiting = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def packed(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY,
           piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per piece: document, start, length, CRC-32 of its ids, sequence and offset there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, piece, group)
        for batch in batches:
            for i, j, counts, rows, ids in _encoder(path).batch(batch.column(1)):
                off = row_offsets(counts, rows).tolist()
                ids = ids.astype("<u4")
                for doc, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), off[:-1], off[1:]):
                    packer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
            yield packer.take()
        packer.deal()
        yield packer.take()

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
