"""Edit-aware token counts.

Every document keeps a segment tree over its pre-tokens: a leaf covers
``LEAF`` consecutive runs of pre-tokens (runs between places that no pre-token
spans) with their bytes and tokens, and every inner node holds the sums of its
two subtrees. The root is the document's count.

An edit touches the leaves that it overlaps. The touched region reaches left
to a leaf border before the edit and right to a leaf border whose four bytes
before it are untouched: whether a border is one depends on those bytes and
the one behind it, so outside the region every border and every count still
holds. Only the region's new text is encoded; its first leaf gets the new sums,
its other leaves become empty, and the sums above them are updated.

Defined results: a null or empty text has one empty leaf and no tokens; texts
of any length have one tree; edits are (start, end, text) in code points, apart
and in order, null or empty lists leave the count as it is; repeated rows have
equal trees; a null doc_id stays null; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kpiforge.llm.bpe import RANKS, encoder
from kpiforge.llm.common import map_text
from kpiforge.llm.vocab import rank_encoding
from kpiforge.llm.wordblocks import blocks, chunk_spans

LEAF = 16
Edit = tuple[int, int, str]
EDITS = "array<struct<start:long,end:long,text:string>>"
_EDITS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))


class CountTree:
    """Sums of (bytes, tokens) over leaves; node 1 is the root, leaf k is node size + k."""

    def __init__(self, sums: np.ndarray):
        self.sums = sums
        self.size = len(sums) // 2

    @classmethod
    def build(cls, leaves: np.ndarray) -> CountTree:
        """From rows (bytes, tokens) of the leaves."""
        size = 1 << max(0, len(leaves) - 1).bit_length()
        sums = np.zeros((2 * size, 2), np.int64)
        sums[size:size + len(leaves)] = leaves
        level = size
        while level > 1:
            sums[level // 2:level] = sums[level:2 * level].reshape(level // 2, 2, 2).sum(axis=1)
            level //= 2
        return cls(sums)

    @classmethod
    def load(cls, raw: bytes) -> CountTree:
        return cls(np.frombuffer(raw, "<i8").reshape(-1, 2).copy())

    def dump(self) -> bytes:
        return self.sums.astype("<i8").tobytes()

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, byte: int) -> tuple[int, int]:
        """(leaf, its first byte) of the leaf that holds the byte; the last filled one for the end."""
        node, start = 1, 0
        byte = max(0, min(byte, int(self.sums[1, 0]) - 1))
        while node < self.size:
            node *= 2
            if byte >= start + self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.size, start

    def set(self, leaf: int, size: int, tokens: int) -> None:
        node = self.size + leaf
        change = np.array([size, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def apply_edits(text: str, tree: CountTree, edits: list[Edit], count: Callable[[str], int]) -> tuple[str, int]:
    """Update ``tree`` for the edits; returns the new text and the bytes that were encoded again."""
    if not edits:
        return text, 0
    raw = text.encode()
    if len(raw) == len(text):
        place = lambda k: k
    else:
        starts = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        place = lambda k: int(starts[k])
    total = len(raw)
    groups: list[tuple[int, int, int, int, list[tuple[int, int, bytes]]]] = []
    for start, end, new in edits:
        edit = (place(start), place(end), new.encode())
        first, low = tree.leaf_at(edit[0])
        if low and low >= edit[0]:
            first, low = tree.leaf_at(low - 1)
        last, at = tree.leaf_at(edit[1])
        high = at + int(tree.sums[tree.size + last, 0])
        while high < total and high < edit[1] + 4:
            last, at = tree.leaf_at(high)
            high = at + int(tree.sums[tree.size + last, 0])
        if groups and first <= groups[-1][1]:
            a, _, a_low, _, own = groups[-1]
            groups[-1] = (a, max(last, groups[-1][1]), a_low, max(high, groups[-1][3]), [*own, edit])
        else:
            groups.append((first, last, low, high, [edit]))
    out, done, encoded = [], 0, 0
    for first, last, low, high, own in groups:
        out.append(raw[done:low])
        parts, at = [], low
        for a, b, new in own:
            parts += [raw[at:a], new]
            at = b
        region = b"".join([*parts, raw[at:high]])
        tree.set(first, len(region), count(region.decode()))
        for leaf in range(first + 1, last + 1):
            tree.set(leaf, 0, 0)
        encoded += len(region)
        out.append(region)
        done = high
    return b"".join([*out, raw[done:]]).decode(), encoded


_NUMBER = re.compile(r"[0-9]{4,}")


def redactions(text: str) -> list[Edit]:
    """The production edits: lines equal to an earlier line go, runs of four or more digits become <number>."""
    edits, at, seen = [], 0, set()
    for line in text.split("\n"):
        end = at + len(line)
        if line and line in seen:
            edits.append((at, min(end + 1, len(text)), ""))
        else:
            seen.add(line)
            edits += [(at + m.start(), at + m.end(), "<number>") for m in _NUMBER.finditer(line)]
        at = end + 1
    return edits


_TREES = f"doc_id long, text string, tree binary, edits {EDITS}"
_COUNTS = ("doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_bytes long, n_bytes_encoded long, "
           "tree binary")


def _tree_batches(batch: pa.RecordBatch, edits: Callable[[str], list[Edit]] | None, path: str,
                  leaf: int) -> Iterator[pa.RecordBatch]:
    texts = batch.column(1)
    for (i, j, data, off), (_, _, counts, rows, _) in zip(blocks(texts), encoder(path).batch(texts)):
        starts, ends = chunk_spans(data, off)
        trees = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if a == b:
                trees.append(CountTree.build(np.zeros((1, 2), np.int64)).dump())
                continue
            cut = np.arange(a, b, leaf)
            tokens = np.add.reduceat(counts[a:b].astype(np.int64), cut - a)
            size = np.append(starts[cut[1:]], ends[b - 1]) - starts[cut]
            trees.append(CountTree.build(np.stack([size, tokens], axis=1)).dump())
        part = texts.slice(i, j - i)
        found = [edits(t or "") if edits else [] for t in part.to_pylist()]
        listed = pa.array([[{"start": s, "end": e, "text": t} for s, e, t in own] for own in found], _EDITS_TYPE)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(i, j - i).cast(pa.int64()), part, pa.array(trees, pa.binary()), listed],
            ["doc_id", "text", "tree", "edits"])


def _recount_batch(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    coder = rank_encoding(path)
    columns = [[] for _ in range(6)]
    for text, raw, edits in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
        tree = CountTree.load(raw)
        before, size = tree.tokens, int(tree.sums[1, 0])
        own = [(e["start"], e["end"], e["text"] or "") for e in edits or []]
        _, again = apply_edits(text or "", tree, own, lambda t: len(coder.encode_ordinary(t)))
        for column, value in zip(columns, (before, len(own), tree.tokens, size, again, tree.dump())):
            column.append(value)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())],
        ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_bytes", "n_bytes_encoded", "tree"])


def with_trees(docs: DataFrame, edits: Callable[[str], list[Edit]] | None = None, path: str = RANKS,
               leaf: int = LEAF) -> DataFrame:
    """(doc_id, text, tree, edits): the tree of every whole text, and the edits that ``edits`` finds in it."""
    return map_text(docs, ["doc_id", "text"], _TREES, lambda batch: _tree_batches(batch, edits, path, leaf))


def recounted(trees: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens (before), n_edits, n_tokens_edited, n_bytes, n_bytes_encoded (again), tree (new)."""
    return map_text(trees, ["doc_id", "text", "tree", "edits"], _COUNTS, lambda batch: _recount_batch(batch, path))


def edited_counts(docs: DataFrame, edits: Callable[[str], list[Edit]], path: str = RANKS,
                  leaf: int = LEAF) -> DataFrame:
    """``recounted(with_trees(docs, edits))`` in one Python worker a task instead of two."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for trees in _tree_batches(batch, edits, path, leaf):
            yield _recount_batch(trees, path)

    return map_text(docs, ["doc_id", "text"], _COUNTS, run)
