"""Byte-level BPE by corpus-level merge replay.

Three steps over the whole table:

1. The texts are cut into blocks of some megabytes. A block is written as its distinct
   words (pre-tokens) in the order of a hash and, for each document, the numbers of its
   words in that list: the text itself is not needed again.
2. The distinct words of all blocks, the corpus, are dealt out in buckets by ranges of the
   hash, so each word meets its copies from other blocks and is replayed once. An inverted
   index maps each mergeable pair, by the rank of the token it makes, to the positions
   where it stands. Ranks are applied in rising order: all occurrences of a pair in the
   slice of the corpus are merged at once, and only the pairs with the touched neighbours
   are looked up anew and indexed.
3. The ids go back to the blocks bucket by bucket, which gives them in the order of the
   block's list, and the word numbers are replaced by ids. A frequent word travels once for
   each block, not once for each time it is written.

Ids equal those of the tiktoken library for the same ranks and pattern: within
a word the lowest rank is always merged first, leftmost first. Where a merge
could create a pair of lower rank (known from the vocabulary beforehand), only
the leftmost occurrence in each word is merged before the heap is asked again.

The blocks are written as a bucketed table, so only words and ids are shuffled. The table
fixes which document lies in which block: a lost executor repeats a step with equal results. A task
holds up to HOME_BLOCKS packed blocks and unpacks one at a time, or holds one slice of words and the words it has replayed, up to a bound (a forgotten word is replayed again).

Defined results: a null or empty text has no ids and decodes to no bytes;
texts of any length are encoded whole; repeated rows give repeated results; a
null doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import map_text, ship_package, stage_in_buckets
from kpiforge.llm.vocab import pattern, ranks
from kpiforge.llm.wordblocks import (BLOCK_BYTES, BatchEncoder, blocks, chunk_spans, hash_spans, row_offsets,
                                     take_ranges)

BLOCK_TEXT = 16 << 20  # bytes of text in a block; a longer document is a block of its own
SLICE_WORDS = 200_000  # words replayed together
SLICE_BYTES = 2 << 20  # and their bytes; a longer row of words is a slice of its own
HOME_BLOCKS = 8  # consecutive blocks of a task that stay together, in one file and one group
BUCKET_WORDS = 1 << 17  # words of blocks in a bucket, on average
FINISH_WORDS = 500_000  # words of a block turned to ids at a time; a longer document by itself
RANKS = "byte_bpe_50k.tiktoken"
_NONE = np.int64(2**62)


class MergeReplay:
    """Encoder of a word list by replaying the vocabulary's merges over all of it."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.width = max(vocabulary.values()) + 2
        self.byte_id = np.full(256, -1, np.int64)
        keys, made = [], []
        for token, rank in vocabulary.items():
            if len(token) == 1:
                self.byte_id[token[0]] = rank
            for cut in range(1, len(token)):
                a, b = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_rank = np.array(made, np.int64)[order]
        # Ranks whose token takes part in a pair of lower rank.
        left, right = self.pair_keys // self.width, self.pair_keys % self.width
        self.early = set(left[self.pair_rank < left].tolist()) | set(right[self.pair_rank < right].tolist())

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, all ids)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lengths.sum())
        none = self.width - 1  # of no pair
        symbol = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], none)
        word = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(lengths)[lengths > 0]
        after[ends - 1] = n
        after[n] = before[0 if n else n] = n
        before[ends[:-1]] = n
        alive = np.ones(n + 1, bool)
        rank = self.rank_of(symbol, symbol[after])
        rank[n] = _NONE
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Index positions under the rank of the pair that starts there."""
            at = at[rank[at] < _NONE]
            if len(at) == 0:
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for key, group in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if key in index:
                    index[key].append(group)
                else:
                    index[key] = [group]
                    heapq.heappush(heap, key)

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
            at = at[alive[at] & (rank[at] == r)]
            if len(at) == 0:
                continue
            if len(at) > 1:
                if r in self.early:  # one occurrence in each word; the others come again
                    first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                else:  # of overlapping occurrences, every other one from the left
                    joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
                    place = np.arange(len(at))
                    first = (place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0
                later, at = at[~first], at[first]
            else:
                later = at[:0]
            gone = after[at]
            follow = after[gone]
            symbol[at] = r
            alive[gone] = False
            rank[gone] = _NONE
            after[at] = follow
            before[follow] = at
            touched = np.concatenate([before[at], at])
            touched = touched[touched < n]
            rank[touched] = self.rank_of(symbol[touched], symbol[after[touched]])
            enter(np.unique(touched))
            if len(later):
                later = later[alive[later] & (rank[later] == r)]
                enter(later)
        keep = alive[:n]
        return np.bincount(word[keep], minlength=len(words)), symbol[:n][keep]


@lru_cache(maxsize=2)
def replay(path: str = RANKS) -> MergeReplay:
    return MergeReplay(ranks(path))


def _word_numbers(words: dict[str, int], chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words per chunk, number of every word); new words are entered in ``words``."""
    split = _splitter()
    counts, of = np.zeros(len(chunks), np.int64), []
    for i, chunk in enumerate(chunks):
        parts = split(chunk.decode())
        counts[i] = len(parts)
        of.extend(words.setdefault(p, len(words)) for p in parts)
    return counts, np.array(of, np.int64)


@lru_cache(maxsize=1)
def _splitter() -> Callable[[str], list[str]]:
    return regex.compile(pattern()).findall


@lru_cache(maxsize=2)
def encoder(path: str = RANKS) -> BatchEncoder:
    """Encoder of texts at hand, such as the edited parts of a document: their words are the corpus."""
    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words: dict[str, int] = {}
        counts, of = _word_numbers(words, chunks)
        size, ids = replay(path).encode([w.encode() for w in words])
        begin = np.cumsum(size) - size
        total = np.zeros(len(of) + 1, np.int64)
        np.cumsum(size[of], out=total[1:])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return total[edge[1:]] - total[edge[:-1]], take_ranges(ids, begin[of], size[of])

    return BatchEncoder(chunk_spans, encode)


class WordLister:
    """Cuts Arrow batches of texts into blocks: distinct words, and each document's words as numbers.

    Chunks seen before are known to the worker, up to a bound on memory.
    """

    def __init__(self, limit: int = 400_000):
        self.words: dict[str, int] = {}
        self.known = BatchEncoder(chunk_spans, lambda chunks: _word_numbers(self.words, chunks), limit=limit)

    def cut(self, batches: Iterator[pa.RecordBatch], first: int, limit: int = BLOCK_TEXT) -> Iterator[pa.RecordBatch]:
        docs, sizes, numbers, held = [], [], [], 0
        for batch in batches:
            for i, j, data, _ in blocks(batch.column(1), min(limit, BLOCK_BYTES)):
                if self.known.table.full():  # its numbers go with it: the block ends here
                    if docs:
                        yield self._block(first, docs, sizes, numbers)
                        first, docs, sizes, numbers, held = first + 1, [], [], [], 0
                    self.known.table.clear()
                    self.words.clear()
                for _, _, counts, rows, of in self.known.batch(batch.column(1).slice(i, j - i)):
                    docs.append(batch.column(0).slice(i, j - i).cast(pa.int64()))
                    sizes.append(np.diff(row_offsets(counts, rows)))
                    numbers.append(of.astype(np.uint32))
                held += len(data)
                if held >= limit:
                    yield self._block(first, docs, sizes, numbers)
                    first, docs, sizes, numbers, held = first + 1, [], [], [], 0
        if docs:
            yield self._block(first, docs, sizes, numbers)

    def _block(self, number: int, docs: list, sizes: list, numbers: list) -> pa.RecordBatch:
        ids, of = pa.concat_arrays(docs), np.concatenate(numbers)
        used = np.zeros(len(self.words), bool)
        used[of] = True
        used = np.flatnonzero(used)
        listed = list(self.words)
        words = [listed[k].encode() for k in used.tolist()]
        length = np.fromiter(map(len, words), np.int64, len(words))
        data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum(length)
        order = np.argsort(hash_spans(data, end - length, end), kind="stable")
        place = np.zeros(len(listed), np.uint32)
        place[used[order]] = np.arange(len(order), dtype=np.uint32)
        whole = np.array([0, len(ids)], np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([len(words)], pa.int64()), pa.ListArray.from_arrays(whole, ids),
             pa.array([_packed(np.concatenate(sizes))], pa.binary()), pa.array([_packed(place[of])], pa.binary()),
             pa.array([take_ranges(data, (end - length)[order], length[order]).tobytes()], pa.binary()),
             pa.array([_packed(length[order])], pa.binary()),
             pa.array([number // HOME_BLOCKS], pa.int64())],
            ["block", "n_words", "doc_ids", "sizes", "numbers", "words", "lengths", "home"])


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, compressed: all their lowest bytes, then all the next ones, and so on."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, where each id begins, its length)."""
    vocabulary = ranks(path)
    size = max(vocabulary.values()) + 1
    tokens = [b""] * size
    for token, rank in vocabulary.items():
        tokens[rank] = token
    length = np.fromiter(map(len, tokens), np.int64, size)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def decode(ids: np.ndarray, path: str = RANKS) -> tuple[bytes, np.ndarray]:
    """(bytes of the ids, offset of every id and of the end)."""
    data, begin, length = _token_bytes(path)
    n = length[ids]
    off = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    return take_ranges(data, begin[ids], n).tobytes(), off


def word_blocks(docs: DataFrame, limit: int = BLOCK_TEXT) -> DataFrame:
    """One row per block of documents, written in buckets by home (the group of the block).

    block, n_words, doc_ids, sizes (words of each document), numbers (of all their words),
    words (distinct, one after the other, in the order of their hashes) and their lengths.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        yield from WordLister().cut((x for x in batches if x.num_rows), first, limit)

    ship_package(docs.sparkSession)
    cut = docs.select("doc_id", "text").mapInArrow(
        run, "block long, n_words long, doc_ids array<long>, sizes binary, numbers binary, words binary, "
             "lengths binary, home long")
    return stage_in_buckets(cut, "bpe-blocks", _tasks(docs), "home")


def _tasks(df: DataFrame) -> int:
    """Tasks of a shuffle of few heavy rows, whose bytes say little of the work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_buckets(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words, lengths): each block's words cut by equal ranges of the hash, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for block, words, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                length = _unpacked(lengths)
                if not len(length):
                    continue
                end = np.cumsum(length)
                h = hash_spans(np.frombuffer(words, np.uint8), end - length, end)
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(h)]])
                byte = np.concatenate([[0], end])[cut].tolist()
                at = cut.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut[:-1]].astype(np.int64)), pa.array(np.full(len(cut) - 1, block)),
                     pa.array([squeeze(words[a:b]) for a, b in zip(byte[:-1], byte[1:])], pa.binary()),
                     pa.array([_packed(length[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())],
                    ["bucket", "block", "words", "lengths"])

    return blocks.select("block", "words", "lengths").mapInArrow(
        run, "bucket long, block long, words binary, lengths binary")


def replayed(rows: DataFrame, path: str = RANKS, together: int = SLICE_WORDS) -> DataFrame:
    """(bucket, block, counts, ids) of rows of words, by replaying the merges over the distinct ones of each slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # every row of this column is one word; those replayed before are known
        known = BatchEncoder(lambda data, off: (off[:-1], off[1:]), replay(path).encode, limit=1_000_000)

        def encode(held: list[tuple[int, int, bytes, np.ndarray]]) -> pa.RecordBatch:
            length = np.concatenate([row[3] for row in held])
            edge = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            words = pa.LargeStringArray.from_buffers(
                len(length), pa.py_buffer(edge.tobytes()), pa.py_buffer(b"".join(row[2] for row in held)))
            parts = [(counts, ids) for _, _, counts, _, ids in known.batch(words)]
            counts, ids = (np.concatenate(x) for x in zip(*parts))
            place = np.concatenate([[0], np.cumsum([len(row[3]) for row in held])])
            off = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[place].tolist()
            at = place.tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0] for row in held], pa.int64()), pa.array([row[1] for row in held], pa.int64()),
                 pa.array([_packed(counts[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
                 pa.array([_packed(ids[a:b]) for a, b in zip(off[:-1], off[1:])], pa.binary())],
                ["bucket", "block", "counts", "ids"])

        unsqueeze = zstandard.ZstdDecompressor().decompress
        held, n, size = [], 0, 0
        for batch in batches:
            for bucket, block, words, lengths in zip(*batch.columns):
                held.append((bucket.as_py(), block.as_py(), unsqueeze(words.as_py()), _unpacked(lengths.as_py())))
                n, size = n + len(held[-1][3]), size + len(held[-1][2])
                if n >= together or size >= SLICE_BYTES:
                    yield encode(held)
                    held, n, size = [], 0, 0
        if held:
            yield encode(held)

    return rows.mapInArrow(run, "bucket long, block long, counts binary, ids binary")


def corpus_encoded(docs: DataFrame, schema: str, finish: Callable[[pa.Array, np.ndarray, np.ndarray], pa.Table],
                   path: str = RANKS, limit: int = BLOCK_TEXT, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``finish`` of the documents of every block: (doc_ids, offsets of the documents' ids, their ids)."""
    blocks = word_blocks(docs, limit)
    n_words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(1, min(-(-n_words // bucket_words), 1 << 31))
    dealt = in_buckets(blocks, buckets).repartition(min(buckets, _tasks(docs)), "bucket").sortWithinPartitions("bucket")
    sent = replayed(dealt, path).withColumn("to", F.floor(F.col("block") / HOME_BLOCKS))

    def whole(block: dict, doc_ids: pa.Array, counts: list[bytes], ids: list[bytes]) -> Iterator[pa.Table]:
        size, flat = (np.concatenate([np.zeros(0, np.int64), *map(_unpacked, x)]) for x in (counts, ids))
        begin = np.cumsum(size) - size
        of = _unpacked(block["numbers"])
        last = np.concatenate([[0], np.cumsum(_unpacked(block["sizes"]))])
        a = 0
        while a < len(doc_ids):
            b = max(a + 1, int(np.searchsorted(last, last[a] + FINISH_WORDS, "right")) - 1)
            part = of[last[a]:last[b]]
            total = np.concatenate([[0], np.cumsum(size[part])])
            yield finish(doc_ids.slice(a, b - a), total[last[a:b + 1] - last[a]], take_ranges(flat, begin[part], size[part]))
            a = b

    def run(held: pa.Table, words: pa.Table) -> pa.Table:
        # the buckets of a block come in any order; in theirs, they give the words in the order of the block's list
        order = np.lexsort((words["bucket"].to_numpy(), words["block"].to_numpy()))
        home = words["block"].to_numpy()[order]
        out = []
        for k, number in enumerate(held["block"].to_pylist()):
            own = order[np.searchsorted(home, number):np.searchsorted(home, number, "right")].tolist()
            out += whole({c: held[c][k].as_py() for c in ("numbers", "sizes")}, held["doc_ids"][k].values,
                         [words["counts"][i].as_py() for i in own], [words["ids"][i].as_py() for i in own])
        return pa.concat_tables(out)

    held = blocks.select("home", "block", "doc_ids", "sizes", "numbers")
    return held.groupBy("home").cogroup(sent.groupBy("to")).applyInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str = RANKS, limit: int = BLOCK_TEXT) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit ids of every whole text."""
    def finish(doc_ids: pa.Array, off: np.ndarray, ids: np.ndarray) -> pa.Table:
        raw, edge = ids.astype("<u4").tobytes(), (off * 4).tolist()
        return pa.table({"doc_id": doc_ids, "ids": pa.array(
            [raw[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())})

    return corpus_encoded(docs, "doc_id long, ids binary", finish, path, limit)


def decode_documents(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids, bytes): the decoded bytes beside the ids."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [decode(np.frombuffer(x or b"", "<u4").astype(np.int64), path)[0] for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], ["doc_id", "ids", "bytes"])

    return map_text(tokens, ["doc_id", "ids"], "doc_id long, ids binary, bytes binary", run)


def round_trip(docs: DataFrame, path: str = RANKS, limit: int = BLOCK_TEXT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids and their decoding, digested where they are made."""
    sha = hashlib.sha256

    def finish(doc_ids: pa.Array, off: np.ndarray, ids: np.ndarray) -> pa.Table:
        raw = memoryview(ids.astype("<u4").tobytes())
        text, at = decode(ids.astype(np.int64), path)
        view, cut, edge = memoryview(text), at[off].tolist(), (off * 4).tolist()
        return pa.table({
            "doc_id": doc_ids, "n_tokens": np.diff(off),
            "ids_sha256": pa.array([sha(raw[a:b]).hexdigest() for a, b in zip(edge[:-1], edge[1:])], pa.string()),
            "decoded_sha256": pa.array([sha(view[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:])], pa.string())})

    return corpus_encoded(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                          finish, path, limit)
