"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

A text's shingles are its runs of five words, lower case for A-Z (fewer words:
one shingle of all of them). Each shingle is hashed once; the high bits choose
one of ``BINS`` bins and the rest is the value, of which a bin keeps the
smallest. An empty bin copies the first filled bin of its own random order of
all bins, the same for every document. Values are mixed with their bin's number
and the lowest ``BITS`` bits of each are packed. Two fingerprints agree by chance in 2**-BITS of their bins, so the
likeness is (agreement - chance) / (1 - chance), held to 0..1.

Each document is also compared with the next one, in ascending order of doc_id,
then of the hash of the text. The table is cut into ranges of these two, and the
first row of each range is sent to the range before it too, so one pass over each
range in order sees every neighbour. A doc_id with many texts spans several ranges;
rows that are equal in both and would fill ranges of their own are counted first
and pass as one row.

Defined results: a text without words, null or empty, has the empty
fingerprint, alike (1) to another empty one and unlike (0) any other; the
last document's next is the first, a single document's next is itself; rows
that repeat a doc_id follow one another by the hash of their text; a null
doc_id comes first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import ship_package
from kpiforge.llm.wordblocks import BLOCK_BYTES, blocks, hash_spans, mix, word_spans

SHINGLE = 5
BINS = 512
BITS = 4
SAMPLE = 50  # rows a range whose ids and hashes choose where ranges begin
NO_ID = -(2**63)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F], np.uint64)
_EMPTY = np.uint64(2**64 - 1)


@lru_cache(maxsize=2)
def _orders(bins: int) -> np.ndarray:
    """order[t, b]: the t-th bin that bin b looks at when it is empty."""
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(bins) for _ in range(bins)], axis=1).astype(np.int32)


@lru_cache(maxsize=2)
def _salts(bins: int) -> np.ndarray:
    return mix(np.arange(1, bins + 1, dtype=np.uint64) * _FACTORS[0])


def shingle_hashes(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle of a block."""
    starts, ends = word_spans(data, off)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    words = hash_spans(data, starts, ends)
    rows = np.searchsorted(off, starts, "right") - 1
    n = len(words) - size + 1
    full = np.zeros(0, np.uint64)
    where = np.zeros(0, np.int64)
    if n > 0:
        inside = rows[:n] == rows[size - 1:]
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += words[k:k + n] * _FACTORS[k]
        full, where = mix(total[inside]), rows[:n][inside]
    count = np.bincount(rows, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    total = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = count[short] > k
        total[has] += words[first[short[has]] + k] * _FACTORS[k]
    short_hash = mix(total + count[short].astype(np.uint64))
    return np.concatenate([full, short_hash]), np.concatenate([where, short])


def sketches(texts: pa.Array, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(low bits per row and bin as bytes, rows with a word)."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    out = np.zeros((len(texts), bins), np.uint8)
    known = np.zeros(len(texts), bool)
    for i, j, data, off in blocks(texts, BLOCK_BYTES // 2):
        hashes, rows = shingle_hashes(data, off)
        least = np.full((j - i) * bins, _EMPTY)
        np.minimum.at(least, rows * bins + (hashes >> shift).astype(np.int64),
                      hashes & ((np.uint64(1) << shift) - np.uint64(1)))
        least = least.reshape(j - i, bins)
        filled = least != _EMPTY
        known[i:j] = filled.any(axis=1)
        source = least.copy()
        row, bin_ = np.nonzero(~filled & known[i:j, None])
        for look in _orders(bins):
            if len(row) == 0:
                break
            found = look[bin_]
            hit = filled[row, found]
            source[row[hit], bin_[hit]] = least[row[hit], found[hit]]
            row, bin_ = row[~hit], bin_[~hit]
        # Mixed with the bin, so that bins that hold one value agree by chance one by one.
        out[i:j] = (mix(source ^ _salts(bins)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    out[~known] = 0
    return out, known


def packed_text(low: np.ndarray, known: np.ndarray, bits: int = BITS) -> list[str]:
    """Fingerprints as hexadecimal text, ``bits`` bits for each bin; empty without words."""
    planes = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(low), -1)
    size = planes.shape[1] // 8 * 2
    text = np.packbits(planes, axis=1).tobytes().hex()
    return [text[k * size:(k + 1) * size] if ok else "" for k, ok in enumerate(known.tolist())]


def likeness(a: np.ndarray, a_known: np.ndarray, b: np.ndarray, b_known: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, row by row, corrected for chance agreement."""
    chance = 2.0**-bits
    raw = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.where(a_known & b_known, np.clip(raw, 0, 1), (a_known == b_known).astype(float))


Pair = tuple[int, int]  # doc_id and hash of the text: what rows are ordered by


def _ranges(rows: DataFrame, parts: int) -> tuple[list[Pair], list[Pair]]:
    """Ascending pairs of rows that begin ranges of about equal row counts, and the pairs that fill a range alone.

    The first pair is the smallest one. The others come from a random sample of about
    ``SAMPLE`` pairs for each range; which rows it holds sets the ranges, not the result.
    """
    least = rows.agg(F.min(F.struct("key", "rank")).alias("pair"), F.count("*").alias("n")).first()
    if not least.n:
        return [], []
    sample = rows.select("key", "rank").sample(min(1.0, SAMPLE * parts / least.n), seed=8).collect()
    pairs = sorted((r.key, r.rank) for r in sample)
    step = max(1, len(pairs) // parts)
    cuts = [tuple(least.pair), *pairs[step::step]]
    firsts = sorted(set(cuts))
    return firsts, [p for p, n in Counter(cuts).items() if n > 1]


def _pairs(values: list[Pair]) -> Column:
    return F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(r).cast("long").alias("rank"))
                     for k, r in values])


def _range_of(pair: Column, firsts: list[Pair]) -> Column:
    """Index of the last range that begins at or before ``pair``, by two levels of about sqrt(n) comparisons."""
    step = max(1, int(len(firsts) ** 0.5))
    groups = [firsts[k:k + step] for k in range(0, len(firsts), step)]
    group = F.size(F.filter(_pairs([g[0] for g in groups]), lambda x: x <= pair)) - 1
    own = F.get(F.array(*[_pairs(g) for g in groups]), group)
    return group * step + F.size(F.filter(own, lambda x: x <= pair)) - 1


def _in_ranges(docs: DataFrame, parts: int) -> tuple[DataFrame, bool]:
    """(doc_id, text, guest, times) in order within ranges, one range a partition, and whether any times exceeds 1.

    guest marks the first row of the next range, which comes last.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("key"),
                       F.xxhash64(text).alias("rank"))
    firsts, hot = _ranges(rows, parts)
    n = max(1, len(firsts))
    pair, once = F.struct("key", "rank"), F.lit(1).cast("long").alias("times")
    if hot:
        held = F.array_contains(_pairs(hot), pair)
        counted = rows.where(held).groupBy("doc_id", "text", "key", "rank").agg(F.count("*").alias("times"))
        rows = rows.where(~held).select("*", once).unionByName(counted)
    else:
        rows = rows.select("*", once)
    rows = rows.withColumn("range", _range_of(pair, firsts or [(0, 0)]))
    opens = F.coalesce(F.get(_pairs(firsts or [(0, 0)]), F.col("range")) == pair, F.lit(False))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("range") + n - 1) % n).cast("int").alias("range"), F.lit(True).alias("guest"))
    rows = rows.withColumn("to", F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own)))).select(
        "doc_id", "text", "key", "rank", "times", "to.range", "to.guest")
    rows = rows.repartitionById(n, F.col("range")).sortWithinPartitions("range", "guest", "key", "rank")
    return rows.select("doc_id", "text", "guest", "times"), bool(hot)


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its
    code points replaced by the first as many of the next document."""
    spark = docs.sparkSession
    rows, repeated = _in_ranges(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: doc_id, text, low bits, whether it has a word
        for batch in batches:
            for part in _small(batch):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                guests = part.column(2).to_pylist()
                stop = guests.index(True) + 1 if True in guests else len(ids)  # the first guest ends the range
                ids, texts = ids[:stop], texts[:stop]
                low, known = sketches(pa.array(texts, pa.string()), bins, bits)
                times = np.where(guests[:stop], 1, part.column(3).to_numpy()[:stop])
                if (times > 1).any():  # all copies but the last are followed by a copy
                    at = np.repeat(np.arange(stop), 1 + (times > 1))
                    ids, texts, low, known = [ids[k] for k in at], [texts[k] for k in at], low[at], known[at]
                    followed = np.append(at[:-1] == at[1:], False)
                    times = np.where(followed, times[at] - 1, 1)
                if held is not None:
                    ids, texts, times = [held[0], *ids], [held[1], *texts], np.append(1, times)
                    low, known = np.vstack([held[2][None], low]), np.append(held[3], known)
                edited = [_edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
                low2, known2 = sketches(pa.array(edited, pa.string()), bins, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                     pa.array(packed_text(low[:-1], known[:-1], bits), pa.string()),
                     pa.array(packed_text(low2, known2, bits), pa.string()),
                     pa.array(likeness(low[:-1], known[:-1], low2, known2, bits)),
                     pa.array(likeness(low[:-1], known[:-1], low[1:], known[1:], bits)),
                     pa.array(times[:-1], pa.int64())], [*(f.split()[0] for f in SCHEMA.split(", ")), "times"])
                if True in guests:
                    return
                held = (ids[-1], texts[-1], low[-1], known[-1])

    ship_package(spark)
    found = rows.mapInArrow(run, f"{SCHEMA}, times long")
    if repeated:
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("copy")
    return found.drop("times")


def _small(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
