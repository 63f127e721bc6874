"""Vectorized word splitting over Arrow string columns.

A block is the UTF-8 buffer of consecutive documents. Words are found, and
hashed to 64 bits, with a fixed number of numpy passes over the bytes, so
per-word Python work is limited to the distinct words of a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20  # bytes of text handled by one set of numpy passes

# ASCII white space: space, \t, \n, \v, \f, \r.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True
_SEED = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = _powers(_P, n)
            self.down = _powers(pow(_P, -1, 2**64), n)
        return self.up[:n], self.down


_POWERS = _Powers()


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows end-exclusive) over a string column.

    Rows are taken whole; a block holds one row at least, so only a single
    longer document can exceed ``limit`` bytes. Null texts have length 0.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal non-space runs; a document end also ends a word."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = off[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = cut[cut > 0] - 1
    last[before] = solid[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (polynomial over random byte values, then mixed)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SEED[data] * up[:len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def take_ranges(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate values[s:s+n] for each (s, n)."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return values[:0]
    begin = np.cumsum(lengths) - lengths
    index = np.arange(total, dtype=np.int64) + np.repeat(starts - begin, lengths)
    return values[index]


_SLACK = 8  # bytes behind a buffer, so that eight can be read at any of its places
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a word of eight
_WORDS = 64  # words of eight bytes compared for many spans at a time; the rest of longer spans one by one


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(_SLACK, np.uint8)])


def equal_spans(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray,
                b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Whether span k of the padded buffer ``a`` has the bytes of span k of the padded buffer ``b``."""
    same = a_len == b_len
    at = np.flatnonzero(same)
    a_words, b_words = (np.ndarray((len(x) - _SLACK + 1,), "<u8", np.ascontiguousarray(x), strides=(1,)) for x in (a, b))
    for done in range(0, 8 * _WORDS, 8):
        at = at[a_len[at] > done]
        if not len(at):
            return same
        part = _LOW[np.minimum(a_len[at] - done, 8)]
        equal = (a_words[a_at[at] + done] ^ b_words[b_at[at] + done]) & part == 0
        same[at[~equal]] = False
        at = at[equal]
    for k in at[a_len[at] > 8 * _WORDS].tolist():
        n = a_len[k]
        same[k] = np.array_equal(a[a_at[k]:a_at[k] + n], b[b_at[k]:b_at[k] + n])
    return same


def strong_key(word: bytes, turn: int) -> int:
    """64-bit key of a word whose hash another word has; ``turn`` gives a new one if that is taken too."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=turn.to_bytes(4, "little")).digest(), "little")


class WordTable:
    """Distinct words seen by this worker: key -> bytes and ids, kept between batches up to a bound.

    A bound on memory only: when it is exceeded the table restarts with the
    words of the batch at hand, and a forgotten word is simply encoded again.
    """

    def __init__(self, limit: int = 1_500_000, text_limit: int = 128 << 20):
        self.limit, self.text_limit = limit, text_limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)
        self.text = np.zeros(_SLACK, np.uint8)
        self.text_at = np.zeros(0, np.int64)
        self.text_len = np.zeros(0, np.int32)

    def full(self) -> bool:
        return len(self.keys) > self.limit or len(self.text) > self.text_limit

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys are not in the table."""
        if len(self.keys) == 0:
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def add(self, keys: np.ndarray, words: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        ids = np.asarray(ids)
        if len(ids) and ids.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        start = len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        length = np.fromiter(map(len, words), np.int32, len(words))
        text_at = len(self.text) - _SLACK + np.cumsum(length, dtype=np.int64) - length
        self.text = np.concatenate([self.text[:-_SLACK], padded(np.frombuffer(b"".join(words), np.uint8))])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.start = np.concatenate([self.start, start])[order]
        self.count = np.concatenate([self.count, counts.astype(np.int32)])[order]
        self.text_at = np.concatenate([self.text_at, text_at])[order]
        self.text_len = np.concatenate([self.text_len, length])[order]

    def others(self, keys: np.ndarray, data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which keys the table holds for other bytes than those of the spans of the padded ``data``."""
        held = np.flatnonzero(~self.missing(keys))
        found = self.find(keys[held])
        equal = equal_spans(data, at[held], length[held], self.text, self.text_at[found], self.text_len[found])
        out = np.zeros(len(keys), bool)
        out[held[~equal]] = True
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)


# Character classes for cuts between tokenizer pre-tokens.
_PLAIN = np.zeros(256, bool)  # ASCII, not a letter
_PLAIN[:128] = ~_LETTER[:128]
_INK = np.zeros(256, bool)  # printable ASCII, not white space
_INK[0x21:0x7F] = True
_TAIL = np.zeros(256, bool)  # UTF-8 continuation byte
_TAIL[0x80:0xC0] = True
_LEAD2 = np.zeros(256, bool)  # leads of two-byte characters none of which is white space
_LEAD2[0xC3:0xE0] = True
_LEAD3 = np.zeros(256, bool)  # the same of three and four bytes
_LEAD3[0xE4:0xF5] = True


def _after_letter(data: np.ndarray) -> np.ndarray:
    """True at i where byte i is ASCII but no letter and the character before it is a letter.

    Letters meant here are those of ASCII and of U+00C0 to U+00FF (less the
    signs for times and divide). A run of letters always ends there, so no
    pre-token of a letter-run pattern spans such a place.
    """
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        cut[1:] = _LETTER[data[:-1]]
    if len(data) > 2:
        tail = data[1:-1]
        cut[2:] |= (data[:-2] == 0xC3) & _TAIL[tail] & (tail != 0x97) & (tail != 0xB7)
    return cut & _PLAIN[data]


def _after_ink(data: np.ndarray) -> np.ndarray:
    """True at i where byte i is ASCII white space after a character that surely is none."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        cut[1:] = _INK[data[:-1]]
    if len(data) > 2:
        cut[2:] |= _LEAD2[data[:-2]] & _TAIL[data[1:-1]]
    if len(data) > 3:
        cut[3:] |= _LEAD3[data[:-3]] & _TAIL[data[2:-1]]
    if len(data) > 4:
        cut[4:] |= (data[:-4] >= 0xF0) & _TAIL[data[3:-1]]
    return cut & _SPACE[data]


def chunk_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of consecutive chunks that cover the bytes; no pre-token spans two of them.

    For patterns that take letter runs, number runs and sign runs each with
    at most one space before, and white space otherwise.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = _after_letter(data) | _after_ink(data)
    inner = off[:-1]
    cut[inner[inner < len(data)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data))


def bare_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``chunk_spans`` without the white space, for patterns that drop it."""
    starts, ends = word_spans(data, off)
    inside = np.flatnonzero(_after_letter(data) & ~_SPACE[data]) if len(data) else starts
    fresh = np.setdiff1d(inside, starts, assume_unique=True)
    return np.sort(np.concatenate([starts, fresh])), np.sort(np.concatenate([ends, fresh]))


def fold_ascii(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case within the spans that are all ASCII."""
    folded = np.where(_UPPER[data], data + np.uint8(32), data)
    high = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data >= 0x80, out=high[1:])
    mixed = np.flatnonzero(high[ends] > high[starts])
    if len(mixed):
        at = take_ranges(np.arange(len(data)), starts[mixed], ends[mixed] - starts[mixed])
        folded[at] = data[at]
    return folded


class BatchEncoder:
    """Ids of whole texts from an encoder of distinct chunks.

    ``spans`` cuts a block into chunks that can be encoded one by one;
    ``encode`` gives (ids per chunk, all ids) for a list of distinct chunks.
    Chunks are found by a hash, and their bytes decide: of chunks with one hash
    and different bytes the first keeps it, the others get keys of their own.
    """

    def __init__(self, spans, encode, fold: bool = False, limit: int = 3_000_000):
        self.spans, self.encode, self.fold = spans, encode, fold
        self.table = WordTable(limit)

    def _chunks(self, data, off):
        starts, ends = self.spans(data, off)
        return starts, ends, fold_ascii(data, starts, ends) if self.fold else data

    def _distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pending: dict[int, bytes]):
        """(keys, first chunk of each, key number of every chunk); a key stands for one byte string only."""
        hashes, length = hash_spans(data, starts, ends), ends - starts
        wide = padded(data)
        turn = 0
        while True:
            keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            of = first[inverse]
            odd = np.flatnonzero(of != np.arange(len(of)))
            odd = odd[~equal_spans(wide, starts[odd], length[odd], wide, starts[of[odd]], length[of[odd]])]
            taken = self.table.others(keys, wide, starts[first], length[first])
            for k in np.flatnonzero(self.table.missing(keys)).tolist():
                word = pending.get(int(keys[k]))
                if word is not None and word != data[starts[first[k]]:ends[first[k]]].tobytes():
                    taken[k] = True
            odd = np.union1d(odd, np.flatnonzero(taken[inverse]))
            if not len(odd):
                return keys, first, inverse
            turn += 1
            hashes[odd] = [strong_key(data[a:b].tobytes(), turn)
                           for a, b in zip(starts[odd].tolist(), ends[odd].tolist())]

    def batch(self, texts: pa.Array):
        """For each block: (first row, end row, ids per chunk, first chunk of each row, all ids).

        The distinct chunks of the whole batch are encoded together first.
        """
        table = self.table
        if table.full():
            table.clear()
        held, pending = [], {}
        for i, j, data, off in blocks(texts):
            starts, ends, data = self._chunks(data, off)
            keys, first, inverse = self._distinct(data, starts, ends, pending)
            lack = np.flatnonzero(table.missing(keys))
            at = first[lack]
            raw = data.tobytes()
            for key, a, b in zip(keys[lack].tolist(), starts[at].tolist(), ends[at].tolist()):
                if key not in pending:
                    pending[key] = raw[a:b]
            held.append((i, j, keys, inverse.astype(np.int32), np.searchsorted(starts, off)))
        if pending:
            found, words = np.fromiter(pending, np.uint64, len(pending)), list(pending.values())
            counts, ids = self.encode(words)
            table.add(found, words, np.asarray(counts, np.int64), ids)
            del words, pending
        for i, j, keys, inverse, rows in held:
            at = table.find(keys)
            counts = table.count[at][inverse]
            yield i, j, counts, rows, take_ranges(table.ids, table.start[at][inverse], counts)


def row_offsets(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Offsets of each row's ids in a block, from ids per chunk and first chunks of the rows."""
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return total[rows]
