"""Language identification with string kernels.

Kernel: blended-spectrum presence kernel over byte n-grams (n = 1 to 3) of the
folded text, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G holds the
distinct n-grams of the feature space (the ``MAX_GRAMS`` n-grams that the most
landmarks have). Nystrom landmarks: ``LANDMARKS`` texts for each language;
phi(x) = k(x, landmarks) K^-1/2. One-versus-rest kernel ridge regression on
phi, targets +1 and -1. A batch of texts is scored by two matrix products:
presence x landmarks, then kernel values x weights.

The classifier is fitted on a bounded sample: of every language the ``TRAIN``
texts (the landmarks among them) with the smallest hashes of doc_id, out of
all rows that may be learned from. Every text is predicted, whole.

Learned from are rows with a language, a text with a letter, and crc32 of
doc_id mod 4 other than 2 (a null doc_id is not learned from and not held out).

Defined results: a null text or one without a letter is ``und`` with score 0;
any other text gets a learned language, the first of them in ties; texts of
any length are read whole, in slices; repeated rows get the same prediction;
without rows to learn from every text is ``und``; an empty table gives no
rows; extra columns are ignored, and lang is read to learn only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, map_text, ship_package, stage
from kpiforge.llm.wordblocks import blocks

SALTS = 64  # parts of a language in which its first texts are found
TRAIN = 256
LANDMARKS = 24
MAX_GRAMS = 8192
RIDGE = 1e-3
ROWS = 256  # texts scored by one matrix product
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")  # as _learnable: the Unicode category, not signs such as a half or a circled one

# Bytes after folding: A-Z and the upper half of U+00C0-U+00DE to lower case, other ASCII to a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def folded(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Codes of the distinct n-grams, n = 1 to 3: n in the top byte, then the bytes."""
    b = folded(data).astype(np.int32)
    codes = [b | 1 << 24]
    if len(b) > 1:
        codes.append(b[:-1] << 8 | b[1:] | 2 << 24)
    if len(b) > 2:
        codes.append(b[:-2] << 16 | b[1:-1] << 8 | b[2:] | 3 << 24)
    return np.unique(np.concatenate(codes))


@dataclass
class KernelModel:
    """Languages, feature space (as lookup tables), landmark presence, and regression weights."""

    languages: list[str]
    classes: np.ndarray  # folded byte -> class, 0 for bytes of no n-gram
    tables: list[np.ndarray]  # for n = 1, 2, 3: class code -> feature, the last feature means none
    landmarks: np.ndarray  # features x landmarks, scaled by 1 / sqrt(|G|)
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        none = self.landmarks.shape[0]
        out = np.zeros((len(texts), none + 1), np.float32)
        base = int(self.classes.max()) + 1
        for row, data in enumerate(texts):
            for at in range(0, max(len(data), 1), 1 << 22):
                c = self.classes[folded(data[max(at - 1, 0):at + (1 << 22) + 3])].astype(np.int32)
                out[row, self.tables[0][c]] = 1
                if len(c) > 1:
                    two = c[:-1] * base + c[1:]
                    out[row, self.tables[1][two]] = 1
                    if len(c) > 2:
                        out[row, self.tables[2][two[:-1] * base + c[2:]]] = 1
        return out[:, :none]

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        x = self.presence(texts)
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return (x @ self.landmarks) / norm[:, None] @ self.weights + self.bias


def _sparse_rows(sets: list[np.ndarray], space: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(space)), np.float32)
    for row, codes in enumerate(sets):
        at = np.searchsorted(space, codes)
        at = at[np.append(space, -1)[at] == codes]
        out[row, at] = 1
    return out


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, max_grams: int = MAX_GRAMS,
        ridge: float = RIDGE) -> KernelModel | None:
    """Fit on (language, n-gram codes) pairs, the first ``landmarks`` of each language being landmarks."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    chosen, taken = [], dict.fromkeys(languages, 0)
    for lang, codes in samples:
        if taken[lang] < landmarks:
            taken[lang] += 1
            chosen.append(codes)
    space, count = np.unique(np.concatenate(chosen), return_counts=True)
    space = np.sort(space[np.lexsort((space, -count))[:max_grams]])
    scaled = [x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in (
        _sparse_rows(chosen, space), _sparse_rows([c for _, c in samples], space))]
    mark, rows = (x.astype(np.float64) for x in scaled)
    values, vectors = np.linalg.eigh(mark @ mark.T)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
    phi = np.hstack([rows @ mark.T @ root, np.ones((len(rows), 1))])
    target = np.array([[1.0 if lang == one else -1.0 for one in languages] for lang, _ in samples])
    # Every language weighs the same, whatever its share of the sample.
    share = np.array([1.0 / sum(a == lang for a, _ in samples) for lang, _ in samples])
    gram = (phi * share[:, None]).T @ phi + ridge * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, (phi * share[:, None]).T @ target)

    order = space >> 24
    used = np.unique(np.concatenate([(space >> s & 255)[order > s // 8] for s in (0, 8, 16)]))
    classes = np.zeros(256, np.uint8 if len(used) < 255 else np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    base = len(used) + 1
    tables = [np.full(base**n, len(space), np.int32) for n in (1, 2, 3)]
    for feature, code in enumerate(space.tolist()):
        n = code >> 24
        key = 0
        for s in range(n - 1, -1, -1):
            key = key * base + int(classes[code >> 8 * s & 255])
        tables[n - 1][key] = feature
    return KernelModel(languages, classes, tables, np.ascontiguousarray(mark.T, np.float32),
                       (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull()
                      & F.col("text").rlike(r"\p{L}"))


def learn(docs: DataFrame, per_language: int = TRAIN, **options) -> KernelModel | None:
    """Fit the classifier on at most ``per_language`` texts of every language."""
    # A language may hold most documents: its first texts are found per salt before they meet in one task.
    # A row is known by its doc_id, language and text: repeated ids with other texts are texts of their own.
    order = ("rank", "doc_id", "hash")
    first = Window.partitionBy("lang", "salt").orderBy(*order)
    own = Window.partitionBy("lang").orderBy(*order)
    known = _learnable(docs).select("doc_id", "lang", "text", F.xxhash64("text").alias("hash"))
    picked = (known.select("doc_id", "lang", "hash", F.xxhash64("doc_id").alias("rank")).distinct()
              .withColumn("salt", F.pmod("rank", F.lit(SALTS)))
              .withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
              .withColumn("n", F.row_number().over(own)).where(F.col("n") <= per_language)
              .select("doc_id", "lang", "hash"))
    picked = broadcast_if_small(stage(picked, "langid-picked"))  # per_language rows a language

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [grams(np.frombuffer(t.as_py().encode(), np.uint8)).astype("<i4").tobytes() for t in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())],
                                          ["doc_id", "lang", "grams"])

    rows = map_text(known.join(picked, ["doc_id", "lang", "hash"], "left_semi").dropDuplicates(["doc_id", "lang", "hash"]),
                    ["doc_id", "lang", "text"], "doc_id long, lang string, grams binary", run)
    rows = rows.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id", "lang", "grams").collect()
    return fit([(r.lang, np.frombuffer(r.grams, "<i4")) for r in rows], **options)


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_GRAMS x landmarks numbers

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for i, j, data, off in blocks(batch.column(1)):
            for a in range(0, j - i, ROWS):
                cut = off[a:a + ROWS + 1]
                texts = [data[x:y] for x, y in zip(cut[:-1], cut[1:])]
                letter = [_has_letter(t) for t in texts]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                at = [k for k, ok in enumerate(letter) if ok and known is not None]
                if at:
                    s = known.scores([texts[k] for k in at]).astype(np.float64)
                    best = s.argmax(axis=1)
                    odds = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                    score[at] = 1 / odds.sum(axis=1)
                    for k, b in zip(at, best.tolist()):
                        lang[k] = known.languages[b]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i + a, len(texts)).cast(pa.int64()), pa.array(lang, pa.string()),
                     pa.array(score)], ["doc_id", "lang_pred", "score"])

    ship_package(docs.sparkSession)
    return map_text(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", run)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _has_letter(data: np.ndarray) -> bool:
    if _ASCII_LETTER[data].any():
        return True
    return _LETTER.search(data.tobytes().decode()) is not None


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) with the classifier learned from ``docs`` itself."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
