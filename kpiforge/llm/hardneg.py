"""Hard-negative mining by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions. By the
triangle inequality on the sphere the angle between an anchor and a row lies in
[|f - t|, min(f + t, 2 pi - f - t)] for each reference (f, t: their angles to it).
The cosines of that interval, times both norms, bound the inner product; the bounds
are widened by far more than the rounding of the angles. Rows are put in order by
nearest reference and angle to it and cut into windows of WINDOW rows; a window keeps
the least and greatest of its angles and norms. An anchor meets a window only where
the window's bounds overlap what the anchor still looks for:

* positives: a score not below its fifth best so far (same label, not the row itself);
* negatives of a positive with score p: p/2 <= score <= 0.95 p, and not below its third
  best so far (another label).

Only those overlaps get integer scores (a product of doubles that is exact, as every
partial sum is a whole number below 2^53; 64-bit integers where norms allow larger ones).

Work is dealt out in pairs of blocks, about BLOCK anchors and about BLOCK rows each.
Blocks do not follow labels, ids or copies, so a label with a third of all rows, or a
third of all rows being equal, changes no block's size. Each block pair returns its best
five (three) per anchor (and positive), and one window function joins them.

Results of odd inputs: rows with a null label, or a vector that is null, has another
number of components than ``dim`` or holds a null or non-finite component, take no part.
Rows with a null vec_id are no anchors, and as positives or negatives come last among
equal scores. Repeated rows and repeated vec_ids are rows of their own: a copy of an
anchor is one of its other rows. An anchor without another row of its label, and a
positive without a negative in its range (also every positive with a score below zero),
returns no row. An empty table gives an empty result. A vector whose squared norm in
whole numbers reaches 2^62 raises ValueError (scores would not fit 64 bits). Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import ship_package, stage
from kpiforge.llm.vectors import DIM, SCALE, pack, rows_of, unpack, usable, whole_numbers

ANCHOR_STEP, RELABEL_STEP, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
REFERENCES = 16
SAMPLE = 512  # rows, by smallest hash of the vector, from which the references are chosen
BLOCK = 4096
WINDOW = 32
SLACK = 1e-6  # of the product of norms; angles from doubles are off by less than 1e-7

_PACKED = "rid long, vec_id long, label int, q binary, norm double, angles binary, near int, angle double"
_FOUND = "anchor long, anchor_id long, slot int, rid long, vec_id long, score long"
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
_NONE = np.int64(-(2**63))


def references(rows: DataFrame, dim: int, count: int = REFERENCES, sample: int = SAMPLE,
               vector: str = "embedding") -> np.ndarray:
    """Unit vectors far from each other among ``sample`` rows; which ones decides speed, never results."""
    picked = (rows.select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
              .orderBy(F.xxhash64("v"), "v").limit(sample).collect())
    found = np.array([r.v for r in picked], np.float64).reshape(-1, dim)
    found = found[np.abs(found).max(axis=1, initial=0) > 0]
    if not len(found):
        return np.eye(1, dim)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    chosen, nearest = [0], found @ found[0]
    while len(chosen) < min(count, len(found)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, found @ found[chosen[-1]])
    return found[chosen]


def packed_rows(rows: DataFrame, refs: np.ndarray, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Whole-number vectors with norms and angles; ``rows`` has rid, vec_id, label, vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = whole_numbers(rows_of(batch.column(3), dim), 2**31 - 1, scale)
            norm = np.linalg.norm(q.astype(np.float64), axis=1)
            if len(norm) and norm.max() >= 2.0**31:
                raise ValueError("a squared norm is beyond 2^62: scores would not fit 64 bits")
            unit = q / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(unit @ refs.T, -1, 1))
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pack(q, "<i4"), pa.array(norm), pack(angles, "<f8"),
                 pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(near)), near])],
                ["rid", "vec_id", "label", "q", "norm", "angles", "near", "angle"])

    return rows.mapInArrow(run, _PACKED)


def _exact_product(norms_a: np.ndarray, norms_b: np.ndarray):
    """A function for inner products of whole-number vectors that is exact for these norms."""
    largest = norms_a.max(initial=0) * norms_b.max(initial=0)
    kind = np.float64 if largest < 2.0**53 else np.int64
    return kind, lambda a, b: (a @ b.T).astype(np.int64)


class Windows:
    """A block's rows in angular order, cut into windows, with each window's angles and norms."""

    def __init__(self, table: pa.Table, dim: int, refs: int, width: int = WINDOW):
        order = np.lexsort((table["rid"].to_numpy(), table["angle"].to_numpy(), table["near"].to_numpy()))
        self.order, self.width = order, width
        self.q = unpack(table["q"], "<i4", dim)[order]
        self.norm = table["norm"].to_numpy()[order]
        self.label = table["label"].to_numpy()[order]
        self.rid = table["rid"].to_numpy()[order]
        cut = np.arange(0, len(order), width)
        angles = unpack(table["angles"], "<f8", refs)[order]
        self.cut = cut
        self.low, self.high = np.minimum.reduceat(angles, cut), np.maximum.reduceat(angles, cut)
        self.least, self.most = np.minimum.reduceat(self.norm, cut), np.maximum.reduceat(self.norm, cut)

    def bounds(self, norm: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores, anchors by windows."""
        closest = np.zeros((len(norm), len(self.cut)))
        widest = np.full_like(closest, math.pi)
        for r in range(angles.shape[1]):
            f, lo, hi = angles[:, r, None], self.low[None, :, r], self.high[None, :, r]
            np.maximum(closest, np.maximum(lo - f, f - hi), out=closest)
            sums = f + hi
            far = np.where(sums <= math.pi, sums, np.where(f + lo >= math.pi, 2 * math.pi - f - lo, math.pi))
            np.minimum(widest, far, out=widest)
        size = norm[:, None] * self.most[None, :]
        slack = SLACK * size + 1

        def scaled(cosine):
            return norm[:, None] * np.where(cosine >= 0, self.most, self.least) * cosine

        top = scaled(np.cos(closest))
        bottom = norm[:, None] * np.where(np.cos(widest) >= 0, self.least, self.most) * np.cos(widest)
        return bottom - slack, top + slack

    def span(self, w: int) -> slice:
        return slice(self.cut[w], min(self.cut[w] + self.width, len(self.order)))


class Best:
    """The best ``keep`` (score, row) of each query: higher scores first, then the smaller vec_id."""

    def __init__(self, queries: int, keep: int, places: np.ndarray, room: int = 1 << 20):
        self.keep, self.places, self.room = keep, places, room
        self.scores = np.full((queries, keep), _NONE)  # best so far, in ascending order
        self.query, self.row, self.score = [], [], []
        self.held = 0

    def bar(self) -> np.ndarray:
        """A score below this is not among a query's best."""
        return self.scores[:, 0]

    def offer(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """scores[i, j] of query i and row j, where allowed."""
        good = allowed & (scores >= self.scores[queries, :1])
        i, j = np.nonzero(good)
        if not len(i):
            return
        self.query.append(queries[i])
        self.row.append(rows[j])
        self.score.append(scores[i, j])
        self.held += len(i)
        some = np.unique(i)
        merged = np.concatenate([self.scores[queries[some]], np.where(good, scores, _NONE)[some]], axis=1)
        self.scores[queries[some]] = np.sort(np.partition(merged, -self.keep, axis=1)[:, -self.keep:], axis=1)
        if self.held > self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the best alone."""
        if not self.query:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, row, score = (np.concatenate(x) for x in (self.query, self.row, self.score))
        order = np.lexsort((self.places[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.r_[True, query[1:] != query[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        top = np.arange(len(query)) - start < self.keep
        self.query, self.row, self.score = [query[top]], [row[top]], [score[top]]
        self.held = int(top.sum())
        return self.query[0], self.row[0], self.score[0]


def _places(table: pa.Table, order: np.ndarray) -> np.ndarray:
    """Place of each row among equal scores: by vec_id, nulls last, then rid."""
    ids = table["vec_id"].combine_chunks()
    missing = ids.is_null().to_numpy(zero_copy_only=False)[order]
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)[order]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((table["rid"].to_numpy()[order], value, missing))] = np.arange(len(order))
    return rank


def _block_pair(anchors: pa.Table, rows: pa.Table, dim: int, refs: int, negatives: bool) -> pa.Table:
    """The best rows of one block for the anchors of one block."""
    empty = pa.Table.from_pylist([], pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("slot", pa.int32()),
                                                ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
    if not anchors.num_rows or not rows.num_rows:
        return empty
    block = Windows(rows, dim, refs)
    norm, label = anchors["norm"].to_numpy(), anchors["label"].to_numpy()
    rid = anchors["rid"].to_numpy()
    kind, product = _exact_product(norm, block.norm)
    a, b = unpack(anchors["q"], "<i4", dim).astype(kind), block.q.astype(kind)
    bottom, top = block.bounds(norm, unpack(anchors["angles"], "<f8", refs))
    n = len(norm)
    if negatives:
        p = anchors["scores"].combine_chunks()
        width = np.diff(p.offsets.to_numpy())
        slots = int(width.max(initial=0))
        there = np.arange(slots)[None, :] < width[:, None]
        goal = np.zeros((n, slots), np.int64)
        goal[there] = p.flatten().to_numpy(zero_copy_only=False)
        least, most = _range(goal)
        least = np.where(there & (least <= most), least, np.int64(2**63 - 1))
        most = np.where(there, most, _NONE)
    else:
        slots = 1
    best = [Best(n, NEGATIVES if negatives else POSITIVES, _places(rows, block.order)) for _ in range(slots)]
    for w in np.argsort(-top.max(axis=0), kind="stable"):
        span = block.span(int(w))
        at = np.arange(span.start, span.stop)
        if negatives:
            bar = np.stack([np.maximum(least[:, s], best[s].bar()) for s in range(slots)], axis=1)
            meet = ((top[:, w, None] >= bar) & (bottom[:, w, None] <= most)).any(axis=1)
        else:
            meet = top[:, w] >= best[0].bar()
        who = np.flatnonzero(meet)
        if not len(who):
            continue
        scores = product(a[who], b[span])
        same = label[who, None] == block.label[None, span]
        if negatives:
            for s in range(slots):
                best[s].offer(who, at, scores, ~same & (scores >= least[who, s, None]) & (scores <= most[who, s, None]))
        else:
            best[0].offer(who, at, scores, same & (rid[who, None] != block.rid[None, span]))
    out = [empty]
    ids = rows["vec_id"].combine_chunks()
    for s in range(slots):
        query, row, score = best[s].settle()
        out.append(pa.table({"anchor": rid[query], "anchor_id": anchors["vec_id"].take(pa.array(query)),
                             "slot": np.full(len(query), s, np.int32), "rid": block.rid[row],
                             "vec_id": ids.take(pa.array(block.order[row])), "score": score}))
    return pa.concat_tables(out)


def _range(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole scores s with LOW * p <= 100 * s <= HIGH * p, without overflow."""
    whole, rest = np.divmod(positive, 100)
    return LOW * whole - (-LOW * rest) // 100, HIGH * whole + (HIGH * rest) // 100


def _best_in_blocks(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, dim: int, refs: int,
                    negatives: bool) -> DataFrame:
    """The best rows of every block for each anchor."""
    extra = ["scores"] if negatives else []
    left = anchors.select("ablock", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("block"),
                          "rid", "vec_id", "label", "q", "norm", "angles", *extra)
    fields = ("block", "rid", "vec_id", "label", "q", "norm", "angles", "near", "angle")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("ablock"),
                        *[F.col(c).alias(c) for c in fields])  # named anew: both sides come from one table

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _block_pair(a, b, dim, refs, negatives)

    return left.groupBy("ablock", "block").cogroup(right.groupBy("ablock", "block")).applyInArrow(run, _FOUND)


def _top(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The best ``keep`` rows of each key, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def relabelled(rows: DataFrame, label: str = "label", vec_id: str = "vec_id") -> DataFrame:
    """Where vec_id is divisible by RELABEL_STEP the label becomes (label + 1) % LABELS."""
    moved = F.when(F.col(vec_id) % RELABEL_STEP == 0, (F.col(label) + 1) % LABELS).otherwise(F.col(label))
    return rows.withColumn(label, moved.cast("int"))


def hard_negatives(rows: DataFrame, dim: int = DIM, scale: int = SCALE, anchor_step: int = ANCHOR_STEP,
                   block: int = BLOCK, vector: str = "embedding") -> DataFrame:
    """One row per anchor, positive and rank; anchors are the rows whose vec_id is divisible by ``anchor_step``."""
    spark = rows.sparkSession
    ship_package(spark)
    used = rows.where(F.col("label").isNotNull() & usable(vector, dim)).select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("int").alias("label"), F.col(vector))
    refs = references(used, dim, vector=vector)
    packed = stage(packed_rows(used, refs, dim, scale), "hardneg-rows")
    total = packed.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    # in angular order, so that windows are narrow; rid splits equal vectors among blocks
    dealt = packed.repartitionByRange(math.ceil(total / block), "near", "angle", "rid")
    dealt = stage(dealt.withColumn("block", F.spark_partition_id()), "hardneg-blocks")
    row_blocks = dealt.agg(F.max("block")).first()[0] + 1
    queries = dealt.where(F.col("vec_id") % anchor_step == 0)
    anchor_blocks = max(1, math.ceil(queries.count() / block))
    queries = queries.withColumn("ablock", F.pmod(F.xxhash64("rid"), F.lit(anchor_blocks)).cast("int"))

    found = _best_in_blocks(queries, dealt, anchor_blocks, row_blocks, dim, len(refs), False)
    positives = stage(_top(found, ["anchor"], POSITIVES).select(
        "anchor", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "hardneg-positives")
    goals = positives.groupBy("anchor").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda e: e.positive_score).alias("scores"))
    searching = queries.join(goals, queries.rid == goals.anchor).drop("anchor")
    found = _best_in_blocks(searching, dealt, anchor_blocks, row_blocks, dim, len(refs), True)
    negatives = _top(found, ["anchor", "slot"], NEGATIVES).select(
        "anchor", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Every anchor scored against every row, where the operator skips windows out of reach.
HARD_NEGATIVES_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding,
         CASE WHEN vec_id % {RELABEL_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) = {DIM}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
parts AS MATERIALIZED (
  SELECT rid, unnest(range({DIM})) AS i,
         CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
scored AS MATERIALIZED (
  SELECT a.rid AS anchor, b.rid AS rid, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM parts a JOIN parts b USING (i)
  WHERE a.rid IN (SELECT rid FROM kept WHERE vec_id % {ANCHOR_STEP} = 0) GROUP BY 1, 2),
named AS MATERIALIZED (
  SELECT s.anchor, a.vec_id AS anchor_id, a.label AS anchor_label, s.rid, r.vec_id, r.label, s.score
  FROM scored s JOIN kept a ON a.rid = s.anchor JOIN kept r ON r.rid = s.rid),
positives AS MATERIALIZED (
  SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score, anchor_label
  FROM named WHERE label = anchor_label AND rid <> anchor
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, rid) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.vec_id NULLS LAST, n.rid)
            AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN named n ON n.anchor = p.anchor AND n.label <> p.anchor_label
WHERE {LOW} * CAST(p.positive_score AS HUGEINT) <= 100 * CAST(n.score AS HUGEINT)
  AND 100 * CAST(n.score AS HUGEINT) <= {HIGH} * CAST(p.positive_score AS HUGEINT)
QUALIFY rank <= {NEGATIVES}
"""
