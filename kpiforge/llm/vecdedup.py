"""Embedding near-duplicates by sorted projection passes.

Equal vectors are first made one (with their number). Every pass gives each vector a
key: the signs of HASHES random projections, concatenated. The vectors are put in
lexicographic order of their keys and each is compared, by cosine in double precision,
with the WINDOW vectors after it; vectors at a small angle agree in most leading signs,
so they lie near each other in some pass. Verified pairs of all passes are united into
components.

The number of passes follows the number of vectors: a pair at the least cosine shares
the log2(vectors / WINDOW) leading signs that bring it into one window with probability
(1 - angle / pi)^signs, and there are enough passes to meet it with probability RECALL
(copies and closer pairs are met far more often). Links between components that no pass
met are lost; the measured recall is in the README.

A window holds a bounded number of neighbours, so a large group is found as one
component but not link by link. Each component is therefore counted in full afterwards:
members within half the angle of the component's pivot are all linked with each other
(triangle inequality) and are counted without comparing; the other members are compared
with all members, block by block. Blocks of components are bounded and any number of
them may belong to one component; small components share blocks.

Results of odd inputs: a vector that is null, zero, has another number of components
than ``dim`` or holds a null or non-finite component links with nothing: n_links 0, its
own vec_id as component, kept. Repeated rows and repeated vec_ids are vectors of their
own, so a repeated row counts as another vector and both rows carry the smallest vec_id.
A null vec_id is passed over when a component looks for its smallest; a component of
such rows alone has a null component_id, and those rows are kept. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, connected_components, ship_package, stage
from kpiforge.llm.vectors import DIM, pack, rows_of, unpack, usable

COSINE = 0.9
WINDOW = 24
HASHES = 48  # signs in a key: more than log2 of any number of vectors
RECALL = 0.98
BLOCK = 4096
TOGETHER = 4  # passes compared in one job
HEAVY = 10_000  # copies of one vector above which its rows are not joined by shuffle
HEAVY_ROWS = 20_000  # vectors broadcast at most, some 10 MB; beyond, the join is a shuffle that AQE splits
EDGE = 1e-9  # products this near the threshold are computed again in one fixed order
SEED = 20240711

_LINKS = "a long, b long"


def passes_for(vectors: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that bring a pair at exactly ``cosine`` into one window with probability ``recall``."""
    signs = max(1.0, math.log2(max(vectors, 2) / window))
    agree = (1 - math.acos(cosine) / math.pi) ** signs
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(agree, 0.999))))


def unit_vectors(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which of them are not zero."""
    size = np.abs(vectors).max(axis=1, initial=0)
    there = size > 0
    unit = vectors / np.where(there, size, 1)[:, None]
    length = np.sqrt(np.einsum("ij,ij->i", unit, unit))
    return unit / np.where(there, length, 1)[:, None], there


def sort_keys(unit: np.ndarray, passes: int, hashes: int = HASHES) -> np.ndarray:
    """One key per vector and pass: signs of projections, the first one in the highest bit."""
    dim = unit.shape[1]
    normals = np.random.default_rng(SEED).standard_normal((passes * hashes, dim))
    weights = np.int64(1) << np.arange(hashes - 1, -1, -1, dtype=np.int64)
    keys = np.empty((len(unit), passes), np.int64)
    for p in range(passes):
        keys[:, p] = ((unit @ normals[p * hashes:(p + 1) * hashes].T) > 0) @ weights
    return keys


def linked(unit: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the vectors i[k] and j[k] have at least this cosine; the same for both orders of a pair."""
    return np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine


def links_of_products(products: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """products >= cosine, with those at the threshold decided as ``linked`` decides them."""
    found = products >= cosine
    i, j = np.nonzero(np.abs(products - cosine) < EDGE)
    if len(i):
        found[i, j] = np.einsum("ij,ij->i", left[i], right[j]) >= cosine
    return found


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position connected with each of n positions by the links (i, j)."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        for at in (i, j, before[i], before[j]):
            np.minimum.at(low, at, least)
        while True:
            jump = low[low]
            if np.array_equal(jump, low):
                break
            low = jump
        if np.array_equal(before, low):
            break
    return low


def classes(rows: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rid, cls) of every row with a usable vector, and (cls, n, u) of the distinct vectors; u is the unit vector."""
    # a vector is known by its components as doubles, zeros without a sign
    known = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    members = rows.where(usable(vector, dim)).where(F.exists(vector, lambda x: x != 0)).select("rid", known.alias("v"))
    first = stage(members.groupBy("v").agg(F.min("rid").alias("cls"), F.count("*").alias("n")), "vecdedup-distinct")
    # vectors with many copies are few: they are sent to the rows, so that no task meets all copies of one
    heavy = first.where(F.col("n") > HEAVY)
    named = first.where(F.col("n") <= HEAVY).select("v", "cls")
    if heavy.isEmpty():
        rid_cls = members.join(named, "v").select("rid", "cls")
    else:
        sent = broadcast_if_small(heavy.select("v", F.col("cls").alias("hot")), HEAVY_ROWS)
        marked = stage(members.join(sent, "v", "left"), "vecdedup-marked")
        light = marked.where("hot is null").select("rid", "v").join(named, "v").select("rid", "cls")
        rid_cls = light.unionByName(marked.where("hot is not null").select("rid", F.col("hot").alias("cls")))
    rid_cls = stage(rid_cls, "vecdedup-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit, _ = unit_vectors(rows_of(batch.column(2), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(unit, "<f8")], ["cls", "n", "u"])

    return rid_cls, stage(first.select("cls", "n", "v").mapInArrow(run, "cls long, n long, u binary"), "vecdedup-vectors")


def ranked(vectors: DataFrame, passes: int, dim: int, block: int, window: int) -> DataFrame:
    """(cls, pass, place, block) of each vector in the order of each pass; places run on from pass to pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = sort_keys(unpack(batch.column(1), "<f8", dim), passes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(
                        np.arange(0, keys.size + 1, passes, dtype=np.int32), keys.reshape(-1))], ["cls", "keys"])

    keyed = vectors.select("cls", "u").mapInArrow(run, "cls long, keys array<long>")
    ordered = (keyed.select("cls", F.posexplode("keys").alias("pass", "key"))
               .repartitionByRange("pass", "key", "cls").sortWithinPartitions("pass", "key", "cls"))
    # the id is the partition's number and the place in it: places follow from the partitions' counts
    placed = stage(ordered.select("cls", "pass", F.monotonically_increasing_id().alias("m")), "vecdedup-order")
    part = F.shiftright("m", 33)
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    start = placed.sparkSession.createDataFrame(starts, "part long, start long")  # a row per shuffle partition
    place = (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("place")
    return placed.withColumn("part", part).join(F.broadcast(start), "part").select("cls", "pass", place)


def _in_blocks(places: DataFrame, vectors: DataFrame, block: int, window: int) -> DataFrame:
    """The vectors of each block of places and of the ``window`` places after it."""
    home = F.floor(F.col("place") / block)
    early = (F.col("place") % block < window) & (home > 0)
    both = F.when(early, F.array(home, home - 1)).otherwise(F.array(home))
    dealt = places.select("cls", "place", F.explode(both).alias("block"))
    return dealt.join(vectors.select("cls", "u"), "cls")


def verified_links(vectors: DataFrame, passes: int, dim: int, cosine: float, window: int, block: int) -> DataFrame:
    """Links (a, b) that connect the vectors found at ``cosine`` or more; a block's links as a forest."""
    def run(table: pa.Table) -> pa.Table:
        place = table["place"].to_numpy()
        order = np.argsort(place)
        place, cls = place[order], table["cls"].to_numpy()[order]
        unit = unpack(table["u"], "<f8", dim)[order]
        i, j = [], []
        for step in range(1, min(window, len(place) - 1) + 1):
            # the block's own rows alone look ahead; a place is at most ``window`` further on
            at = np.flatnonzero((place[:-step] // block == place[0] // block) & (place[step:] - place[:-step] == step))
            at = at[cls[at] != cls[at + step]]
            at = at[linked(unit, at, at + step, cosine)]
            i.append(at)
            j.append(at + step)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
        # one vector may stand at two places (the end of a pass and the start of the next)
        low = _forest(len(place), i, j)
        tied = np.flatnonzero(low != np.arange(len(place)))
        return pa.table({"a": cls[tied], "b": cls[low[tied]]})

    places = ranked(vectors, passes, dim, block, window)
    found = []
    for first in range(0, passes, TOGETHER):
        some = places.where(F.col("pass").between(first, first + TOGETHER - 1))
        pairs = _in_blocks(some, vectors, block, window).groupBy("block").applyInArrow(run, _LINKS)
        found.append(stage(pairs.distinct(), "vecdedup-links"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _pivot_angles(member: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Members (component, cls, n, u) with their angle to the component's pivot, the vector that names it."""
    pivot = vectors.select(F.col("cls").alias("component"), F.col("u").alias("pivot"))
    both = member.join(vectors, "cls").join(pivot, "component").select("component", "cls", "n", "u", "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.einsum("ij,ij->i", unpack(batch.column(3), "<f8", dim), unpack(batch.column(4), "<f8", dim))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.arccos(np.clip(near, -1, 1)))],
                                                 ["component", "cls", "n", "u", "theta"])

    return both.mapInArrow(run, "component long, cls long, n long, u binary, theta double")


def _count_small(table: pa.Table, dim: int, cosine: float) -> pa.Table:
    """Links of each member within its component, for a block of whole components."""
    order = np.argsort(table["component"].to_numpy(), kind="stable")
    component, cls = table["component"].to_numpy()[order], table["cls"].to_numpy()[order]
    n, unit = table["n"].to_numpy()[order], unpack(table["u"], "<f8", dim)[order]
    links = np.zeros(len(n), np.int64)
    for step in range(1, len(n)):
        at = np.flatnonzero(component[:-step] == component[step:])
        if not len(at):
            break
        at = at[linked(unit, at, at + step, cosine)]
        links[at] += n[at + step]
        links[at + step] += n[at]
    return pa.table({"cls": cls, "links": links})


def _count_blocks(outer: pa.Table, members: pa.Table, dim: int, cosine: float) -> pa.Table:
    """Links between a block of outer members and a block of members of one component.

    An outer member gets its links to all; an inner member those to outer ones.
    """
    if not outer.num_rows or not members.num_rows:
        return pa.table({"cls": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
    a, b = unpack(outer["u"], "<f8", dim), unpack(members["u"], "<f8", dim)
    a_cls, b_cls = outer["cls"].to_numpy(), members["cls"].to_numpy()
    a_n, b_n = outer["n"].to_numpy(), members["n"].to_numpy()
    inner = members["inner"].to_numpy(zero_copy_only=False)
    from_outer, from_inner = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for i in range(0, len(a), 512):
        part = slice(i, i + 512)
        found = links_of_products(a[part] @ b.T, a[part], b, cosine) & (a_cls[part, None] != b_cls[None, :])
        from_outer[part] = found @ b_n
        from_inner += a_n[part] @ found
    return pa.table({"cls": np.concatenate([a_cls, b_cls[inner]]), "links": np.concatenate([from_outer, from_inner[inner]])})


def links_in_components(member: DataFrame, vectors: DataFrame, dim: int, cosine: float, block: int,
                        small: int = 64) -> DataFrame:
    """(cls, links): for each vector of a component the other vectors that it links with, copies counted."""
    angles = stage(_pivot_angles(member, vectors, dim), "vecdedup-angles")
    half = math.acos(cosine) / 2 - EDGE
    inner = F.col("theta") <= half
    size = stage(angles.groupBy("component").agg(
        F.count("*").alias("members"), F.sum(F.when(inner, 0).otherwise(1)).alias("outers"),
        F.coalesce(F.sum(F.when(inner, F.col("n"))), F.lit(0)).alias("inner_n")), "vecdedup-sizes")
    sized = angles.join(size, "component").withColumn("inner", inner)

    few = sized.where(F.col("members") <= small)
    blocks = max(1, math.ceil((size.where(F.col("members") <= small).agg(F.sum("members")).first()[0] or 0) / block))
    packs = few.withColumn("pack", F.pmod(F.xxhash64("component"), F.lit(blocks)))
    counted = packs.select("pack", "component", "cls", "n", "u").groupBy("pack").applyInArrow(
        lambda t: _count_small(t, dim, cosine), "cls long, links long")

    many = sized.where(F.col("members") > small)
    sure = many.where("inner").select("cls", (F.col("inner_n") - F.col("n")).alias("links"))
    part = F.xxhash64("cls")

    def cut(c):
        return F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("long")

    apart = many.where("outers > 0")
    left = apart.where(~F.col("inner")).select(
        "component", F.pmod(part, cut("outers")).alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), cut("members") - 1)).alias("j"), "cls", "n", "u")
    right = apart.select(
        F.col("component").alias("component"), F.explode(F.sequence(F.lit(0).cast("long"), cut("outers") - 1)).alias("i"),
        F.pmod(part, cut("members")).alias("j"), *[F.col(c).alias(c) for c in ("cls", "n", "u", "inner")])
    keys = ["component", "i", "j"]
    compared = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda a, b: _count_blocks(a, b, dim, cosine), "cls long, links long")
    return counted.unionByName(sure).unionByName(compared).groupBy("cls").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, dim: int = DIM, window: int = WINDOW,
                    recall: float = RECALL, block: int = BLOCK, vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    ship_package(spark)
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
                           F.col(vector))
    numbered = stage(numbered, "vecdedup-rows")
    rid_cls, vectors = classes(numbered, dim, vector)
    total = vectors.count()
    if total:
        links = verified_links(vectors, passes_for(total, cosine, window, recall), dim, cosine, window, block)
        member = stage(connected_components(links, "vecdedup-components", split_hubs=True).select(
            F.col("node").alias("cls"), "component"), "vecdedup-named")
        counts = stage(links_in_components(member, vectors, dim, cosine, block), "vecdedup-counts")
    else:
        member = spark.createDataFrame([], "cls long, component long")
        counts = spark.createDataFrame([], "cls long, links long")
    known = vectors.select("cls", "n").join(member, "cls", "left").join(counts, "cls", "left").select(
        "cls", F.coalesce("component", "cls").alias("root"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = numbered.select("rid", "vec_id").join(rid_cls.join(known, "cls"), "rid", "left")
    named = stage(named.select("vec_id", F.coalesce("root", -1 - F.col("rid")).alias("root"),
                               F.coalesce("n_links", F.lit(0)).alias("n_links")), "vecdedup-result")
    smallest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return named.join(smallest, "root").select(
        "vec_id", "n_links", "component_id", F.equal_null("vec_id", "component_id").alias("kept"))


#: All pairs by cosine, where the operator compares neighbours of each pass. Rows are known by their vec_id.
NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM kept a JOIN kept b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
named AS (
  SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
         least(e.vec_id, coalesce((SELECT min(r.b) FROM reached r WHERE r.a = e.vec_id), e.vec_id)) AS component_id
  FROM embeddings e)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM named
"""
