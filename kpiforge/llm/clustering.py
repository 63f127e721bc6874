"""Centroid clustering by bisector tournaments, in whole numbers.

Between centroids i < j runs the bisector 2 x . (c_j - c_i) = |c_j|^2 - |c_i|^2. Its
whole-number normal and threshold are computed once a round for every pair of
centroids. A vector meets the centroids in ascending number: the sign of one linear
test against the bisector of the present winner and the next centroid eliminates one
of the two, k - 1 tests leave the nearest, and zero (equal distance) favours the
smaller number. Only the winner's distance is then computed. All numbers are 64-bit
integers, so no rounding decides anything.

Every round is one pass of tasks over the staged vectors. A task sends the count and
sums of each cluster it met, so a cluster that holds a third of all rows costs no
more than any other; the driver holds the centroids (k rows) and nothing else.

Results of odd inputs: a vector that is null, has another number of components than
``dim``, or holds a null or non-finite component has no row in the result. Repeated
rows and repeated vec_ids are vectors of their own. A null vec_id hashes as the empty
string and is returned. Of equal hashes the vector that is smaller in bytes comes
first. With fewer vectors than k each is a centroid. An empty table gives an empty
result. A component above 2^27 in whole numbers raises ValueError (its squared
distances need more than 64 bits). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import ship_package, stage
from kpiforge.llm.vectors import DIM, SCALE, pack, rows_of, unpack, usable, whole_numbers

K = 40
ROUNDS = 5
LIMIT = 1 << 27  # dim * (2 * LIMIT)^2 is within 63 bits for 64 components

RESULT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """normal[i, j] and threshold[i, j]: 2 x . (c_j - c_i) > |c_j|^2 - |c_i|^2 where x is nearer to j."""
    normal = 2 * (centroids[None, :, :] - centroids[:, None, :])
    square = (centroids * centroids).sum(axis=1)
    return normal, square[None, :] - square[:, None]


def tournament(vectors: np.ndarray, normal: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centroid, the smaller of equally near ones."""
    winner = np.zeros(len(vectors), np.int64)
    for j in range(1, len(threshold)):
        side = np.einsum("ij,ij->i", vectors, normal[winner, j]) - threshold[winner, j]
        winner[side > 0] = j
    return winner


def whole_vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(vec_id, q): the usable vectors in whole numbers, packed as 32-bit integers."""
    limit = min(LIMIT, int((2**62 / dim) ** 0.5 / 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = whole_numbers(rows_of(batch.column(1), dim), limit, scale)
                yield pa.RecordBatch.from_arrays([batch.column(0), pack(q, "<i4")], ["vec_id", "q"])

    ship_package(rows.sparkSession)
    return rows.where(usable(vector, dim)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector)).mapInArrow(run, "vec_id long, q binary")


def first_centroids(whole: DataFrame, k: int, dim: int) -> np.ndarray:
    """The k vectors with smallest sha256 of '2:<vec_id>', in that order."""
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.select(name.alias("name"), "q").orderBy("name", "q").limit(k).collect()
    return np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64).reshape(-1, dim)


def cluster_sums(whole: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> (vectors, sum of each component), of the clusters that have vectors: k rows at most."""
    normal, threshold = bisectors(centroids)
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            vectors = unpack(batch.column(0), "<i4", dim).astype(np.int64)
            won = tournament(vectors, normal, threshold)
            count += np.bincount(won, minlength=k)
            np.add.at(total, won, vectors)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": met.astype(np.int32), "n": count[met],
                                          "sums": pa.array(total[met].tolist(), pa.list_(pa.int64()))})

    parts = whole.select("q").mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = "decimal(38,0)"
    counted = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("i", "x")).groupBy(
        "cluster", "i").agg(F.sum(F.col("x").cast(exact)).alias("x"))
    gathered = counted.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("row"))
    return {r.cluster: (int(r.row[0].x), [int(e.x) for e in r.row[1:]]) for r in gathered.collect()}


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Each centroid with vectors becomes floor(sum / count) of theirs, component by component."""
    out = centroids.copy()
    for j, (n, row) in sums.items():
        out[j] = [x // n for x in row]
    return out


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    normal, threshold = bisectors(centroids)
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unpack(batch.column(1), "<i4", dim).astype(np.int64)
            won = tournament(vectors, normal, threshold)
            off = vectors - centroids[won]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(won.astype(np.int32)), pa.array(np.einsum("ij,ij->i", off, off))],
                ["vec_id", "cluster", "distance"])

    return whole.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
             vector: str = "embedding") -> DataFrame:
    """One row per usable vector: its cluster, squared distance, the inertias and its centroid's digest."""
    spark = rows.sparkSession
    whole = stage(whole_vectors(rows, dim, scale, vector), "clusters-whole")
    centroids = first_centroids(whole, k, dim)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(whole, centroids))
    found = stage(assigned(whole, centroids), "clusters-found")
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    labels = spark.createDataFrame([(j, s, sum(sums.values()), digests[j]) for j, s in sums.items()],
                                   "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(labels), "cluster").select(  # k rows at most
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    """Assignment n and the centroids after it."""
    return f"""
near{n} AS MATERIALIZED (
  SELECT rn, min(d * 1000 + j) % 1000 AS j, min(d * 1000 + j) // 1000 AS d FROM (
    SELECT v.rn, c.j, CAST(sum((v.x - c.x) * (v.x - c.x)) AS HUGEINT) AS d FROM parts v JOIN cent{n} c USING (i) GROUP BY v.rn, c.j)
  GROUP BY rn),
mean{n} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM near{n} JOIN parts USING (rn) GROUP BY j, i),
cent{n + 1} AS MATERIALIZED (
  SELECT c.j, c.i, CAST(CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS x
  FROM cent{n} c LEFT JOIN mean{n} m ON m.j = c.j AND m.i = c.i),"""


#: Every distance to every centroid in each round, where the operator tests signs.
CLUSTERS_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, embedding
  FROM embeddings WHERE len(embedding) = {DIM}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
parts AS MATERIALIZED (
  SELECT rn, unnest(range({DIM})) AS i,
         CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept),
seed AS (SELECT rn, row_number() OVER (ORDER BY h, rn) - 1 AS j FROM kept QUALIFY j < {K}),
cent0 AS MATERIALIZED (SELECT j, i, x FROM seed JOIN parts USING (rn)),
{''.join(_round_sql(n) for n in range(ROUNDS))}
last AS MATERIALIZED (
  SELECT rn, min(d * 1000 + j) % 1000 AS j, min(d * 1000 + j) // 1000 AS d FROM (
    SELECT v.rn, c.j, CAST(sum((v.x - c.x) * (v.x - c.x)) AS HUGEINT) AS d
    FROM parts v JOIN cent{ROUNDS} c USING (i) GROUP BY v.rn, c.j)
  GROUP BY rn),
digest AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM cent{ROUNDS} GROUP BY j)
SELECT k.vec_id, CAST(l.j AS INTEGER) AS cluster, CAST(l.d AS BIGINT) AS distance,
       CAST(sum(l.d) OVER (PARTITION BY l.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(l.d) OVER () AS BIGINT) AS inertia, g.h AS centroid_sha256
FROM last l JOIN kept k USING (rn) JOIN digest g ON g.j = l.j
"""
