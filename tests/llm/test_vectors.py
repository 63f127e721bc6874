"""The operators over vectors against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from kpiforge.llm import clustering, hardneg, vecdedup

SCHEMA = "vec_id long, embedding array<float>, label int, q string, rid long, cluster int, n long"
INF = float("inf")


def table(spark, rows):
    """Vectors with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "mine", 7, 7, 7) for i, v, label in rows], SCHEMA)


def planted(seed=5, n=260, dim=64):
    """Random vectors, groups of near copies, exact and scaled copies, and every odd row."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dim).astype(np.float32) / 8, int(rng.integers(0, 4))) for i in range(n)]
    centre = rng.standard_normal(dim)
    for i in range(120):  # near copies, in three groups, some far enough apart to lie at the threshold
        noise = (0.15, 0.25, 0.33)[i % 3]
        rows.append((1000 + i, ((i % 3 + 1) * centre[::(-1) ** (i % 3)] / 8 + noise / 8 * rng.standard_normal(dim)
                                * (i % 3 + 1)).astype(np.float32), i % 4))
    base = rows[3][1]
    rows += [(2000 + i, base, 1) for i in range(40)]
    rows += [(2100, 2 * base, 1), (2100, 2 * base, 1), (2101, -base, 2), (None, base, 0), (None, rows[9][1], 3)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    bad = [(3000, None, 1), (3050, [], 1), (3100, rows[0][1][:-1], 1), (3150, rows[0][1] + [1.0], 2),
           (3200, [None] + rows[0][1][1:], 1), (3250, [INF] + rows[0][1][1:], 1),
           (3300, [float("nan")] + rows[0][1][1:], 1), (3350, [0.0] * dim, 1), (3400, rows[7][1], None),
           (3401, [-0.0] * dim, 2)]
    return rows + bad


@pytest.fixture(scope="module")
def rows():
    return planted()


def good(rows, dim=64):
    return [(i, v, label) for i, v, label in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]


def whole(v):
    return [math.floor(256 * x) for x in v]


# ------------------------------------------------------------------ clusters

def brute_clusters(rows, k, rounds):
    kept = [(i, whole(v)) for i, v, _ in good(rows)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        won = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), w in zip(kept, won) if w == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, w in final if w == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in final), key=repr)


@pytest.mark.parametrize("k", [1, 9, 1000])
def test_clusters_equal_brute_force(spark, rows, k):
    rows = rows[::2] if k == 1000 else rows
    got = clustering.clusters(table(spark, rows), k=k, rounds=2).collect()
    assert sorted(((r.vec_id is None, *r) for r in got), key=repr) == brute_clusters(rows, k, 2)


def test_equal_distances_go_to_the_smaller_number():
    centroids = np.array([[0, 0], [4, 0], [0, 4], [4, 4], [4, 4]])
    normal, threshold = clustering.bisectors(centroids)
    points = np.array([[2, 2], [3, 2], [2, 3], [4, 4], [-5, 9]])
    assert clustering.tournament(points, normal, threshold).tolist() == [0, 1, 2, 3, 2]


def test_empty_clusters_stay():
    centroids = np.array([[0, 0], [-7, 9]])
    assert clustering.moved(centroids, {0: (3, [-4, 5])}).tolist() == [[-2, 1], [-7, 9]]


def test_a_component_too_large_is_refused(spark):
    big = table(spark, [(1, [1e30] + [0.0] * 63, 1)])
    with pytest.raises(Exception, match="would not fit"):
        clustering.clusters(big).collect()
    with pytest.raises(Exception, match="would not fit"):
        hardneg.hard_negatives(big).collect()


# ------------------------------------------------------------- hard negatives

def brute_negatives(rows, step):
    used = [(n, i, whole(v), label) for n, (i, v, label) in enumerate(rows)
            if label is not None and (i, v, label) in good([(i, v, label)])]
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for n, i, v, label in used:
        if i is None or i % step:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, j, w, other in used if m != n]
        for p, pid, _ in sorted((r for r in scored if r[2] == label), key=order)[:5]:
            found = sorted((r for r in scored if r[2] != label and 50 * p <= 100 * r[0] <= 95 * p), key=order)[:3]
            out += [(i, pid, rank + 1, nid, p, s) for rank, (s, nid, _) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [40, 4096])
def test_hard_negatives_equal_brute_force(spark, rows, block):
    got = hardneg.hard_negatives(table(spark, rows), anchor_step=10, block=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_negatives(rows, 10)


def test_labels_move_for_some_ids(spark):
    got = hardneg.relabelled(table(spark, [(7, None, 9), (8, None, 9), (14, None, None), (None, None, 3)])).collect()
    assert [r.label for r in got] == [0, 9, None, 3]


def test_score_ranges_are_whole_and_exact():
    p = np.array([-101, -1, 0, 1, 2, 99, 100, 101, 2**62])
    least, most = hardneg._range(p)
    assert least.tolist() == [-(-50 * int(x) // 100) for x in p]
    assert most.tolist() == [95 * int(x) // 100 for x in p]


def test_bounds_hold_every_score(spark):
    """No window's bounds leave out a score of one of its rows."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    q = (rng.standard_normal((300, 64)) * rng.integers(1, 400, (300, 1))).astype(np.int64)
    q[5] = 0
    refs = np.linalg.qr(rng.standard_normal((64, 4)))[0].T
    norm = np.linalg.norm(q, axis=1)
    angles = np.arccos(np.clip(q / np.where(norm > 0, norm, 1)[:, None] @ refs.T, -1, 1))
    from kpiforge.llm.vectors import pack
    rows = pa.table({"rid": np.arange(300), "vec_id": np.arange(300), "label": np.zeros(300, np.int32), "q": pack(q, "<i4"),
                     "norm": norm, "angles": pack(angles, "<f8"), "near": angles.argmin(axis=1), "angle": angles.min(axis=1)})
    block = hardneg.Windows(rows, 64, 4, width=8)
    low, high = block.bounds(norm, angles)
    scores = q @ block.q.astype(np.int64).T
    for w in range(len(block.cut)):
        part = scores[:, block.span(w)]
        assert (part >= low[:, w, None]).all() and (part <= high[:, w, None]).all()


# ------------------------------------------------------------ near-duplicates

def brute_duplicates(rows, cosine):
    usable = {n: np.array(v, float) for n, (_, v, _) in enumerate(rows) if good([(0, v, 0)]) and any(v)}
    at = list(usable)
    unit = np.array([usable[n] / np.linalg.norm(usable[n]) for n in at])
    near = unit @ unit.T >= cosine
    links = {n: [at[j] for j in np.flatnonzero(near[k]) if j != k] for k, n in enumerate(at)}
    out, seen = [], {}
    for n in range(len(rows)):
        if n not in seen:
            group, stack = {n}, [n]
            while stack:
                for m in links.get(stack.pop(), []):
                    if m not in group:
                        group.add(m)
                        stack.append(m)
            ids = [rows[m][0] for m in group if rows[m][0] is not None]
            seen.update(dict.fromkeys(group, min(ids) if ids else None))
        out.append((rows[n][0], len(links.get(n, [])), seen[n], rows[n][0] == seen[n]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "cosine"), [(16, 0.9), (4096, 0.9), (64, 0.95)])
def test_near_duplicates_equal_brute_force(spark, rows, block, cosine):
    got = vecdedup.near_duplicates(table(spark, rows), cosine=cosine, window=8, recall=0.9999, block=block).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_duplicates(rows, cosine)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of barely over 0.9 among random vectors, with the query's own parameters."""
    rng = np.random.default_rng(8)
    rows, n = [], 1500
    for i in range(n):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        rows.append((2 * i, a.tolist(), 0))
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.902 if i % 2 else 0.89
        rows.append((2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 0))
    got = vecdedup.near_duplicates(table(spark, rows)).where("n_links > 0").collect()
    found = {r.component_id for r in got}
    assert all(i % 4 == 2 for i in found) and len(found) >= 0.95 * n / 2


def test_heavy_copies_take_the_broadcast_path(spark, rows, monkeypatch):
    monkeypatch.setattr(vecdedup, "HEAVY", 10)
    got = vecdedup.near_duplicates(table(spark, rows), window=8, recall=0.9999).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_duplicates(rows, 0.9)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert clustering.clusters(empty).collect() == []
    assert hardneg.hard_negatives(empty).collect() == []
    assert vecdedup.near_duplicates(empty).collect() == []


def test_only_unusable_rows(spark):
    bad = table(spark, [(50, None, 1), (100, [0.0] * 63, 1), (150, [0.0] * 64, None)])
    assert [r.vec_id for r in clustering.clusters(bad).collect()] == [150]
    assert hardneg.hard_negatives(bad).collect() == []
    assert sorted(tuple(r) for r in vecdedup.near_duplicates(bad).collect()) == [
        (50, 0, 50, True), (100, 0, 100, True), (150, 0, 150, True)]
