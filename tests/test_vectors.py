"""Clusters and deduplication of videos of any size against plain forms of one group."""

import numpy as np
import pytest

from reelspan.operators import vectors as vec


def plain_clusters(x):
    """Centre, leading components, length 1, farthest-first centres, nearest centre, ids by first appearance."""
    n = len(x)
    if n < 2:
        return [0] * n
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    parts = min(30, n - 1, len(s))
    y = u[:, :parts] * s[:parts]
    norm = np.sqrt((y * y).sum(1, keepdims=True))
    y = np.where(norm > 1e-6, y / np.maximum(norm, 1e-6), y)
    k = max(2, min(8, n // 25 or 2, n // 2))
    centres = [int(np.argmax(y @ y.mean(0)))]
    near = y @ y[centres[0]]
    while len(centres) < min(k, n):
        centres.append(int(np.argmin(near)))
        near = np.maximum(near, y @ y[centres[-1]])
    label = np.argmax(y @ y[centres].T, 1)
    seen = {c: i for i, c in enumerate(dict.fromkeys(label.tolist()))}
    return [seen[c] for c in label.tolist()]


def videos(rng, sizes, dims):
    rows, want = [], {}
    for video, n in enumerate(sizes):
        heads = rng.standard_normal((5, dims)) * 3
        x = heads[rng.integers(0, 5, n)] + rng.standard_normal((n, dims))
        ids = plain_clusters(x)
        for k in range(n):
            rows.append((video, 1000 * video + k, x[k].tolist()))
            want[1000 * video + k] = ids[k]
        rows.append((video, 1000 * video + 999, None))
        want[1000 * video + 999] = -1
    return rows, want


@pytest.mark.parametrize("block", [5_000, 40])
def test_clusters_equal_the_plain_form(spark, monkeypatch, block):
    monkeypatch.setattr(vec, "BLOCK", block)
    rows, want = videos(np.random.default_rng(5), [0, 1, 2, 3, 30, 77, 260, 410], 40)
    got = vec.cluster_characters(spark.createDataFrame(rows, "video_id long, face long, descriptor array<double>").repartition(7))
    assert {r.face: r.character_id for r in got.collect()} == want


def greedy(rows, limit):
    """Best first: a row goes if it is too like a kept one of another frame."""
    kept = []
    for video, face, path, score, x in sorted(rows, key=lambda r: (-r[3], r[1])):
        like = lambda o: np.dot(x, o) / np.sqrt(np.dot(x, x) * np.dot(o, o))
        if x is None or not any(video == v and path != p and o is not None and like(o) > limit for v, _, p, _, o in kept):
            kept.append((video, face, path, score, x))
    return {r[1] for r in kept}


def test_hashed_greedy_equals_the_plain_one(spark):
    rng = np.random.default_rng(8)
    rows, heads = [], rng.standard_normal((40, 24))
    for k in range(900):
        near = heads[rng.integers(40)] + 0.05 * rng.standard_normal(24) * (rng.random() < 0.7)
        x = None if rng.random() < 0.03 else near.tolist()
        rows.append((int(k % 2), k, int(k // 3), float(rng.integers(0, 200)), x))
    pool = spark.createDataFrame(rows, "video_id long, face long, path long, score double, descriptor array<double>")
    got = {r.face for r in vec.deduplicate_hashed(pool, "expression", 0.95).collect()}
    assert got == greedy(rows, 0.95) and 80 < len(got) < 500


def test_recall_of_the_hashing(spark):
    """Pairs just above the limit, which are the hardest: at least 99 of 100 are proposed."""
    rng, rows = np.random.default_rng(11), []
    for k in range(1_500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        angle = np.arccos(0.9505)
        rows += [(1, 2 * k, 2 * k, 2.0, a.tolist()), (1, 2 * k + 1, 2 * k + 1, 1.0, (np.cos(angle) * a + np.sin(angle) * b).tolist())]
    pool = spark.createDataFrame(rows, "video_id long, face long, path long, score double, descriptor array<double>")
    found = {(r.a, r.b) for r in vec.near_edges(pool, 0.95).collect()}
    assert len(found & {(2 * k, 2 * k + 1) for k in range(1_500)}) >= 0.99 * 1_500


def test_copies_make_no_squares(spark):
    rows = [(1, k, k, float(-k), [1.0, 2.0, 3.0]) for k in range(3_000)]
    pool = spark.createDataFrame(rows, "video_id long, face long, path long, score double, descriptor array<double>")
    assert vec.near_edges(pool, 0.95).count() == 2_999
    assert [r.face for r in vec.deduplicate_hashed(pool, "expression", 0.95).collect()] == [0]
