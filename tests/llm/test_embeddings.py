"""Near-duplicate vectors against all pairs by brute force."""

import numpy as np
import pytest

from reelspan.llm import embeddings


def brute(rows):
    good = [(i, np.array(v, "f8")) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, "f8")).all() and np.any(v)]
    links, label = {}, {i: i for i, _ in good}
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= embeddings.COSINE:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
    changed = True
    while changed:
        changed = False
        for a, more in links.items():
            for b in more:
                low = min(label[good[a][0]], label[good[b][0]])
                for i in (good[a][0], good[b][0]):
                    changed |= label[i] != low
                    label[i] = low
    return sorted([(good[a][0], len(links.get(a, ())), label[good[a][0]]) for a in range(len(good))])


@pytest.mark.parametrize("block", [2000, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + 0.12 * rng.standard_normal(16)).astype("f4").tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(500, rows[0][1]), (500, rows[0][1])]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as n")
    got = [tuple(r) for r in embeddings.near_duplicates(frame).collect()]
    assert len(got) == len(rows)
    want = brute(rows)
    mine = sorted(r[:3] for r in got if r[0] is not None and r[0] not in (900, 901, 902, 903, 904))
    links, found = sum(w[1] for w in want), sum(m[1] for m in mine)
    assert all(m[1] <= w[1] and m[0] == w[0] for m, w in zip(mine, want))
    assert found >= 0.97 * links
    assert [m[2] for m in mine] == [w[2] for w in want]
    assert {r[0]: r[1:] for r in got if r[0] in (900, 901, 902, 903, 904)} == {i: (0, i, True) for i in range(900, 905)}
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_a_chain_in_one_block_stays_whole():
    turn = np.radians(17) * np.array([0, 2, 3, 1])  # links (0, 3), (1, 2) and their bridge (1, 3)
    rows = [{"v": [np.cos(t), np.sin(t)], "buckets": [0], "rep": i, "n": 1} for i, t in enumerate(turn)]
    found = embeddings._compare(0, rows, None)
    assert {a: b for a, b, _ in found if b is not None} == {1: 0, 2: 0, 3: 0}
    assert {a: sum(n for x, b, n in found if x == a and b is None) for a in range(4)} == {0: 1, 1: 2, 2: 1, 3: 2}


@pytest.mark.parametrize("block", [2000, 7])
def test_chains_of_drifting_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, ids = [], rng.permutation(240)
    for chain in range(6):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        rows += [(int(ids[chain * 40 + k]), (np.cos(0.21 * k) * a + np.sin(0.21 * k) * b).tolist()) for k in range(14)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect())
    assert got == [(i, label) for i, _, label in brute(rows)]
