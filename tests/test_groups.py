"""Groups as runs of sorted rows: many small ones and a large one, each held against the plain rule."""

import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspan.functions import groups as gr
from reelspan.operators import matching as mt, packs as pk, pixels as px, selection as sel

BOXES = "video_id long, seq long, x int, y int, w int, h int"
BLOBS = "video_id long, segment int, x double, y double, w double, h double, area double"


def test_groups_that_lie_over_batches():
    rows = [(None, 1), (None, 1), (0, 1), (0, None), (2, None), (2, None), (2, 3)]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for size in (1, 2, 3, 7):
        parts = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size])], schema=schema) for i in range(0, len(rows), size)]
        found = [list(zip(*(c.to_pylist() for c in table.slice(a, b - a).columns))) for table, starts in gr.whole_groups(parts, ("a", "b")) for a, b in zip(starts, starts[1:])]
        assert found == [rows[:2], rows[2:3], rows[3:4], rows[4:6], rows[6:]]


def merged_by_hand(rows, beside, above):
    """The first fitting pair of all, again and again."""
    left = [[x, y, x + w, y + h, area] for x, y, w, h, area in sorted(rows, key=lambda r: (r[1], r[0], *r[2:]))]

    def fits(p, q):
        apart = max(p[0] - q[2], q[0] - p[2]) <= beside and max(p[1] - q[3], q[1] - p[3]) <= above
        return apart and max(p[2], q[2]) - min(p[0], q[0]) <= px.WIDEST and max(p[3], q[3]) - min(p[1], q[1]) <= px.TALLEST

    while pair := next(((p, q) for i, p in enumerate(left) for q in left[i + 1 :] if fits(p, q)), None):
        p, q = pair
        p[:] = min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]), p[4] + q[4]
        left = [b for b in left if b is not q]
    return sorted((x, y, a) for x, y, _, _, a in left)


@pytest.mark.parametrize("n", [1, 9, 40, px.MANY + 30])
def test_blobs_join_in_the_order_of_the_plain_rule(spark, n):
    rnd = random.Random(n)
    rows = [(v, s, rnd.random(), rnd.random(), rnd.random() / 15, rnd.random() / 15, rnd.random()) for v in range(3) for s in range(2) for _ in range(n)]
    got: dict = {}
    for r in px.cluster_blobs(spark.createDataFrame(rows, BLOBS), 3.0).collect():
        got.setdefault((r["video_id"], r["segment"]), []).append((r["x"], r["y"], r["area"]))
    for key in {r[:2] for r in rows}:
        assert sorted(got[key]) == merged_by_hand([r[2:] for r in rows if r[:2] == key], px.GAP, px.GAP / 2 * 3.0)


def test_blobs_without_a_place_and_a_large_segment(spark):
    rows = [(1, 0, None, 0.1, 0.02, 0.05, 0.001), (1, 0, 0.5, 0.1, 0.02, 0.05, 0.001), (None, 0, 0.5, 0.1, 0.02, 0.05, 0.001)]
    got = sorted(((r["video_id"], r["x"], r["area"]) for r in px.cluster_blobs(spark.createDataFrame(rows, BLOBS)).collect()), key=str)
    assert got == [(1, 0.5, 0.001), (1, None, 0.001), (None, 0.5, 0.001)]
    rnd = np.random.default_rng(1)
    boxes = [np.sort(rnd.random(3000)) if k == 1 else rnd.random(3000) for k in range(2)]
    boxes += [boxes[0] + 0.001, boxes[1] + 0.001, np.ones(3000)]
    began = time.time()
    found = px._joined(boxes, 0.004, 0.004)
    assert sum(f[4] for f in found) == 3000 and time.time() - began < 20  # the plain rule looks at all pairs after every merge


def test_many_small_frames_of_boxes(spark):
    rnd = random.Random(2)
    rows = [(v, s, rnd.randrange(60), rnd.randrange(60), rnd.randrange(1, 30), rnd.randrange(1, 30)) for v in range(2000) for s in range(3) for _ in range(rnd.randrange(1, 8))]
    boxes = spark.createDataFrame(pd.DataFrame(rows, columns=["video_id", "seq", *"xywh"]), BOXES)
    want = []
    for key in {r[:2] for r in rows}:
        unions: list[list] = []
        for x, y, w, h in sorted((r[2:] for r in rows if r[:2] == key), key=lambda b: (b[1], b[0], b[2], b[3])) if key[0] < 20 else []:
            met = next((u for u in unions if x < u[2] and u[0] < x + w and y < u[3] and u[1] < y + h), None)
            if met:
                met[:] = min(met[0], x), min(met[1], y), max(met[2], x + w), max(met[3], y + h)
            else:
                unions.append([x, y, x + w, y + h])
        want += [(*key, a, b, c - a, d - b) for a, b, c, d in unions]
    out = px.merge_boxes(boxes)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # no call for each of many small groups
    assert sorted(tuple(r) for r in out.where("video_id < 20").collect()) == sorted(want)


def test_a_slot_stands_in_few_buckets_however_far_it_looks(spark):
    columns = "video_id long, path string, ts_s double, focus double, signature array<double>, open boolean"
    same, other = [1.0, 2.0, 4.0], [4.0, 2.0, 1.0]
    frames = spark.createDataFrame([(1, "a", 9e11, 50.0, same, True), (1, "b", -8e11, 50.0, same, True), (1, "c", 5.0, 50.0, other, True), (1, "d", 3e12, 50.0, same, True)], columns)
    slots = spark.createDataFrame([(1, 0, "s", 0.0, 50.0, same, False)], "video_id long, slot int, path string, ts_s double, focus double, signature array<double>, open boolean")
    # with buckets of ten seconds these are 2e11 rows for one slot
    assert [r["path"] for r in mt.nearest_same_scene(slots, frames, sel.pearson, 1e12).collect()] == ["b"]
    assert [r["new_path"] for r in sel.open_eyes(slots, frames, frames, radius=1e12, window=1e12).collect()] == ["b"]
    assert mt.near_in_time(frames, slots.select("video_id", "slot", F.col("ts_s").alias("slot_s")), "slot_s", 1e12).count() == 3


def test_images_go_through_in_pieces(spark):
    n = 3 * px.PIECE + 1
    rng = np.random.default_rng(3)
    looks = [rng.integers(0, 256, (3, 4, 3), dtype="u1") for _ in range(n)]
    images = spark.createDataFrame([(1, k, 3, 4, bytearray(x.tobytes())) for k, x in enumerate(looks)], "video_id long, seq long, height int, width int, data binary").coalesce(1)
    whole = px.color_histograms(images)
    sizes = whole.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert "MapInArrow" in whole._jdf.queryExecution().toString() and sizes.agg(F.sum("n")).first()[0] == n
    got = {r["seq"]: r for r in whole.collect()}
    for k, x in enumerate(looks):
        assert np.allclose(got[k]["descriptor"], px.describe(x)) and np.count_nonzero(got[k]["hist"]) == len({tuple(p) for p in (x >> 5).reshape(-1, 3)})
    assert {r["seq"]: r["hist"] for r in px.color_histograms(images, described=False).collect()} == {k: r["hist"] for k, r in got.items()}


def test_cells_of_a_frame_count_once_and_travel_as_counts(spark):
    boxes = [(1, 0, 0, 0, 80, 80), (1, 0, 30, 30, 60, 60), (1, 1, -50, -50, 60, 60), (1, 2, None, 0, 5, 5), (1, None, 0, 0, 5, 5), (2, 0, 500, 500, 5, 5)]
    seen = spark.createDataFrame(boxes, "video_id long, seq long, x int, y int, w int, h int")
    overlays = spark.createDataFrame([(1, 1, -40, -40, 120, 120), (2, 1, 0, 0, 40, 40)], "video_id long, overlay_id int, x int, y int, w int, h int")
    out = px.face_territory(seen, overlays, 40, 0.5)
    # of three frames two cover cell (0, 0); all other cells one
    assert {r["video_id"]: round(r["territory"], 6) for r in out.collect()} == {1: round(1 / 9, 6), 2: 0.0}
    assert "count(distinct" not in out._jdf.queryExecution().toString().lower()


def test_a_pose_is_made_where_its_frame_is(spark):
    rng = np.random.default_rng(4)
    rows = [(1, k, y, x, *rng.integers(0, 256, 3).tolist()) for k in range(5) for y in range(8) for x in range(8) if (k, y, x) != (4, 7, 7)]
    out = px.pose_signature(spark.createDataFrame(rows, "video_id long, seq long, y int, x int, b int, g int, r int"), (5, 3))
    assert "Generate" not in out._jdf.queryExecution().toString()  # no row for each pixel and cell
    assert [len(r["signature"]) for r in out.collect()] == [15] * 5


def test_many_videos_are_spread_without_a_call_for_each(spark):
    rnd = random.Random(6)
    rows = [(v, f"p{i:03d}", i * 1.0, rnd.random(), rnd.random() < 0.4, [rnd.gauss(0, 1) for _ in range(4)]) for v in range(300) for i in range(rnd.randrange(1, 40))]
    out = sel.select_spread(spark.createDataFrame(rows, "video_id long, path string, ts_s double, score double, sharp boolean, signature array<double>"), 12, 2.0)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    got: dict = {}
    for r in out.collect():
        got.setdefault(r["video_id"], []).append((r["slot"], r["ts_s"], r["path"]))
    for v in range(300):
        mine = [r for r in rows if r[0] == v]
        shown = [t[1:] for t in sorted(got[v])]
        assert shown == sorted(shown) and len(set(shown)) == len(shown) == min(12, len(mine))
        width = max(r[2] for r in mine) / 12 or 1.0
        best: dict = {}
        for r in (r for r in mine if r[4]):
            k = min(11, int(np.floor(r[2] / width)))
            best[k] = r if k not in best or r[3] > best[k][3] else best[k]
        assert {(r[2], r[1]) for r in best.values()} <= set(shown)


def test_alternates_where_frames_are_missing(spark):
    look = lambda k: [1.0, 2.0, 4.0, k / 100]
    frames = [(1, p, True, look(p), [0.0], look(p * 7 % 5), None) for p in range(0, 40, 2)] + [(2, p, True, look(p), [0.0], look(p), None) for p in range(5)]
    seen = spark.createDataFrame(frames, "video_id long, position long, usable boolean, signature array<double>, identity array<double>, pose array<double>, outfit array<double>")
    origins = spark.createDataFrame([(1, 30), (2, 7)], "video_id long, position long")
    plain, out = sel.alternate_targets(seen, origins), sel.distinct_alternates(seen, origins)
    found = {r["position"] for r in plain.collect()}
    # steps of two and a reach of one on either side of frame 30, of forty positions of which every other has a frame; video 2 has no frame 7
    assert found == {32, 28, 34, 26, 36, 24, 38, 22} and all(r["video_id"] == 1 for r in plain.collect())
    assert {r["position"] for r in out.collect()} == found and sorted(r["place"] for r in out.collect()) == list(range(8))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_packs_are_merged_in_one_pass(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, path string, value string")
    base = rows((1, "a/x", "1"), (1, "a/y/z", "2"), (1, "b", "3"), (1, "c", "[1]"), (2, "a", "1"), (None, "n", "1"))
    over = rows((1, "a/y", "9"), (1, "b/k", "4"), (1, "c", " {} "), (1, "a", "{}"), (3, "q", None), (None, "n", "2"))
    out = pk.deep_merge(base, over)
    want = [(1, "a/x", "1"), (1, "a/y", "9"), (1, "b/k", "4"), (1, "c", " {} "), (2, "a", "1"), (3, "q", None), (None, "n", "1"), (None, "n", "2")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    packs = spark.createDataFrame([(k, '{"a":{"b":1}}') for k in range(50)], "id long, doc string")
    plan = pk.deep_merge(pk.flatten(packs), pk.flatten(packs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 3  # each side is parsed once


def test_documents_are_made_without_a_call_for_each(spark):
    packs = spark.createDataFrame([(f"d{k}", '{"use":"p","k":%d}' % k) for k in range(200)] + [("n", None)], "id string, doc string")
    done, _ = pk.expand_documents(packs, spark.createDataFrame([("p", '{"k":0,"l":[1]}')], "preset string, doc string"))
    assert "FlatMapGroups" not in done._jdf.queryExecution().toString()
    assert {r["id"]: sorted(r["doc"]) for r in done.collect()} == {f"d{k}": sorted('{"k":%d,"l":[1]}' % k) for k in range(200)}


def test_vectors_of_alternates_are_not_sent(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e
    from reelspan.plans import vector_queries as vq

    # a null event, a user without a vector for each event, and a vector that is there twice
    source = e.SMOKE
    at = str(tmp_path)
    events = spark.read.parquet(f"{source}/events.parquet")
    events.withColumn("event_id", F.expr("case when event_id % 50 = 3 then null else event_id end")).write.parquet(f"{at}/events.parquet")
    vectors = spark.read.parquet(f"{source}/embeddings.parquet")
    vectors.where("vec_id % 13 <> 5").union(vectors.where("vec_id = 1")).write.parquet(f"{at}/embeddings.parquet")
    query = e.queries()["join7_alternate_targets"]
    plan = query(spark, source)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2 and "SortMergeJoin" not in plan
    for d in (source, at):
        c, signed = F.col, vq.signed(spark, d)
        frames = signed.select("video_id", c("seq").cast("long").alias("position"), (c("event_id") % 3 > 0).alias("usable"), "signature", F.slice("signature", 1, 8).alias("identity"), c("signature").alias("pose"), F.slice("signature", 9, 8).alias("outfit"))
        want = sel.distinct_alternates(frames, frames.groupBy("video_id").agg(F.floor(F.max("position") / 2).alias("position")), same=0.10)
        got = sorted(map(tuple, query(spark, d).collect()))
        assert got == sorted(map(tuple, want.collect())) and got
    monkeypatch.setattr(vq, "SENT", 0)  # more vectors than may be sent
    assert sorted(map(tuple, query(spark, at).collect())) == got
