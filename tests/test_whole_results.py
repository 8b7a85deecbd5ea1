"""Captions keep their text while frames last; packs, presets and upgrades have no depth at which they stop."""

import json

from reelspan.operators import captions as cp
from reelspan.operators import packs as pk

LONG = "The first half of this caption ends right here, in the old hall. The second half of it goes on to the very end."


def test_a_caption_for_one_frame_stays_whole(spark):
    captions = spark.createDataFrame([(1, 0, LONG, 0.0, 5.0), (1, 1, LONG, 100.0, 105.0)], "video_id long, sent_id int, text string, start_s double, end_s double")
    frames = spark.createDataFrame([(1, 0, 1.0), (1, 1, 101.0), (1, 2, 102.0), (1, 3, 500.0)], "video_id long, slot int, ts_s double")
    got = {r["slot"]: r["caption"] for r in cp.claim_captions(captions, frames).collect()}
    assert got[0] == LONG and got[1] + " " + got[2] == LONG and got[3] == ""
    seats = spark.createDataFrame([(1, i) for i in range(3)], "video_id long, frame_id int")
    dealt = {r["frame_id"]: r["caption"] for r in cp.deal_captions(captions, seats).collect()}
    assert dealt[0] + " " + dealt[1] == LONG and dealt[2] == LONG


def test_documents_of_any_depth_and_keys_with_slashes(spark):
    deep = 7
    for k in range(40):
        deep = {f"k{k}": deep}
    docs = spark.createDataFrame([(1, json.dumps({"deep": deep, "a/b": {"c": "x"}, "a": {"b/c": 1, "~": None}, "e": {}, "l": [1, {"q": 2}]})), (2, None)], "id long, doc string")
    got = {r["path"]: r["value"] for r in pk.flatten(docs).collect()}
    assert got.pop("deep/" + "/".join(f"k{k}" for k in reversed(range(40)))) == "7"
    assert got == {"a~1b/c": "x", "a/b~1c": "1", "a/~0": None, "e": "{}", "l": '[1,{"q":2}]'}


def test_an_empty_object_replaces_only_what_is_no_object(spark):
    base = spark.createDataFrame([(1, '{"a": {"x": 1}, "b": 2, "c": [1]}')], "id long, doc string")
    over = spark.createDataFrame([(1, '{"a": {}, "b": {}, "c": {}, "d": {}}')], "id long, doc string")
    got = {r["path"]: r["value"] for r in pk.deep_merge(pk.flatten(base), pk.flatten(over)).collect()}
    assert got == {"a/x": "1", "b": "{}", "c": "{}", "d": "{}"}


def test_chains_of_presets_and_patches_go_to_their_ends(spark):
    presets = spark.createDataFrame([(f"p{i}", f"p{i + 1}" if i < 12 else None) for i in range(13)] + [("x", "y"), ("y", "x")], "preset string, use string")
    packs = spark.createDataFrame([("one", "p0"), ("two", "p5"), ("loop", "x"), ("none", None), ("lost", "q")], "id string, use string")
    chain, problems = pk.expand_use(packs, presets)
    rows = sorted(map(tuple, chain.collect()))
    assert rows == sorted([("one", f"p{i}", i) for i in range(13)] + [("two", f"p{i + 5}", i) for i in range(8)] + [("loop", "x", 0), ("loop", "y", 1)])
    assert sorted(map(tuple, problems.collect())) == [("loop", "x", "cycle"), ("lost", "q", "unknown")]
    # a patch takes only the version right before it, as far as a higher minimum says so
    patches = spark.createDataFrame([(f"{i}.0.0", f"{i - 1}.0.0") for i in range(1, 31)], "version string, min_version string")
    installs = spark.createDataFrame([("old", "0.0.0"), ("new", "29.0.0"), ("done", "30.0.0")], "machine string, version string")
    steps = {tuple(r) for r in pk.upgrade_path(installs, patches).collect()}
    assert steps == {("old", i, f"{i + 1}.0.0") for i in range(30)} | {("new", 0, "30.0.0")}
