"""JSON texts, preset expansion inside documents against a direct recursion, and ways followed by doubling."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reelspan.functions import documents as dc
from reelspan.operators import packs as pk


@pytest.mark.parametrize("text", ['{"a":[1,2.50,-0,1e5,1E400,{"b":null}],"é":"x\\n\\"y","c":{},"d":[]}', "[]", "3", '"s"', "true", "[[],{}]"])
def test_texts_come_back_as_they_were(text):
    assert json.loads(dc.spell(dc.parse(text))) == json.loads(text)
    if "\\n" not in text:
        assert dc.spell(dc.parse(text)) == text


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a" 1}', "{1:2}", "[1 2]", "nul", '{"a":}', "1 2", "]", '{"a":1,}', "[1}", "01"])
def test_what_is_no_json(text):
    with pytest.raises(ValueError):
        dc.parse(text)


def test_flatten_of_a_very_deep_document(spark):
    deep = '{"a":' * 30_000 + "1e5" + "}" * 30_000
    rows = pk.flatten(spark.createDataFrame([(1, deep), (2, '{"n":1E400,"l":[1.0,{"x":1e5}],"e":{}}')], "id long, doc string")).collect()
    assert {(r.path, r.value) for r in rows if r.id == 2} == {("n", "1E400"), ("l", '[1.0,{"x":1e5}]'), ("e", "{}")}
    (one,) = [r for r in rows if r.id == 1]
    assert one.value == "1e5" and one.path.count("/") == 29_999


META = ("schema", "use")


def direct(value, presets, seen, path, problems):
    """What a document means, read off the rule: lists item by item; objects without the loader's keys; a used preset below the own keys."""
    if isinstance(value, list):
        return [direct(v, presets, seen, (*path, str(i)), problems) for i, v in enumerate(value)]
    if not isinstance(value, dict):
        return value
    own = {k: direct(v, presets, seen, (*path, k), problems) for k, v in value.items() if not k.startswith("_") and k not in META}
    ref = value.get("use")
    if not ref:
        return own
    kind = "cycle" if ref in seen else "unknown" if ref not in presets else None if isinstance(presets[ref], dict) else "not an object"
    if kind:
        problems.append(("/".join(path), ref, kind))
        return own
    return laid(direct(presets[ref], presets, {*seen, ref}, path, problems), own)


def laid(below, above):
    return {**below, **{k: laid(below[k], v) if isinstance(v, dict) and isinstance(below.get(k), dict) else v for k, v in above.items()}}


def value_of(rng, depth):
    r = rng.random()
    if depth == 0 or r < 0.25:
        return rng.choice([1, 2, "x", None, True, [], {}])
    if r < 0.4:
        return [value_of(rng, depth - 1) for _ in range(rng.randrange(3))]
    out = {rng.choice("abcd"): value_of(rng, depth - 1) for _ in range(rng.randrange(4))}
    if rng.random() < 0.5:
        out["use"] = rng.choice(["p0", "p1", "p2", "p3", "p4", "gone", ""])
    if rng.random() < 0.2:
        out["_note"] = {"use": "p1"}
    return out


def test_expanded_documents_equal_the_direct_reading(spark):
    rng = random.Random(4)
    presets = {f"p{k}": value_of(rng, 3) for k in range(5)}
    presets["p0"] = {"a": {"b": 1, "use": "p1"}, "c": [{"use": "p2", "d": 5}], "use": "p3"}
    presets["p4"] = [1, {"use": "p0"}]
    docs = {k: value_of(rng, 4) for k in range(400)}
    docs[1000] = [{"use": "p0", "a": {"a": {"use": "p2"}}}, {"x/y": {"use": "gone"}}]
    frame = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs.items()] + [(2000, None)], "id long, doc string")
    given = spark.createDataFrame([(k, json.dumps(v)) for k, v in presets.items()], "preset string, doc string")
    done, bad = pk.expand_documents(frame, given)
    want, problems = {}, []
    for k, d in docs.items():
        told = []
        want[k] = direct(d, presets, set(), (), told)
        problems += [(k, p.replace("x/y", "x~1y"), ref, kind) for p, ref, kind in told]
    assert {r.id: json.loads(r.doc) for r in done.collect()} == want
    assert sorted(map(tuple, bad.collect())) == sorted(problems)
    assert {p[3] for p in problems} == {"cycle", "unknown", "not an object"}


def test_presets_fourteen_deep_inside_lists(spark):
    presets = [(f"p{k}", json.dumps({"l": [{"use": f"p{k + 1}", f"k{k}": k}], "same": k})) for k in range(14)] + [("p14", '{"end":1,"same":14}')]
    done, bad = pk.expand_documents(spark.createDataFrame([("d", '{"use":"p0","same":"own"}')], "id string, doc string"), spark.createDataFrame(presets, "preset string, doc string"))
    (row,) = done.collect()
    at = json.loads(row.doc)
    assert at["same"] == "own" and not bad.collect()
    for k in range(14):
        (at,) = at["l"]
        assert at[f"k{k}"] == k and at["same"] == k + 1
    assert at["end"] == 1


def test_ways_of_five_thousand_steps(spark):
    steps = spark.range(5_000).select(F.col("id").alias("at"), (F.col("id") + 1).alias("to"))
    ways = pk.follow(spark.createDataFrame([(0,), (4_990,)], "start long"), steps)
    assert ways.groupBy("start").count().orderBy("start").collect() == [(0, 5_001), (4_990, 11)]
    assert ways.where("at <> start + depth or loop").count() == 0


def test_ways_that_go_round(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("s", "s"), ("x", "gone")], "at string, to string")
    ways = pk.follow(spark.createDataFrame([("a",), ("c",), ("s",), ("x",), ("y",), (None,)], "start string"), steps)
    assert sorted(map(tuple, ways.collect())) == sorted(
        [("a", "a", 0, False), ("a", "b", 1, False), ("a", "c", 2, False), ("a", "d", 3, False), ("a", "b", 4, True)]
        + [("c", "c", 0, False), ("c", "d", 1, False), ("c", "b", 2, False), ("c", "c", 3, True), ("s", "s", 0, False), ("s", "s", 1, True)]
        + [("x", "x", 0, False), ("x", "gone", 1, False), ("y", "y", 0, False)]
    )
