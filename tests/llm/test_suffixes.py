"""Repeated strings against a plain statement of the rule."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from reelspan.llm import suffixes


def brute(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if i is not None and first[data[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [6_000_000, 700])
def test_against_the_rule(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 90, 300)]
    rows = [(rnd.randrange(1000), text(rnd.randrange(80)) + "".join(rnd.choice(shared) + text(rnd.randrange(60)) for _ in range(rnd.randrange(4)))) for _ in range(60)]
    rows += [(5, None), (6, ""), (7, "a" * 500), (8, "a" * 70), (9, "b" * 3000 + "a" * 60), (None, shared[4]), (1001, shared[4]), (1001, shared[4]), (1002, rows[0][1]), (1003, "z" + rows[0][1][1:]), (2000, text(20_000) + shared[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as key", "'x' as kind", "2 as part")
    assert sorted((tuple(r) for r in suffixes.remove_repeats(docs).collect()), key=str) == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "x" * 60), (2, "x" * 60)], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_repeats(docs, rest=True).collect()} == {1: b"x" * 60, 2: b""}
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def common_string(tries=400_000):
    """Eight letters whose hash is smaller than that of any other string of the texts below, nearly always."""
    raw = np.random.default_rng(1).integers(97, 123, 8 * tries).astype("u1")
    at = int(suffixes._hashes(suffixes._eights(raw)[::8], 8).argmin())
    return raw[8 * at : 8 * at + 8].tobytes().decode()


def around(common, n, seed):
    """Texts all windows of which hold the common string."""
    rnd = random.Random(seed)
    texts = ["".join(common + "".join(rnd.choices(LETTERS, k=30)) for _ in range(rnd.randrange(5, 30))) for _ in range(n)]
    return [t if k % 3 else t[:200] + texts[k // 2][90:400] for k, t in enumerate(texts)]


class Told:
    def __init__(self, value):
        self.value = value


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([k % 7 for k, _ in rows], pa.int64()), pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["check", "doc_id", "text"])


def compared(monkeypatch, pieces, parts, frequent):
    """Most windows that the comparison of what these tasks send holds at once."""
    sent = [r for rows in pieces for b in suffixes._send(parts, Told(frequent))([batch(rows)]) for r in b.to_pylist() if not r["kind"]]
    sent.sort(key=lambda r: (r["part"], r["kind"]))
    most, groups = [0], suffixes.equal_groups
    monkeypatch.setattr(suffixes, "equal_groups", lambda eights, start: (most.append(len(start)), groups(eights, start))[1])
    list(suffixes._compare(parts)([suffixes._batch([tuple(r.values()) for r in sent])]))
    monkeypatch.undo()
    return max(most)


def test_a_common_string_gives_way(spark, monkeypatch):
    common = common_string()
    rows = list(enumerate(around(common, 300, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    windows = sum(len(t) - 49 for _, t in rows)
    assert compared(monkeypatch, [rows], 4, np.zeros(0, "u4")) > windows // 2
    monkeypatch.setattr(suffixes, "GROUP", 20_000)
    monkeypatch.setattr(suffixes, "PARTITION", 15_000)
    frequent = suffixes._frequent(docs.selectExpr("1L as check", "doc_id", "text"), sum(len(t) for _, t in rows))
    assert suffixes._hashes(suffixes._eights(np.frombuffer(common.encode(), "u1")), 8)[0] in frequent
    assert sorted((tuple(r) for r in suffixes.remove_repeats(docs).collect()), key=str) == brute(rows)
    monkeypatch.undo()
    assert compared(monkeypatch, [rows], 4, frequent) < windows // 10


def test_equal_windows_are_not_held_together(monkeypatch):
    monkeypatch.setattr(suffixes, "LIMIT", 1000)
    pieces = [[(k, "a" * 300)] for k in range(200)]
    sent = [r for rows in pieces for b in suffixes._send(1, Told(np.zeros(0, "u4")))([batch(rows)]) for r in b.to_pylist()]
    most, groups = [0], suffixes.equal_groups
    monkeypatch.setattr(suffixes, "equal_groups", lambda eights, start: (most.append(len(start)), groups(eights, start))[1])
    found = [r for b in suffixes._compare(1)([suffixes._batch([tuple(r.values()) for r in sent])]) for r in b.to_pylist()]
    assert 1000 <= max(most) < 2000
    key, _, size = (np.concatenate(x) for x in zip(*(suffixes._unpack(r["packed"], "<i8", "<i8", "<i8") for r in found)))
    assert size.sum() == 199 * 251 and len(set(key.tolist())) == 199


def test_documents_are_packed_in_pieces():
    rows = [(k, "x" * 100_000) for k in range(120)]
    sizes = [len(suffixes._unpack(r["packed"], "u1", "<i8", "<i8", "<u4", "u1")[0]) for b in suffixes._ship(1)([batch(rows)]) for r in b.to_pylist()]
    assert sum(sizes) == 12_000_000 and max(sizes) <= suffixes.CHUNK
