"""op12 against plain Python: windows, prefixes of both lengths, trees, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from reelspan.llm import suffixtrees as st

SCHEMA = "doc_id long, text string, key string, part string"


def plain(docs):
    """Rows (doc_id, text) -> what remove_repeats says of them."""
    first, words = {}, []
    for doc, text in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words.append(ws)
        if doc is not None:
            for i in range(len(ws) - 19):
                window = tuple(ws[i : i + 20])
                first[window] = min(first.get(window, (doc, 1 << 60)), (doc, 1 << 60))
    own = {}
    for (doc, text), ws in zip(docs, words):
        for i in range(len(ws) - 19):
            own.setdefault((doc, text, tuple(ws[i : i + 20])), i)
    out = []
    for (doc, text), ws in zip(docs, words):
        gone = set()
        for i in range(len(ws) - 19) if doc is not None else ():
            window = tuple(ws[i : i + 20])
            if first[window][0] < doc or own[doc, text, window] < i:
                gone |= set(range(i, i + 20))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def texts(rng, n):
    word = lambda: rng.choice(["a", "b", "the", "été", "x" * 30, f"w{rng.randrange(300)}"])
    passages = [[word() for _ in range(rng.randrange(15, 70))] for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(1, 60))]
            parts += p if rng.random() < 0.7 else p[rng.randrange(len(p)) :]
        out.append("".join(w + rng.choice([" ", "\n", "\t \r", "\x0b\x0c"]) for w in parts))
    return out + [None, "", " ", "a " * 500, "same " * 30, "  " * 3, "long " * 19 + "x" * 100_000, ("again " + "b " * 19) * 40]


@pytest.mark.parametrize("group,seed", [(50_000, 1), (3, 2), (1, 3)])
def test_equals_plain(spark, monkeypatch, group, seed):
    """A small GROUP makes prefixes frequent, so that some or all windows go by the longer one."""
    monkeypatch.setattr(st, "GROUP", group)
    rng = random.Random(seed)
    docs = [(rng.choice([k, k, k, 3, None]), t) for k, t in enumerate(texts(rng, 120))]
    docs += docs[:10]
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA).repartition(6)
    got = st.remove_repeats(frame, rest=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain(docs), key=order)


def test_small_chunks_are_compared_too(monkeypatch):
    """What a chunk doesn't settle is settled by the cells: chunks of one document each give the same stretches as one chunk."""
    rng = random.Random(5)
    own = [t for t in texts(rng, 30) if t]
    raw = np.frombuffer("".join(own).encode(), "u1")
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in own])])
    c = st._Chunk(raw, bounds)
    tree = st.grow(c.symbol, c.windows, c.prints)
    leaf, node = tree.deep()
    told = {}
    ws = [w for t in own for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    for x, n in zip(leaf.tolist(), node.tolist()):
        told.setdefault(n, set()).add(tuple(ws[c.windows[x] : c.windows[x] + 20]))
    assert all(len(v) == 1 for v in told.values())  # one repeat below one node
    count = {}
    for w in c.windows.tolist():
        count[tuple(ws[w : w + 20])] = count.get(tuple(ws[w : w + 20]), 0) + 1
    assert sum(1 for n in count.values() if n > 1) == len(told)
    assert sum(n for n in count.values() if n > 1) == len(leaf)


def test_places_agree_in_equal_windows():
    """Equal windows name the same group, whatever stands around them and whichever prefixes are frequent."""
    rng = random.Random(9)
    same = [f"w{rng.randrange(50)}" for _ in range(20)]
    found = []
    for _ in range(2):
        ws = [f"v{rng.randrange(50)}" for _ in range(30)] + same + [f"u{rng.randrange(50)}" for _ in range(30)]
        raw = np.frombuffer(" ".join(ws).encode(), "u1")
        c = st._Chunk(raw, np.array([0, len(raw)]))
        pairs = (c.pairs[30:49] >> np.uint64(32)).astype("u4")
        found.append([st.places(c.pairs, c.longer, np.array([30]), np.sort(pairs[:n]))[0] for n in (0, 5, 18, 19)])
    assert found[0] == found[1]


def test_empty_table(spark):
    assert st.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents_are_sent_in_pieces_of_bounded_size(monkeypatch):
    """What a task holds doesn't grow with the batch: no more than CHUNK bytes, or one longer text, are split at once."""
    rng = random.Random(8)
    own = [t for t in texts(rng, 60) if t is None or len(t) < 5000] + ["x" * 3000, None, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array([None if k % 7 == 0 else k for k in range(len(own))], pa.int64()), pa.array(own, pa.string())], ["key", "doc_id", "text"])
    seen, split = [], st.split_words
    monkeypatch.setattr(st, "CHUNK", 2000)
    monkeypatch.setattr(st, "split_words", lambda raw, bounds: seen.append((len(raw), len(bounds) - 1)) or split(raw, bounds))
    sent = {}
    for out in st._ship(3)([batch]):
        for packed in out.column(3):
            raw, size, doc, key, named = st._unpack(packed.as_py(), "u1", "<i8", "<i8", "<i8", "u1")
            ends = np.cumsum(size)
            for k, a, b, known in zip(key.tolist(), ends - size, ends, named.tolist()):
                assert k not in sent and bool(known) == (k % 7 != 0)
                sent[k] = raw[a:b].tobytes().decode()
    assert all(n <= 2000 or docs == 1 for n, docs in seen) and sum(docs for _, docs in seen) == len(own)
    assert sent == {k: "".join(w + " " for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(own)}


def test_hashes_don_t_depend_on_blocks(monkeypatch):
    symbol = np.random.default_rng(3).integers(0, 1 << 60, 1000).astype("u8")
    whole = st._spans(symbol, (2, 5, 20))
    for block in (7, 19, 20, 999):
        monkeypatch.setattr(st, "BLOCK", block)
        assert all(np.array_equal(a, b) for a, b in zip(whole, st._spans(symbol, (2, 5, 20))))
    assert all((w[-n + 1 :] == 0).all() for w, n in zip(whole, (2, 5, 20)))
