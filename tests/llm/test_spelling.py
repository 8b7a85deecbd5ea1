"""op13 against plain Python: the vocabulary, near words, forms and roots, and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reelspan.llm import spelling as sp

SCHEMA = "doc_id long, text string, word string, n string"


def plain_words(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc is not None and (h := zlib.crc32(f"{doc}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = plain_words(docs)
    form, size = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        size[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], size[w], n[form[w]] if form[w] else None))
    return out


def corpus(rng, rows):
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 11))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "x" * 3_000, "x" * 3_001, "Grün×ß", "ÿÀÿÀÿ"]
    out = []
    for k in range(rows):
        text = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(base)
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "b", "É"]) + w[at + rng.randrange(2) :]
            text.append(w.upper() if rng.random() < 0.1 else w)
        out.append((rng.choice([k, k, None]), rng.choice([" ", "1", ", "]).join(text)))
    return out + [(1, None), (2, ""), (3, "ab " * 9)] + out[:5]


@pytest.mark.parametrize("cell,hot,seed", [(150_000, 50_000, 1), (50, 50_000, 2), (300, 4, 3)])
def test_equals_plain(spark, monkeypatch, cell, hot, seed):
    """Small cells make many indexes, a small HOT deals halves to several."""
    monkeypatch.setattr(sp, "CELL", cell)
    monkeypatch.setattr(sp, "HOT", hot)
    docs = corpus(random.Random(seed), 60)
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA).repartition(5)
    got = sp.variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(docs), key=str)


@pytest.mark.parametrize("letters", ["ab", "abcdeé"])
def test_search_finds_all_of_one_error(letters):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(150)})
    found = set()
    for side in (0, 1):
        batch = sp._cell(side, words, np.arange(len(words)), np.ones(len(words), bool), np.ones(len(words), bool))
        found |= set(zip(*(batch.column(k).to_pylist() for k in (0, 1)))) if side > 1 else set()
        turned = [w[::-1] for w in words] if side == 0 else words
        by = sorted(turned)
        text, begin, length = sp._codes(by)
        alphabet, codes = np.unique(text, return_inverse=True)
        index = sp.FMIndex(codes.astype("i8") + 1, length, len(alphabet))
        exact = length // 2 if side == 0 else length - length // 2
        a, b = sp.search(index, codes.astype("i8") + 1, begin, length, exact)
        pairs = [(by[x], by[y]) for x, y in zip(a.tolist(), b.tolist())]
        found |= {(x[::-1], y[::-1]) if side == 0 else (x, y) for x, y in pairs}
        assert all(near(x, y) and y.endswith(x[len(x) - e :]) for (x, y), e in zip(pairs, exact[a].tolist()))
    assert found == {(x, y) for x in words for y in words if near(x, y)}


def test_roots_of_a_long_chain(spark):
    rows = [(f"w{k}", f"w{k + 1}") for k in range(37)]
    got = dict(map(tuple, sp.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert got == {f"w{k}": "w37" for k in range(37)}


def test_empty_table(spark):
    assert sp.variants(spark.createDataFrame([], SCHEMA)).collect() == []
