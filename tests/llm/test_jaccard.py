"""The Jaccard join against all pairs by brute force."""

import random
import re

import pytest

from reelspan.llm import jaccard


def shingles(text):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((i, len(s), label.get(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("leaders", [50, 1])
def test_against_all_pairs(spark, monkeypatch, leaders):
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 4)))
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([6, 30, 80, 300]))] + (passage if g % 2 else [])
        for _ in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, max(1, len(w) // 40) + 1)):
                w[rnd.randrange(len(w))] = word()
            rows.append((len(rows), rnd.choice([" ", "\n"]).join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "É one"), (906, "é one"), (907, "a b c d e f"), (None, rows[0][1]), (3, rows[3][1]), (908, "long " * 20000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as key", "2 as n", "3 as prefix")
    got = [tuple(r) for r in jaccard.join_documents(docs).collect()]
    assert sorted(got, key=str) == brute(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == sum(i is None or i == c for i, _, c in got)


@pytest.mark.parametrize(("agree", "block"), [(7, 400), (2, 400)])
def test_a_cloud_of_copies(spark, monkeypatch, agree, block):
    """Copies at the threshold of each other, a third of all rows; agree 7: no centre is tried, so that the matrix finds all."""
    monkeypatch.setattr(jaccard, "AGREE", agree)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(100)]
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(5, 60)))) for i in range(100)]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w)))
    rows += [(rnd.randrange(2000, 2040), rows[5][1]) for _ in range(30)] + [(7, None), (2001, rows[130][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in jaccard.join_documents(docs).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert jaccard.join_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
