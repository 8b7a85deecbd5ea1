"""op11 against plain Python: trees, proofs, tampering, and odd rows."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from reelspan.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i long, leaf string, t string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[3], doc[2], doc[4], text)))


def tree(nodes):
    """Levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, at, own):
    proof = ""
    for level in levels[:-1]:
        low = at - at % 16
        before, after = "".join(level[low:at]), "".join(level[at + 1 : low + 16])
        proof, own, at = proof + before + after, sha(before + own + after), at // 16
    return proof, own


def plain(docs):
    first = lambda v, empty: (v is not None, empty if v is None else v)
    order = sorted(docs, key=lambda d: (first(d[3] and d[3].encode() if d[3] else d[3] if d[3] is None else b"", b""), first(d[0], 0), leaf(d, d[1])))
    groups = [(k, list(g)) for k, g in groupby(order, key=lambda d: d[3])]
    trees = [tree([leaf(d, d[1]) for d in g]) for _, g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (_, g) in enumerate(groups):
        for at, d in enumerate(g):
            text = d[1]
            if d[0] is not None and text is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            proof, _ = climb(trees[k], at, "")
            rest, _ = climb(top, k, "")
            _, own = climb(trees[k], at, leaf(d, text))
            _, own = climb(top, k, own)
            out.append((d[0], leaf(d, d[1]), trees[k][-1][0], top[-1][0], sha(proof + rest), own, own == top[-1][0]))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("sources,rows", [([None, "", "a", "é", "z"], 600), ([f"s{k}" for k in range(40)], 90), (["one"], 1), (["one"], 17), (["b", "a"], 300)])
def test_manifest_equals_plain(spark, sources, rows):
    rng = random.Random(rows)
    weights = [len(sources)] + [1] * (len(sources) - 1)
    docs = []
    for k in range(rows):
        text = rng.choice([None, "", "Été ABC ÀÉ xyz", "lower", "A" * 70_000, f"Text {k}"])
        docs.append((rng.choice([k, k, k, None, 7]), text, rng.choice([None, "en", ""]), rng.choices(sources, weights)[0], rng.choice([None, k]), k, "clash", "clash"))
    docs += docs[:40]
    got = merkle.audit(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs), key=key)


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_of_some_leaves(spark):
    """Only what leads to the wanted leaves is opened, and what is folded over each path gives the root."""
    docs = [(k, f"text {k}", "en", f"s{k % 3}", k, k, "", "") for k in range(700)]
    rows = spark.createDataFrame(docs, SCHEMA).select("doc_id", "source", merkle.leaf_of(*map(F.col, merkle.FIELDS)).alias("leaf"))
    store = merkle.build(rows, "source", "doc_id")
    some = store.leaves.where("doc_id in (0, 5, 299, 699)").select("doc_id", "t", "i", "h", "leaf")
    found = merkle.prove(store, some).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(r.doc_id for r in found) == [0, 5, 299, 699]
    assert all(r.again == store.root and r.digest == r.leaf for r in found)
    assert all(len(r.path) == len(store.records) + len(store.top) for r in found)
