"""Extra columns, whatever their names, neither crash an operator nor change what it says, and come back as they were."""

import pytest
from pyspark.sql import functions as F

from reelspan.llm import decontam, embeddings, jaccard, secrets, toxicity, urlfilter

NAMES = "_rule _verdict _text _base _spans _found _more _assign _access _hex _key _own _gone _done own row key u h p low token rep n v t bucket _doc label doc id r w".split()
TEXT = "password: hunter2hunter2 and the quick brown fox jumps over the lazy dog by the river bank of the old town"


def clashing(frame, but=()):
    return frame.withColumns({k: F.lit(f"mine {k}") for k in NAMES if k not in but})


def same(spark, plain, extra, columns):
    got = extra.collect()
    assert sorted(map(str, plain.select(*columns).collect())) == sorted(str(r) for r in extra.select(*columns).collect())
    assert got and all(r[k] == f"mine {k}" for r in got for k in NAMES if k in extra.columns)
    assert set(NAMES) <= set(extra.columns)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://example.org/en/1x"), (2, "http://a.com/de/"), (3, None)], "page_id long, url string")
    same(spark, urlfilter.filter_urls(pages), urlfilter.filter_urls(clashing(pages)), ["page_id", "host", "path", "rule", "verdict"])


@pytest.mark.parametrize("operator", ["redact", "clean", "one_of_each"])
def test_documents(spark, operator):
    docs = spark.createDataFrame([(k, TEXT if k < 3 else f"{TEXT} {k}" if k < 6 else None, 5) for k in range(8)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(9, "what nobody has written anywhere in these few documents of a test at all")], "item_id long, text string")
    run = {"redact": secrets.redact, "clean": lambda d: decontam.clean(d, items), "one_of_each": jaccard.one_of_each}[operator]
    same(spark, run(docs), run(clashing(docs)), docs.columns)


def test_scores(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    model = toxicity.fitted([])
    same(spark, toxicity.score(docs, model), toxicity.score(clashing(docs), model), ["doc_id", "score", "predicted"])


def test_vectors_of_any_size(spark):
    """Squares that overflow or vanish lose no link."""
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 0.0]), (5, [1e308, 0.0]), (6, [0.0, 0.0])]
    got = embeddings.near_duplicates(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
