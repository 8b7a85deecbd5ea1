"""Archives: round trips through tables and files, and damage that must be found."""

import hashlib

import pytest

from reelspan.llm import warc

PAGES = [(1, "http://a/\r\nx", "small"), (2, "u", "big" * 500), (9, None, "big" * 500), (9, "dup", "big" * 500), (4, "v", None), (None, "n", "big" * 500), (5, "w", "small"), (6, "é", "é" * 700)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as kept", "1 as payload")


def test_round_trip(spark):
    got = sorted((tuple(r)[:5] for r in warc.read_archives(warc.build_archives(warc.plan_records(pages(spark)))).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        to = 9 if html and html.startswith("big") and i != 9 else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.build_archives(warc.plan_records(pages(spark).limit(0)))).count() == 0


def test_files_with_a_trained_dictionary(spark, tmp_path):
    many = [(i, f"http://x/{i}", f"<html><title>page {i}</title>" + "<p>" * 20 + f"words of page {i * i} " * 60) for i in range(400)]
    made = warc.build_archives(warc.plan_records(pages(spark, many)))
    assert warc.save_files(made, f"file://{tmp_path}").count() >= 1
    read = warc.read_archives(warc.open_files(spark, str(tmp_path)))
    assert {(r["page_id"], r["payload"].decode()) for r in read.collect()} == {(i, h) for i, _, h in many}
    data = next(tmp_path.glob("*.warc.zst")).read_bytes()
    assert next(warc.frames(data))  # a dictionary was trained


def test_damage_is_found():
    r = warc.record(1, "u", b"x" * 40, hashlib.sha1(b"x" * 40).hexdigest(), None)
    whole = warc.archive([r, r])
    assert [warc.parse(x)["payload"] for x in list(warc.frames(whole))[1:]] == [b"x" * 40] * 2
    for bad in (b"", b"abcd" + whole[4:], whole[:-3], whole[:-20] + b"\0" * 20):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    for old, new in ((b"Content-Length: 1", b"Content-Length: 2"), (b"WARC-Date", b"WARC-Dote"), (b"xxx\r\n\r\n", b"xyx\r\n\r\n"), (b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse(r.replace(old, new))
