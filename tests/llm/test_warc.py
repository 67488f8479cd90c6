import gzip
import hashlib
import random

import pytest

from seqloom.llm import warc


def test_framing():
    for t in ("", "a", "é" * 5000, "\r\n0\r\n\r\n"):
        assert warc.unchunked(warc.chunked(t, 7).encode()) == t.encode()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_members_and_segments():
    text = "x" * 1000 + "\r\n\r\nWARC/1.1\r\n" + "é" * 500
    recs = list(warc.records_of("urn:x-page:1:d", "0-1", "http://a/\r\nEvil: 1", "d", text, None, segment=300))
    assert len(recs) > 3
    for raw in ("".join(r + "\r\n\r\n" for r in recs).encode(), b"".join(gzip.compress((r + "\r\n\r\n").encode()) for r in recs)):
        found = list(warc.parse(raw))
        assert [f["warc-type"] for f, _ in found] == ["response"] + ["continuation"] * (len(recs) - 1)
        block = b"".join(b for _, b in found)
        assert len(block) == int(found[-1][0]["warc-segment-total-length"]) and warc.payload_of(block) == text.encode()
    with pytest.raises(ValueError):
        list(warc.parse("".join(r + "\r\n\r\n" for r in recs).encode()[:-30]))


def test_round_trip(spark, tmp_path):
    rnd = random.Random(7)
    html = [None, "", "é" * 499, "é" * 500, "small", "small", "big\r\n\r\n" * 300, "z" * 90_000] + ["page " * rnd.randint(150, 400) for _ in range(30)]
    pages = [(i, None if i == 2 else f"http://h/{i}\n", h, 1) for i, h in enumerate(html)]
    pages += [(100 + i, "u", html[3], 1) for i in range(20)] + [(100, "u", html[7], 1), (119, "again", html[3], 1), (None, "u", html[3], 1), (None, "u", "tiny", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, segment=1000)
    got = warc.read_archives(spark, path).collect()
    want = []
    for p, _, h, _ in pages:
        b = (h or "").encode()
        last = max(q for q, _, x, _ in pages if (x or "") == (h or "") and q is not None) if p is not None else None
        again = p is not None and len(b) >= 1000 and p < last
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last if again else None, True))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_damaged_segments_are_told(spark, tmp_path):
    recs = list(warc.records_of("urn:x-page:5:d", "0-1", "u", "d", "y" * 3000, None, segment=500))
    for name, kept in (("lost", recs[:2] + recs[3:]), ("cut", recs[:-1]), ("twice", [*recs, recs[1]])):
        (tmp_path / f"{name}.warc").write_text("".join(r + "\r\n\r\n" for r in kept), newline="")
        (r,) = warc.read_archives(spark, f"file://{tmp_path}/{name}.warc").collect()
        assert r.page_id == 5 and not r.complete and r.payload_bytes is None
    (tmp_path / "shuffled.warc").write_text("".join(r + "\r\n\r\n" for r in reversed(recs)), newline="")
    (r,) = warc.read_archives(spark, f"file://{tmp_path}/shuffled.warc").collect()
    assert r.complete and r.payload_bytes == 3000


def test_many_pages_of_the_query_come_in_segments(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where(f"length(html) > {warc.SEGMENT}").count()
    assert pages > 100
