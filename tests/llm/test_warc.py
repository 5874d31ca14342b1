import base64
import gzip
import hashlib
import io

import pytest

from pairloom.llm import warc
from pairloom.llm.common import shared_path


def test_round_trip_against_brute_force(spark):
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "é" * 100_000), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (7, "u", "z"), (7, "u", "z"), (None, None, "only")]
    pages = spark.createDataFrame([(p, u, h, "d") for p, u, h in rows], "page_id long, url string, html string, digest string")
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(-1 if p is None else p, best.get(h or "", -1))
    want = []
    for p, _, h in rows:
        b, top = (h or "").encode(), best[h or ""]
        first = p == top or top == -1
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top))
    assert sorted(map(str, (tuple(r) for r in warc.round_trip(pages).collect()))) == sorted(map(str, want))
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=10**9).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_every_record_is_a_member_at_its_offset(spark):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = shared_path(spark, "warc-test")
    manifest = warc.write_monolithic(warc.with_record_types(pages), folder)
    assert sum(r.n_records for r in manifest.collect()) == 20
    for r in warc.normalise(manifest, folder).collect():
        data = open(f"{folder}/{r.archive}".removeprefix("file:").replace("//", "/"), "rb").read()
        member = gzip.GzipFile(fileobj=io.BytesIO(data[r.offset : r.offset + r.length])).read()
        assert member.startswith(b"WARC/1.1\r\n") and warc.read_record(data[r.offset : r.offset + r.length])[0] == r.page_id


def test_a_cut_archive_is_an_error():
    good = warc._record(1, "u", b"abc", b"0" * 20, "response", None)
    assert len(list(warc.stream_records(iter([good[:30], good[30:]])))) == 1
    with pytest.raises(ValueError):
        list(warc.stream_records(iter([good[:-9]])))
