import gzip
import hashlib

import pytest

from larkspan.llm import warc
from larkspan.session import filesystem, work_path

LONG = "long é " * 400


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string")


@pytest.fixture(scope="module")
def rows():
    copy = "c" * 150
    data = [(9, "u9", copy), (3, "u3", copy), (4, "u\r\n%0D", LONG), (5, None, None), (6, "u6", ""), (7, "u7", "short"), (8, "u8", "short"), (None, "n", LONG + "x"), (3, "u3", copy)]
    return [(*r, "d", "p") for r in data]


def test_round_trip(spark, rows):
    folder = work_path(spark, "test-warc")
    manifest = warc.write_archives(warc.chunk_rows(warc.records(pages(spark, rows)), chunk=64), folder)
    chunks = warc.read_archives(manifest, chunk=50).collect()
    assert max(len(c.data) for c in chunks) <= 64
    got = {}
    for c in sorted(chunks, key=lambda c: c.chunk_no):
        got.setdefault((c.page_id, c.record_type), []).append(c)
    for i, url, html, *_ in rows:
        payload = (html or "").encode()
        kind = "revisit" if i == 9 else "response"
        last = [c for c in got[i, kind] if c.last]
        assert all((c.url, c.bytes_so_far, c.digest_so_far) == (url, len(payload), hashlib.sha256(payload).hexdigest()) for c in last)
        if kind == "response" and i != 3:
            assert b"".join(bytes(c.data) for c in got[i, kind]) == payload
    assert got[9, "revisit"][0].refers_to == 3 and len([c for c in got[3, "response"] if c.last]) == 2
    for m in manifest.collect():
        store, _ = filesystem(folder)
        with store.open_input_stream(m.path) as f:
            plain = gzip.decompress(f.read())
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: ") and plain.endswith(b"\r\n\r\n")


def test_damage_is_seen(spark, rows):
    found = warc.chunk_rows(warc.records(pages(spark, rows[2:3]))).withColumn("digest", warc.F.lit("0" * 64))
    with pytest.raises(Exception, match="has not the digest"):
        warc.write_archives(found, work_path(spark, "test-warc"))


def test_empty(spark):
    manifest = warc.write_archives(warc.chunk_rows(warc.records(pages(spark, []))), work_path(spark, "test-warc"))
    assert warc.read_archives(manifest).count() == 0
