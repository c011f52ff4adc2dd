import base64
import gzip
import hashlib
import io
import zlib

import pytest

from quire.llm import warc

FIELDS = "page_id long, url string, html string, payload string, archive string, first long"


def pages(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"),
            (1, "http://a/1\r\nWARC-Type: x", "é\r\n\r\nWARC/1.1\r\n"), (2, "", None), (4, "u", ""),
            (6, "u", long), (7, "u", long), (None, "u", "same"), (None, "u", "alone"), (8, "u", "x"),
            (8, "u", "x"), (11, "u", "Content-Length: 3\r\n\r\n")]
    return spark.createDataFrame([(*r, "own", "own", 0) for r in rows], FIELDS)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.html or "", []).append(r.page_id)
    out = []
    for r in rows:
        ids = [x for x in groups[r.html or ""] if x is not None]
        first = min(ids) if ids else None
        revisit = len(groups[r.html or ""]) > 1 and r.page_id != first
        body = (r.html or "").encode()
        out.append((str(r.page_id), len(body),
                    base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.collect()), key=str)


def test_round_trip_against_brute_force(spark):
    given = pages(spark)
    out = warc.archived(given)
    assert result(out) == brute(given.collect())
    texts = {(r.page_id, r.payload_digest): r.payload for r in out.collect()
             if r.record_type == "response"}
    html = {r.page_id: (r.html or "").encode() for r in given.collect()}
    assert all(bytes(p) == html[i] for (i, _), p in texts.items() if i is not None)


def test_samples(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert result(warc.archived(given)) == brute(given.collect())


def test_small_archives_and_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 3000)
    monkeypatch.setattr(warc, "PART", 500)
    given = pages(spark).coalesce(1)
    assert result(warc.archived(given)) == brute(given.collect())


def test_index_opens_single_records_of_a_readable_file(spark):
    mono = warc.write_monolithic(pages(spark).coalesce(1))
    members, index = warc.normalised(mono)
    before = b"".join(r.data for r in mono.orderBy("archive", "part").collect())
    after = b"".join(r.data for r in members.orderBy("archive", "part").collect())
    plain = gzip.decompress(before)
    assert gzip.decompress(after) == plain
    stream = zlib.decompressobj(wbits=31)
    stream.decompress(before)
    assert stream.eof and not stream.unused_data  # one member for the whole file
    rows = index.orderBy("offset").collect()
    assert len(rows) == 14 and rows[0].record_type == "warcinfo"
    at = 0
    for r in rows:
        assert r.offset == at
        record = gzip.GzipFile(fileobj=io.BytesIO(after[r.offset:r.offset + r.length])).read()
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        fields, _ = warc.header_of(record)
        assert fields["warc-record-id"] == f"<{r.record_id}>"
        at += r.length
    assert at == len(after)


def test_archives_of_many_members_and_cut_ones():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = gzip.compress(record * 3) + gzip.compress(record)
    for size in (1, 7, 10_000):
        parts = [data[k:k + size] for k in range(0, len(data), size)]
        assert list(warc.records(warc.inflated(iter(parts), 16))) == [record] * 4
    with pytest.raises(ValueError):
        list(warc.records(iter([record[:-3]])))


def test_no_rows(spark):
    assert warc.archived(pages(spark).limit(0)).collect() == []
