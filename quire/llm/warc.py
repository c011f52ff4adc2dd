"""WARC archives: from one gzip stream to one member a record, with an index of offsets.

An archive that was compressed as a whole can only be read from its beginning. The normaliser
inflates such a stream once, from its parts in order, writes every record as a gzip member of its
own and notes where it begins, so that a record can be read alone afterwards.

An archive is kept as ordered parts (archive, part, data): its bytes are the data of its parts one
after the other. A task holds a part and the record it is in, never an archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import small_side
from quire.plans.durable import settled

#: uncompressed bytes of an archive; bytes of a part; bytes inflated at a time
ARCHIVE, PART, INFLATE = 64 << 20, 1 << 20, 4 << 20
#: digests of payloads that occur twice and may be sent to all workers (about 100 bytes each)
_REPEATED = 500_000
_GZIP = 31  # window bits of zlib that stand for a gzip header
#: fixed values of the format
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_NAME = "urn:page:"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION.decode(), *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A").strip()


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes,
                revisit: bool, first: int | None, date: str) -> bytes:
    """A response with the payload, or a revisit with the headers alone."""
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", f"<{_NAME}{'' if page_id is None else page_id}>"),
              ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_value(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1).decode()}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE),
                   ("WARC-Refers-To", f"<{_NAME}{'' if first is None else first}>")]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return _record(fields, _HTTP.format(len(payload)).encode() + (b"" if revisit else payload))


def write_monolithic(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of one gzip stream each: archive, part, data.

    Of pages with equal payloads the smallest page_id is a response, the others refer to it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"),
                        payload.alias("payload"), F.unhex(F.sha1(payload)).alias("sha1"))
    again = small_side(rows.groupBy("sha1").agg(F.min("page_id").alias("first"),
                                                F.count("*").alias("n")).filter("n > 1")
                       .select(F.col("sha1").alias("again"), "first"), _REPEATED)
    typed = rows.join(again, rows["sha1"] == again["again"], "left").select(
        "page_id", "url", "payload", "sha1", "first",
        (F.col("again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
        .alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        stream, size, part, held = None, 0, 0, []

        def rows_of(data: bytes) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([f"pages-{task:06d}-{serial:04d}.warc.gz"]),
                 pa.array([part], pa.int64()), pa.array([data], pa.binary())],
                names=["archive", "part", "data"])

        for batch in batches:
            for page in batch.to_pylist():
                if stream is None:
                    stream, size, part = zlib.compressobj(wbits=_GZIP), 0, 0
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Date", date),
                                    ("WARC-Record-ID", f"<urn:archive:{task}-{serial}>"),
                                    ("Content-Type", "application/warc-fields")],
                                   b"format: WARC File Format 1.1\r\n")
                    held = [stream.compress(info)]
                record = page_record(page["page_id"], page["url"], page["payload"], page["sha1"],
                                     page["revisit"], page["first"], date)
                held.append(stream.compress(record))
                size += len(record)
                if size >= ARCHIVE:
                    yield rows_of(b"".join(held) + stream.flush())
                    stream, serial = None, serial + 1
                elif sum(map(len, held)) >= PART:
                    yield rows_of(b"".join(held))
                    held, part = [], part + 1
        if stream is not None:
            yield rows_of(b"".join(held) + stream.flush())

    return typed.mapInArrow(run, "archive string, part long, data binary")


def inflated(parts: Iterator[bytes], most: int = INFLATE) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, ``most`` at a time."""
    stream = zlib.decompressobj(wbits=_GZIP)
    for data in parts:
        while data:
            out = stream.decompress(data, most)
            if out:
                yield out
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(wbits=_GZIP)


def header_of(record: bytes) -> tuple[dict[str, str], int]:
    """Fields by small name, and where the block begins."""
    end = record.index(b"\r\n\r\n")
    lines = bytes(record[:end]).decode(errors="replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])
            }, end + 4


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed archive; a part of one at the end is an error."""
    held, at = bytearray(), 0
    need = 0
    for data in stream:
        held += data
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields, block = header_of(held[at:end + 4])
                need = block + int(fields["content-length"]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at:at + need])
            at, need = at + need, 0
        if at > INFLATE:
            del held[:at]
            at = 0
    if len(held) > at:
        raise ValueError("the archive ends inside a record")


def normalised(monolithic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archives with a member for each record, and the sidecar index; both written out.

    members: archive, part, start, data; index: archive, part, offset, length, record_id,
    record_type, target_uri, payload_digest. A record is ``length`` bytes at ``offset`` of its
    archive, and alone a gzip file.
    """
    columns = ["offset", "length", "record_id", "record_type", "target_uri", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((r["archive"], r["data"]) for b in batches for r in b.to_pylist())
        ahead = next(parts, None)
        while ahead is not None:
            archive = ahead[0]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == archive:
                    yield ahead[1]
                    ahead = next(parts, None)

            part = offset = start = 0
            members: list[bytes] = []
            entries: list[dict] = []

            def written() -> pa.RecordBatch:
                kind = pa.list_(pa.struct([(c, pa.int64() if c in columns[:2] else pa.string())
                                           for c in columns]))
                return pa.record_batch(
                    [pa.array([archive]), pa.array([part], pa.int64()),
                     pa.array([start], pa.int64()), pa.array([b"".join(members)], pa.binary()),
                     pa.array([entries], kind)],
                    names=["archive", "part", "start", "data", "entries"])

            for record in records(inflated(own())):
                fields, _ = header_of(record)
                member = zlib.compress(record, wbits=_GZIP)
                entries.append(dict(zip(columns, (
                    offset, len(member), fields.get("warc-record-id", "").strip("<>"),
                    fields.get("warc-type"), fields.get("warc-target-uri"),
                    fields.get("warc-payload-digest")))))
                members.append(member)
                offset += len(member)
                if offset - start >= PART:
                    yield written()
                    members, entries, start, part = [], [], offset, part + 1
            if members:
                yield written()

    entry = ", ".join(f"{c}: {'bigint' if c in columns[:2] else 'string'}" for c in columns)
    # ranges of names hold whole archives and are even, which hashes of a few names are not
    both = settled(monolithic.repartitionByRange("archive").sortWithinPartitions("archive", "part")
                   .mapInArrow(run, "archive string, part long, start long, data binary, "
                                    f"entries array<struct<{entry}>>"))
    index = settled(both.select("archive", "part", F.explode("entries").alias("e"))
                    .select("archive", "part", "e.*"))
    return both.drop("entries"), index


def page_rows(members: DataFrame, index: DataFrame) -> DataFrame:
    """Pages read back by the index: page_id, payload_bytes, payload_digest, record_type,
    refers_to, target_uri, payload (null for a revisit).

    The digest of a response is that of the bytes read; one that differs from its header is an
    error.
    """
    wanted = (index.filter(F.col("record_type").isin("response", "revisit"))
              .groupBy(F.col("archive").alias("of"), F.col("part").alias("no"))
              .agg(F.collect_list(F.struct("offset", "length")).alias("entries")))
    found = members.join(wanted, (F.col("archive") == F.col("of")) & (F.col("part") == F.col("no"))
                         ).select("start", "data", "entries")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
             "target_uri", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
             pa.binary()]

    def number(name: str | None) -> int | None:
        digits = (name or "").strip("<>").removeprefix(_NAME)
        return int(digits) if digits else None

    def page(member: bytes) -> tuple:
        record = zlib.decompress(member, wbits=_GZIP)
        fields, at = header_of(record)
        http, body = header_of(record[at:])
        payload = record[at + body:-4]
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        response = fields["warc-type"] == "response"
        if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
        return (number(fields["warc-record-id"]), int(http["content-length"]), digest,
                fields["warc-type"], number(fields.get("warc-refers-to")),
                fields.get("warc-target-uri"), payload if response else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                a = part["start"]
                cols = zip(*(page(part["data"][e["offset"] - a:e["offset"] - a + e["length"]])
                             for e in part["entries"]))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return found.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, "
                                 "record_type string, refers_to long, target_uri string, "
                                 "payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Pages written as monolithic archives, normalised, and read back by the index.

    A null html is an empty payload; a null url leaves out the target. Rows that repeat a page_id
    and its payload are responses if that page_id is the group's smallest; rows without page_id
    are revisits unless no equal payload has one, then all are responses. No rows give no rows;
    other columns, whatever their names, are not read.
    """
    members, index = normalised(settled(write_monolithic(pages)))
    return page_rows(members, index)


SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, octet_length(body::BLOB) AS n, sha1(body) AS h FROM (
            SELECT page_id, encode(body) AS body FROM p)),
    f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h),
    b AS (SELECT h, first, (unhex(h))::BIT::VARCHAR AS bits FROM f)
    SELECT page_id, n::BIGINT AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
                 + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT
                 + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d JOIN b USING (h)"""
