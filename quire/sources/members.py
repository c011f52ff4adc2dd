"""Long members of DOCX and XLSX archives, pulled through a window instead of read whole.

A member is inflated in steps; as soon as a paragraph or a shared string is complete, it leaves as a
row and its bytes go. A worker holds a step, one unfinished node of at most ``NODE`` characters
and a batch of rows, however long the member is. What the nodes mean is left to Spark.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.functions import text as X
from quire.plans.durable import settled
from quire.plans.skew import chunked_running
from quire.sources import extract as E

#: bytes inflated at a time, characters of one node, rows and characters of a batch
STEP, NODE, ROWS, CHARS = 256 << 10, 8 << 20, 1000, 4 << 20
#: strings that one task numbers
CHUNK = 100_000

#: the nodes of a format: the tag that begins one, also unfinished at the end, and the whole of it
_NODES = {
    "docx": (re.compile(r"<(?:\w+:)?p(?: [^>]*)?(?:(?<!/)>|$)|<(?:\w+:?)?$"),
             re.compile(r"<(?:\w+:)?p(?: [^>]*)?(?<!/)>(.*?)</(?:\w+:)?p>", re.S)),
    "xlsx": (re.compile(r"<t(?: [^>]*)?(?:>|$)|<$"), re.compile(r"<t(?: [^>]*)?>([^<]*)</t>")),
}
_MEMBER = {"docx": "word/document.xml", "xlsx": "xl/sharedStrings.xml"}


class TooLong(ValueError):
    """A node without an end in reach."""


def pulled(stream: io.BufferedIOBase, ext: str, step: int = STEP, most: int = NODE) -> Iterator[str]:
    """Contents of the nodes of an XML stream, in order, each once it is complete."""
    begins, whole = _NODES[ext]
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    held = ""
    while True:
        data = stream.read(step)
        held += decode(data, not data)
        at = 0
        for m in whole.finditer(held):
            yield m[1]
            at = m.end()
        if not data:
            return
        first = begins.search(held, at)
        held = held[first.start():] if first else ""
        if len(held) > most:
            raise TooLong(f"a node of more than {most} characters")
        # an unfinished node is looked through again only when it has grown by its own length
        grown = step
        while data and grown < len(held) // 2:
            data = stream.read(step)
            held += decode(data, not data)
            grown += step


def nodes(files: DataFrame) -> DataFrame:
    """path, ext, node_no, body of the nodes of DOCX and XLSX files (path, ext, content).

    A file that cannot be read has one row with a ``reason`` behind the nodes before the fault; a
    member without nodes has none. Files of other formats and null contents have no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def table() -> pa.RecordBatch:
            cols = [*zip(*rows)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)],
                                   names=["path", "ext", "node_no", "body", "reason"])

        for batch in batches:
            for path, ext, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                          batch.column(2)):
                no = 0
                try:
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                        with z.open(_MEMBER[ext]) as stream:
                            for body in pulled(stream, ext):
                                rows.append((path, ext, no, body, None))
                                no, size = no + 1, size + len(body)
                                if len(rows) >= ROWS or size > CHARS:
                                    yield table()
                                    rows, size = [], 0
                except Exception as e:  # a broken file must not end the job
                    rows.append((path, ext, no, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield table()
                rows, size = [], 0

    wanted = files.where(F.col("ext").isin(*_NODES) & F.col("content").isNotNull())
    return wanted.select("path", "ext", "content").mapInArrow(
        run, "path string, ext string, node_no bigint, body string, reason string")


def rejects(found: DataFrame) -> DataFrame:
    """Files that could not be read to their end: path, ext, nodes read, reason."""
    return found.where("reason IS NOT NULL").select(
        "path", "ext", F.col("node_no").alias("nodes"), "reason")


def docx_blocks(found: DataFrame) -> DataFrame:
    """Paragraphs and image references as ``extract.docx_blocks`` gives them, from single nodes."""
    para = F.concat(F.lit("<p>"), F.col("body"), F.lit("</p>"))
    parts = found.where("ext = 'docx' AND reason IS NULL").select(
        "path", F.col("node_no").alias("para_no"), F.lit("docx").alias("ext"),
        F.lit("xml").alias("part"), para.alias("body"))
    return E.block_rows(parts.select("path", "para_no", E.docx_paragraph_blocks(F.col("body"))
                                     .alias("_b")))


def xlsx_lines(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, line_no, line: shared strings of files (path, ext), five to a line, below the title.

    Strings are numbered in chunks, so that no task holds a whole sheet.
    """
    edges = rf"^[{X.WS}]+|[{X.WS}]+$"
    text = F.regexp_replace(X.unescape_xml(F.regexp_replace("body", edges, "")), edges, "")
    cells = settled(found.where("ext = 'xlsx' AND reason IS NULL").select(
        "path", "node_no", text.alias("cell")).where("cell <> ''"))
    numbered = chunked_running(cells, ["path"], ["node_no"], F.floor(F.col("node_no") / CHUNK),
                               sums={"number": F.lit(1)})
    row = F.floor((F.col("number") - 1) / E.XLSX_ROW)
    rows = numbered.groupBy("path", row.alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("number", "cell"))).alias("cells")).select(
        "path", (F.col("row") + 2).cast("bigint").alias("line_no"), F.array_join(F.transform(
            "cells", lambda c: c["cell"]), E.XLSX_JOIN).alias("line"))
    bad = found.where("reason IS NOT NULL").select("path")
    with_cells = cells.groupBy("path").agg(F.lit(True).alias("any"))
    heads = files.where("ext = 'xlsx' AND content IS NOT NULL").select("path").join(
        bad, "path", "left_anti").join(with_cells, "path", "left").select("path", F.posexplode(F.array(
            F.lit(E.XLSX_TITLE), F.when(F.col("any"), E.XLSX_FOUND).otherwise(E.XLSX_EMPTY))).alias(
            "line_no", "line"))
    return heads.select("path", F.col("line_no").cast("bigint"), "line").unionByName(rows)
