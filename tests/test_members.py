import io
import random
import re
import subprocess
import sys
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.sources import extract as E, members


def archive(name, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, body)
    return out.getvalue()


PARAGRAPHS = r"(?s)<(?:\w+:)?p(?: [^>]*)?(?<!/)>(.*?)</(?:\w+:)?p>"


def xml(rng):
    parts = ["<w:p>", "<w:p w:x=\"1\">", "</w:p>", "<w:p/>", "<w:pPr/>", "<w:t>é€ a</w:t>", "text ", "\n",
             "<w:r>", "</w:r>", "<p>", "</p>", "<w:p ", "<", "日本"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("step", [1, 3, 17, 10 ** 6])
def test_pulled_nodes_equal_the_whole(step):
    rng = random.Random(step)
    for _ in range(150):
        body = xml(rng)
        got = [*members.pulled(io.BytesIO(body.encode()), "docx", step)]
        assert got == re.findall(PARAGRAPHS, body)
        cells = body.replace("<w:p>", "<t>").replace("</w:p>", "</t>")
        assert [*members.pulled(io.BytesIO(cells.encode()), "xlsx", step)] == re.findall(
            r"<t(?: [^>]*)?>([^<]*)</t>", cells)


def test_a_node_without_end_is_refused():
    with pytest.raises(members.TooLong):
        [*members.pulled(io.BytesIO(b"<t>" + b"x" * 5000), "xlsx", 100, 1000)]


def test_long_member_in_little_memory():
    code = """
import io, resource, sys, zipfile
from quire.sources import members
out = io.BytesIO()
with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
    with z.open("m", "w", force_zip64=True) as f:
        for k in range(300):
            f.write(b"<si><t>some text of a cell</t></si>" * 30000)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with zipfile.ZipFile(out) as z, z.open("m") as stream:
    n = sum(1 for _ in members.pulled(stream, "xlsx"))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, grown = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                                       check=True, timeout=300).stdout.split())
    assert n == 9_000_000 and grown < 50  # 315 MB of text


def test_members_that_inflate_too_far_are_rejected(spark, monkeypatch):
    bomb = archive("word/document.xml", "<w:p>" + "x" * (E.MEMBER_LIMIT + 1) + "</w:p>")
    assert len(bomb) < 100_000
    files = spark.createDataFrame([("bomb", "docx", bomb)], "path string, ext string, content binary")
    assert [(r.part, "inflates to more" in r.reason) for r in E.decode(files).collect()] == [
        ("reject", True)]
    assert [(r.path, r.nodes, "TooLong" in r.reason) for r in members.rejects(
        members.nodes(files)).collect()] == [("bomb", 0, True)]


def test_rows(spark):
    good = archive("xl/sharedStrings.xml", "<sst>" + "".join(
        f"<si><t>c{k}</t></si><si><t> </t></si>" for k in range(13)) + "</sst>")
    files = spark.createDataFrame(
        [("a", "xlsx", good), ("b", "xlsx", b"no archive"), ("c", "xlsx", None),
         ("d", "xlsx", archive("xl/sharedStrings.xml", "<sst/>")), ("e", "txt", b"x")],
        "path string, ext string, content binary")
    found = members.nodes(files).cache()
    lines = {(r.path, r.line_no): r.line for r in members.xlsx_lines(files, found).collect()}
    assert lines == {
        ("a", 0): E.XLSX_TITLE, ("a", 1): E.XLSX_FOUND, ("a", 2): "  |  ".join(f"c{k}" for k in range(5)),
        ("a", 3): "  |  ".join(f"c{k}" for k in range(5, 10)), ("a", 4): "c10  |  c11  |  c12",
        ("d", 0): E.XLSX_TITLE, ("d", 1): E.XLSX_EMPTY}
    assert [(r.path, r.nodes) for r in members.rejects(found).collect()] == [("b", 0)]
    assert found.where(F.col("path") == "e").count() == 0


def test_python_workers_get_small_batches(spark):
    """Rows of a megabyte reach Python in batches of 8 MB, in functions of a column and of batches."""
    rows = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 1 << 20)").alias("t"))

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    assert rows.select(together("t").alias("n")).agg(F.max("n")).first()[0] <= 9 << 20
    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 10 << 20
