import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import cad as C, dicom as M
from quire.sources import extract as E


def dxf(layers, entities):
    out = ["0", "SECTION", "2", "TABLES", "0", "TABLE", "2", "LAYER", "70", str(len(layers))]
    for name, color, flag in layers:
        out += ["0", "LAYER", "2", name, "70", flag, "62", color]
    out += ["0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
    for kind, items in entities:
        out += ["0", kind]
        for code, value in items:
            out += [str(code), str(value)]
    return "\n".join(out + ["0", "ENDSEC", "0", "EOF"]) + "\n"


def parsed(spark, text):
    d = spark.createDataFrame([(1, text)], "drawing_id int, content string")
    recs = C.records(d)
    layers = C.layers(recs, d)
    return d, layers, C.entities(recs, layers)


def test_plan_layers(spark):
    layers = [("0", "7", "0"), ("MURS", "1", "0"), ("CLOISONS", "5", "1"), ("ELEC", "-2", "0")]
    line = lambda layer, *more: ("LINE", [(8, layer), (10, 1), (20, 2), (11, 30), (21, 40), *more])
    ents = [line("MURS")] * 4 + [line("CLOISONS")] * 2 + [
        ("POINT", [(8, "ELEC")]), ("CIRCLE", [(8, "NEW"), (62, 3), (10, 0), (20, 0), (40, 5)]),
        line("NEW"), ("TEXT", [(8, "MURS"), (10, 0), (20, 50), (40, 2), (1, "abc")]),
        ("LWPOLYLINE", [(8, "MURS"), (70, 1), (10, 1), (20, 1), (10, 9), (20, 3)])]
    d, inv, rows = parsed(spark, dxf(layers, ents))
    got = {r.layer: (r.color_hex, r.is_visible, r.entity_count) for r in inv.collect()}
    assert got == {"0": ("#FFFFFF", True, 0), "MURS": ("#FF0000", True, 6),
                   "CLOISONS": ("#0066FF", False, 2), "ELEC": ("#FFFF00", False, 1),
                   "NEW": ("#00FF00", True, 2)}
    ents = {r.rec: r for r in rows.collect()}
    kinds = [ents[k].kind for k in sorted(ents)]
    assert kinds == ["line"] * 6 + ["circle", "line", "text", "polyline"]
    poly = [r for r in ents.values() if r.kind == "polyline"][0]
    assert [(p.x, p.y) for p in poly.points] == [(1.0, 1.0), (9.0, 3.0)] and poly.is_closed
    # the second entity of an unknown layer takes the color of the first
    assert [r.color_hex for r in ents.values() if r.layer == "NEW"] == ["#00FF00"] * 2
    box = C.extents(rows, d).collect()[0]
    assert (box.min_x, box.min_y, box.max_x, box.max_y) == (-5.0, -5.0, 30.0, 52.0)


def test_empty_drawing(spark):
    d, inv, rows = parsed(spark, "0\nEOF\n")
    assert [(r.layer, r.color_hex) for r in inv.collect()] == [("0", "#333333")]
    box = C.extents(rows, d).collect()[0]
    assert (box.min_x, box.max_x, box.max_y) == (0.0, 800.0, 600.0)


def test_aci_ranges(spark):
    df = spark.createDataFrame([(a,) for a in (1, -5, 19, 20, 255, 0, 256)], "a int")
    got = {r.a: r.h for r in df.select("a", C.aci_hex(F.col("a")).alias("h")).collect()}
    assert got == {1: "#FF0000", -5: "#0066FF", 19: "#FF3333", 20: "#FFA500", 255: "#505050",
                   0: "#0066CC", 256: "#0066CC"}


def element(group, elem, vr, value):
    head = struct.pack("<HH", group, elem) + vr
    if vr in M.LONG_VR:
        return head + b"\0\0" + struct.pack("<I", len(value)) + value
    return head + struct.pack("<H", len(value)) + value


def test_pixels_stay_behind(spark):
    def element(group, elem, vr, value):
        return struct.pack("<HH", group, elem) + vr + struct.pack("<H", len(value)) + value

    head = b"\0" * 128 + b"DICM" + element(0x0010, 0x0010, b"PN", b"\xe0\x7f\x10\x00Doe ") + element(
        0x0028, 0x0010, b"US", struct.pack("<H", 2)) + element(0x0028, 0x0011, b"US", struct.pack("<H", 9000))
    pixels = b"\xe0\x7f\x10\x00OW\0\0" + struct.pack("<I", 36000) + b"\1\2" * 18000
    df = spark.createDataFrame([("a", head + pixels), ("b", head), ("c", head + pixels + pixels)],
                               "object_id string, content binary")
    sizes = {r.object_id: r.n for r in df.select("object_id", F.octet_length(
        M.before_pixels(F.col("content"))).alias("n")).collect()}
    assert sizes["a"] == len(head) + 12 and sizes["c"] == len(head + pixels) + 12
    got = {r.object_id: r for r in M.headers(df).collect()}
    assert {k: (r.rows, r.columns, r.declared_columns, r.has_pixels) for k, r in got.items()} == {
        "a": (2, 4096, 9000, True), "b": (2, 1024, 9000, False), "c": (2, 4096, 9000, True)}
    assert M.samples(df).where("object_id = 'a'").count() == 18000


def test_dicom_headers(spark):
    body = element(0x8, 0x60, b"CS", b"MR\0") + element(0x28, 0x10, b"US", struct.pack("<H", 2))
    sequence = struct.pack("<HH", 0x40, 0x275) + b"SQ\0\0" + struct.pack("<I", M.UNDEFINED) + b"ab" * 5 \
        + M.SEQUENCE_END + b"\0\0\0\0"
    body += sequence + element(0x28, 0x11, b"US", struct.pack("<H", 9999))
    body += element(0x28, 0x100, b"US", struct.pack("<H", 8)) + element(0x28, 0x1053, b"DS", b"2.5 ")
    full = b"\0" * 128 + b"DICM" + body + element(0x7FE0, 0x10, b"OB", bytes(range(10)))
    implicit = struct.pack("<HHI", 0x10, 0x20, 4) + b"ID7 " + b"\0" * 140
    df = spark.createDataFrame([("a", full), ("b", b"short"), ("c", implicit)],
                               "object_id string, content binary")
    got = {r.object_id: r for r in M.headers(df).collect()}
    assert (got["a"].modality, got["a"].rows, got["a"].columns) == ("MR", 2, 4096)
    assert got["a"].rescale_slope == 2.5 and got["a"].has_pixels and got["a"].window_center == 40.0
    assert got["b"].reject == "too_short" and got["b"].modality is None
    assert got["c"].patient_id == "ID7" and (got["c"].rows, got["c"].modality) == (512, "CT")
    raw = [r.raw for r in M.samples(df).orderBy("idx").collect()]
    assert raw == [float(i) for i in range(10)]
    assert {(r.modality, r.objects) for r in M.study_catalogue(M.headers(df)).where(
        "modality is null").collect()} == {(None, 2)}


def test_windowing(spark):
    df = spark.createDataFrame([(v,) for v in (-160.0, -159.9, 40.0, 240.0, 239.9)], "hu double")
    got = [r.i for r in df.select(M.intensity(F.col("hu"), F.lit(40.0), F.lit(400.0)).alias("i")).collect()]
    assert got == [0, 0, 128, 255, 255]
    one = [r.i for r in df.select(M.intensity(F.col("hu"), F.lit(40.0), F.lit(0.0)).alias("i")).collect()]
    assert one == [0, 0, 128, 255, 255]


def zipped(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return buf.getvalue()


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, ext string, content binary")


def lines(df):
    return [r.line for r in df.orderBy("path", "line_no").collect()]


def test_rtf(spark):
    raw = (rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator X;}{\info{\author Me}}"
           rb"Hello {\b World}!\par caf\'e9\tab end\~x \{ok\}}")
    got = E.rtf_text(raw)
    assert got == "Hello World!\ncafé\tend x {ok}"
    assert lines(E.part_lines(E.decode(files(spark, ("a", "rtf", raw))))) == ["Hello World!", "café\tend x {ok}"]


def test_mail(spark):
    plain = b"From: a@x.fr\r\nTo: b@x.fr\r\nSubject: Hi\r\nDate: Mon, 04 Mar 2024 10:00:00 +0100\r\n\r\nl1\r\nl2\r\n"
    html = b"Content-Type: text/html\r\n\r\n<p>one<br>two</p>"
    parts = E.decode(files(spark, ("a", "eml", plain), ("b", "eml", html)))
    got = {r.path: r for r in E.messages(parts).collect()}
    assert (got["a"].subject, got["a"].sender, got["a"].date) == ("Hi", "a@x.fr", "2024-03-04T10:00:00+01:00")
    assert got["b"].subject == "(Sans objet)" and got["b"].sender == "Inconnu"
    assert got["b"].body.startswith("<p>one\ntwo\n\n") and E.attachments(parts).count() == 0


def test_mail_parts_and_encodings(spark):
    inner = (b"Content-Type: multipart/alternative; boundary=\"b1\"\r\n\r\n--b1\r\n"
             b"Content-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable"
             b"\r\n\r\ncaf=E9 =3D long=\r\n line\r\n--b1\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
             b"\r\n--b1--\r\n")
    mail = (b"Subject: =?utf-8?B?w4l0w6k=?= =?utf-8?Q?_=C3=A0_Paris?= now\r\nFrom: =?iso-8859-1?Q?Ren=E9?="
            b" <r@x.fr>\r\nTo: a@x.fr,\r\n b@x.fr\r\nDate: 4 Mar 2024 09:05 GMT\r\n"
            b"Content-Type: multipart/mixed;\r\n boundary=b\r\n\r\npreamble\r\n--b\r\n" + inner +
            b"\r\n--b\r\nContent-Type: application/pdf; name=\"a b.pdf\"\r\n"
            b"Content-Transfer-Encoding: base64\r\n\r\nAAEC\r\nAw==\r\n--b\r\n"
            b"Content-Disposition: attachment\r\n\r\n\xff\xfe\r\n--b--\r\nepilogue")
    parts = E.decode(files(spark, ("m", "eml", mail), ("n", "eml", b""), ("o", "msg", b"\r\nbody only")))
    got = {r.path: r for r in E.messages(parts).collect()}
    m = got["m"]
    assert (m.subject, m.sender, m.recipient) == ("Été à Paris now", "René <r@x.fr>", "a@x.fr, b@x.fr")
    assert m.date == "2024-03-04T09:05:00+00:00" and m.body == "café = long line"
    assert (got["n"].subject, got["n"].body, got["o"].body) == ("(Sans objet)", "", "body only")
    assert sorted((r.attachment_id, r.filename, r.mime_type, r["size"])
                  for r in E.attachments(parts).collect()) == [
        ("att_1", "a b.pdf", "application/pdf", 4), ("att_2", "attachment_2", "text/plain", 2)]


def test_docx_with_image(spark):
    xml = ("<w:document><w:body><w:p><w:r><w:t>First &amp; only</w:t></w:r></w:p><w:p/>"
           "<w:p><w:r><w:t>Before</w:t></w:r><w:drawing><wp:extent cx=\"1270000\" cy=\"1270000\"/>"
           "<a:blip r:embed=\"rId5\"/></w:drawing><w:r><w:t>after</w:t></w:r></w:p>"
           "<w:p><w:r><w:t>TITLE</w:t></w:r></w:p></w:body></w:document>")
    parts = E.decode(files(spark, ("d", "docx", zipped(word__document_xml=xml)), ("bad", "docx", b"zz")))
    got = [(r.kind, r.text, r.is_heading, r.rel_id, r.cx_pt)
           for r in E.docx_blocks(parts).orderBy("para_no", "block_no").collect()]
    assert got == [("paragraph", "First & only", False, None, None),
                   ("paragraph", "Before", False, None, None), ("image", None, False, "rId5", 100.0),
                   ("paragraph", "after", False, None, None), ("paragraph", "TITLE", True, None, None)]
    assert [(r.path, r.ext) for r in E.rejects(parts).collect()] == [("bad", "docx")]


def test_archives(spark):
    odg = zipped(content_xml="<a><t>Un texte</t><n>42</n><s>x</s><t>Deux</t></a>")
    sst = zipped(xl__sharedStrings_xml="<sst>" + "".join(f"<si><t>c{i}</t></si>" for i in range(7)) + "</sst>")
    empty = zipped(other_xml="<a/>")
    parts = E.decode(files(spark, ("a", "odg", odg), ("b", "odt", empty)))
    assert lines(E.part_lines(parts)) == [E.TITLES["odg"], "Un texte", "Deux", E.TITLES["odt"],
                                             "Document diagramme .ODT prêt pour affichage vectoriel."]
    book = E.decode(files(spark, ("x", "xlsx", sst), ("y", "xlsx", empty)))
    assert lines(E.part_lines(book)) == [E.XLSX_TITLE, E.XLSX_FOUND, "c0  |  c1  |  c2  |  c3  |  c4",
                                         "c5  |  c6", E.XLSX_TITLE, E.XLSX_EMPTY]
    everything = E.extract_lines(files(spark, ("a", "odg", odg), ("t", "txt", b"l1\nl2")))
    assert everything.count() == 5
    pages = zipped(**{f"visio__pages__page{n}_xml": f"<a>page {n}</a>" for n in (10, 2, 1)})
    mixed = E.extract_lines(files(spark, ("v", "vsdx", pages), ("p", "png", b"\x89PNG"),
                                  ("q", "xyz", b"a\xff"), ("z", "odt", b"no zip"), ("u", "xyz", b"ok")))
    got = {(r.path, r.line, r.reason) for r in mixed.orderBy("line_no").collect()}
    assert {(p, x) for p, x, _ in got} == {
        ("v", E.TITLES["vsdx"]), ("v", "page 1"), ("v", "page 2"), ("v", "page 10"), ("p", None),
        ("q", None), ("z", None), ("u", "ok")}
    assert {p: r for p, _, r in got if r} == {"p": "no text decoder: image", "q": "not UTF-8",
                                              "z": "BadZipFile: File is not a zip file"}


@pytest.mark.parametrize("name", ["cad_layers", "dicom_headers", "extracted_lines"])
def test_registered_names(name):
    import __spark_entry__ as entry

    assert name in entry.queries() and name in entry.oracle_sql()


def test_numbers_and_places_of_drawing_records(spark):
    assert [C._double(v) for v in ("1.5", "-2e3", "1.0f", ".5D", "0x1p3", "Infinity", "1_000", "", "x", "٣")] == [
        1.5, -2000.0, 1.0, 0.5, 8.0, float("inf"), None, None, None, None]
    assert [C._whole(v) for v in ("+7", "2147483648", "1.0")] == [7, None, None]
    text = "0\nSECTION\n2\nTABLES\r\n0\nTABLE\n2\nLAYER\n0\nLAYER\n62\n-3\n62\nx\n0\nENDTAB\n0\nLINE\n10\n1\n10\n1_0\n"
    df = spark.createDataFrame([(7, text), (8, "0"), (9, None), (10, "")], "drawing_id bigint, content string")
    got = C.records(df).orderBy("rec").collect()
    assert [(r.drawing_id, r.rec, r.type, r.section, r.in_table, r.aci, r.negative, r.x1) for r in got] == [
        (7, 1, "SECTION", "TABLES", "", None, False, 0.0), (7, 3, "TABLE", "TABLES", "LAYER", None, False, 0.0),
        (7, 5, "LAYER", "TABLES", "LAYER", -3, True, 0.0), (7, 8, "ENDTAB", "TABLES", "", None, False, 0.0),
        (7, 9, "LINE", "TABLES", "", None, False, 1.0)]


def test_samples_of_many_objects_come_in_blocks(spark):
    def data(n):
        return (b"\0" * 128 + b"DICM" + b"\x28\x00\x10\x00US\x02\x00\x01\x00" + b"\x28\x00\x11\x00US\x02\x00"
                + n.to_bytes(2, "little") + b"\xe0\x7f\x10\x00OW\x00\x00" + (2 * n).to_bytes(4, "little")
                + np.arange(n, dtype="<u2").tobytes())

    sizes = {str(k): k % 5 for k in range(1, 40)} | {"large": 25}
    df = spark.createDataFrame([*((k, bytearray(data(n))) for k, n in sizes.items()), ("none", None)],
                               "object_id string, content binary").coalesce(1)
    got = sorted((r.object_id, r.idx, r.raw) for r in M.samples(df, block=7).collect())
    assert got == sorted((k, i, float(i)) for k, n in sizes.items() for i in range(n))
    assert M.headers(df).where("reject is null").count() == len(sizes) + 1
