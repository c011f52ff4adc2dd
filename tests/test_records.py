import random

from pyspark.sql import functions as F

from quire.operators import annotations as A, assemble as B, forms as Fo

ANN = ("doc_id string, seq bigint, annotation_type string, page_number int, x double, y double, "
       "width double, height double, color string, author string, created_at string, content string, "
       "points array<struct<x:double,y:double>>, reason string")


def annotations(spark):
    return spark.createDataFrame([
        ("d", 0, "highlight", 1, 10.0, 20.0, 30.0, 5.0, "#fef08a", "Ann & Co", "2024", "note <1>", [], None),
        ("d", 1, "note", 1, 1.5, 2.0, 3.0, 4.0, "#f59e0b", "B", "2024", "hello", [], None),
        ("d", 2, "redact", 1, 50.0, 700.0, 300.0, 25.0, "#000000", "C", "2024", None, [], "RGPD"),
        ("d", 3, "freehand", 2, 0.0, 0.0, 9.0, 9.0, "#111111", "D", "2024", None, [(1.0, 2.0)], None),
        ("d", 4, "underline", 3, 0.0, 0.0, 9.0, 9.0, "#111111", "D", "2024", "lost", [], None)], ANN)


def test_xfdf_round_trip(spark):
    text = A.to_xfdf(annotations(spark))
    xml = text.collect()[0].xfdf
    assert xml.startswith('<?xml version="1.0"') and "<gesture>1.0,2.0</gesture>" in xml
    got = A.from_xfdf(text).orderBy("seq").collect()
    assert [r.annotation_type for r in got] == ["highlight", "note", "redact", "freehand", "stamp"]
    assert got[0].content == "note &lt;1&gt;" and got[1].content == "hello"
    assert got[2].reason == "RGPD" and got[2].opacity == 1.0 and got[0].opacity == 0.45
    assert (got[2].x, got[2].y, got[2].width, got[2].height) == (50.0, 700.0, 300.0, 25.0)
    assert got[4].page_number == 3 and got[4].content is None
    lost = {r.annotation_type for r in A.round_trip_losses(annotations(spark)).collect()}
    assert lost == {"highlight", "underline"}


def test_xfdf_defaults(spark):
    df = spark.createDataFrame([(1, '<redact page="x" rect="1,2,3">\n</redact>\n  <text color="#1" />')],
                               "doc_id int, xfdf string")
    a, b = A.from_xfdf(df).orderBy("seq").collect()
    assert (a.page_number, a.x, a.width, a.color, a.author) == (1, 50.0, 100.0, "#000000", "Utilisateur")
    assert b.annotation_type == "note" and b.color == "#1"


def merge(rects):
    rects = sorted((r for r in rects if r[2] >= 2 and r[3] >= 2), key=lambda r: (r[1] // 4, r[0], r[1]))
    out = []
    for x, y, w, h in rects:
        if out and abs(out[-1][1] - y) < 6 and abs(out[-1][3] - h) < 6 and x <= out[-1][0] + out[-1][2] + 6:
            out[-1][2] = max(out[-1][0] + out[-1][2], x + w) - out[-1][0]
        else:
            out.append([x, y, w, h])
    return [tuple(r) for r in out]


def test_merge_rects(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for s in range(40):
        mine = [(float(rng.randrange(0, 60)), float(rng.randrange(0, 20)), float(rng.randrange(0, 15)),
                 float(rng.choice([1, 8, 10, 20]))) for _ in range(rng.randrange(1, 12))]
        mine = list({r[:2]: r for r in mine}.values())
        want[s] = merge(mine)
        rows += [(1, 1, s, *r) for r in mine]
    df = spark.createDataFrame(rows, "doc_id int, page_number int, selection int, x double, y double, "
                                     "width double, height double")
    got = {}
    for r in A.merge_rects(df).orderBy("selection", "rect_no").collect():
        got.setdefault(r.selection, []).append((r.x, r.y, r.width, r.height))
    assert got == {k: v for k, v in want.items() if v}


def build(spark, n_pages, actions):
    pages = spark.createDataFrame([("s", i + 1, 595.0, 842.0, 0) for i in range(n_pages)],
                                  "doc_id string, page_number int, width double, height double, rotation int")
    sources = spark.createDataFrame([(1, 0, "s")], "build_id int, seq int, doc_id string")
    acts = spark.createDataFrame([(1, *a) for a in actions],
                                 "build_id int, action string, page_number int, degrees int")
    return B.apply_actions(B.merge_sources(sources, pages), acts).orderBy("page_number").collect()


def test_assembly(spark):
    got = build(spark, 2, [("rotate", 1, 90), ("delete", 2, None)])
    assert [(r.page_number, r.rotation, r.shown_width, r.shown_height) for r in got] == [(1, 90, 842.0, 595.0)]
    got = build(spark, 4, [("rotate", 1, 180), ("delete", 2, None), ("rotate", 3, 90), ("delete", 4, None)])
    assert [r.rotation for r in got] == [180, 90] and [r.page_number for r in got] == [1, 2]
    got = build(spark, 1, [("rotate", 1, -90), ("keep", 1, -90), ("insert_blank", 1, None)])
    assert [r.rotation for r in got] == [180]


def test_merge_order(spark):
    pages = spark.createDataFrame(
        [(d, p, 1.0, 2.0, 0) for d, n in (("a", 3), ("b", 2)) for p in range(1, n + 1)],
        "doc_id string, page_number int, width double, height double, rotation int")
    sources = spark.createDataFrame([(1, 5, "a"), (1, 2, "b"), (1, 9000, "b")],
                                    "build_id int, seq int, doc_id string")
    got = [(r.merged_no, r.doc_id, r.source_page)
           for r in B.merge_sources(sources, pages).orderBy("merged_no").collect()]
    assert got == [(1, "b", 1), (2, "b", 2), (3, "a", 1), (4, "a", 2), (5, "a", 3), (6, "b", 1), (7, "b", 2)]


def test_watermark_limits(spark):
    pages = spark.createDataFrame([(400.0, 200.0)], "width double, height double")
    lit = F.lit
    r = B.watermark_layout(pages, lit("a(b"), lit(float("nan")), lit(5.0), lit(0.05), lit("nope")).collect()[0]
    assert r.wm_opacity == 0.2 and r.wm_font_size == 28.0 and abs(r.wm_cos - r.wm_sin) < 1e-12
    assert (r.wm_red, r.wm_green, r.wm_blue) == (0.85, 0.15, 0.15) and r.wm_half_width == 4 * 28 * 0.28
    assert B.watermark_layout(pages, lit("  "), lit(1.0), lit(5.0), lit(0.0), lit("#ffffff")).count() == 0


def test_verification(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "doc_id string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "doc_id string, sha256 string")
    assert {r.doc_id: r.status for r in B.verify(a, b).collect()} == {
        "x": "ok", "y": "changed", "z": "missing", "w": "new"}


OBJ = ("doc_id int, obj_id int, parent_id int, page_number int, page_height double, ft string, t string, "
       "v string, dv string, ff int, rect array<double>, opt array<struct<value:string,display:string>>, "
       "is_widget boolean")


def objects(spark):
    r = [50.0, 700.0, 250.0, 720.0]
    return spark.createDataFrame([
        (1, 1, None, 1, 792.0, "Tx", "FirstName", "Jean", None, 0, r, None, True),
        (1, 2, None, 1, 792.0, "Btn", "AgreeTerms", "Yes", None, None, r, None, True),
        (1, 3, None, 1, 792.0, "Tx", "Notes", None, None, 1 << 12, r, None, True),
        (1, 4, None, 1, 792.0, "Ch", "Country", None, None, 3, r,
         [("fr", "France"), ("be", None), ("ch", "Suisse"), ("ca", "Canada")], True),
        (1, 5, None, 1, 792.0, "Sig", "Sign", None, None, None, r, None, True),
        # a chain of five: the name comes from the top, the type only from the parent
        (1, 10, None, 1, 792.0, "Btn", "Group", "On", None, 1 << 15, None, None, False),
        (1, 11, 10, 1, 792.0, None, None, None, None, None, None, None, False),
        (1, 12, 11, 1, 792.0, None, None, None, None, None, None, None, False),
        (1, 13, 12, 1, 792.0, None, None, None, None, None, None, None, False),
        (1, 14, 13, 1, 792.0, None, None, None, None, None, r, None, True),
        (1, 15, 10, 1, 792.0, None, None, None, None, None, r, None, True),
        # a circle without a name
        (2, 1, 2, 3, 100.0, None, None, None, None, None, [7.5, 1.0, 2.5, 9.0], None, True),
        (2, 2, 1, 3, 100.0, None, None, None, None, None, None, None, False)], OBJ)


def test_forms(spark):
    fields = Fo.fields(objects(spark))
    got = {(r.doc_id, r.obj_id): r for r in fields.collect()}
    assert [got[(1, i)].field_type for i in (1, 2, 3, 4, 5)] == [
        "text", "checkbox", "text", "choice", "signature"]
    assert got[(1, 1)].y == 72.0 and got[(1, 1)].value == "Jean" and got[(1, 3)].multiline
    assert got[(1, 4)].options == ["France", "be", "Suisse", "Canada"]
    assert got[(1, 4)].read_only and got[(1, 4)].required
    assert got[(1, 14)].name == "Group" and got[(1, 14)].value == "On" and got[(1, 14)].field_type == "text"
    assert got[(1, 15)].field_type == "radio"
    assert got[(2, 1)].name == "field_p3_2_91" and got[(2, 1)].field_id == "fld_3_field_p3_2_91"
    given = Fo.given_values(spark.createDataFrame(
        [(1, {"FirstName": "Marie", "AgreeTerms": "TRUE", "Nope": "x"}), (2, {"field_p3_2_91": "x"})],
        "doc_id int, values map<string,string>"))
    filled = Fo.fill(fields, given)
    assert {r.obj_id: r.value for r in filled.where("updated").collect()} == {1: "Marie", 2: "Yes"}
    assert {r.doc_id: r.updated for r in Fo.updated_counts(filled).collect()} == {1: 2, 2: 0}
