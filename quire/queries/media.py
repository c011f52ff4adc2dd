"""Drawing and medical image queries; the files are written by Spark from table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import cad as C, dicom as M
from quire.plans.durable import settled
from quire.sources.tables import spread, table

ENTITY_TYPES = ["LINE", "CIRCLE", "ARC", "LWPOLYLINE", "TEXT", "SOLID", "POINT"]


def _drawings(spark, sf):
    """A drawing per order: three layers and up to six entities from its key."""
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    s = lambda c: c.cast("string")

    def row(*parts):
        return F.concat_ws("\n", *[p if not isinstance(p, str) else F.lit(p) for p in parts])

    layer = lambda name, color, flag: row("0", "LAYER", "2", name, "70", flag, "62", color)
    head = row(
        "0", "SECTION", "2", "TABLES", "0", "TABLE", "2", "LAYER", "70", "3",
        layer(F.concat(F.lit("W"), status), s(F.when(k % 4 == 0, -(k % 256)).otherwise(k % 256)), "0"),
        layer("FROZEN", "3", s(k % 2)), "0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES")

    def entity(no):
        i = F.lit(no).cast("bigint")
        kind = F.element_at(F.array(*[F.lit(t) for t in ENTITY_TYPES]),
                            ((k + i) % 7 + 1).cast("int"))
        name = F.when(i % 3 == 0, F.concat(F.lit("W"), status)).when(i % 3 == 1, "FREE")
        own = F.when(i % 2 == 0, F.concat(F.lit("62\n"), s((k + i) % 260)))
        second = F.when(kind == "LWPOLYLINE", row("10", s(k % 100 + i + 5), "20", s(k % 50 - i + 7)))
        return F.concat_ws(
            "\n", F.lit("0"), kind, F.concat(F.lit("8\n"), name), own, F.lit("10"),
            s(k % 100 + i), F.lit("20"), s(k % 50 - i), F.lit("11"), s(k % 70 + 2 * i), F.lit("21"),
            s(i * 3), F.lit("40"), s(i + 1), F.lit("1"), F.concat(F.lit("T"), k), second)

    # one by one, since functions over arrays are not compiled
    body = F.concat_ws("\n", *[F.when(k % 6 >= no, entity(no)) for no in range(6)])
    return o.select(k.alias("drawing_id"), F.concat_ws(
        "\n", head, body, F.lit("0\nENDSEC\n0\nEOF\n")).alias("content"))


def _parsed(spark, sf):
    d = _drawings(spark, sf)
    recs = settled(C.records(d))  # read by layers, entities and extents
    return d, recs, C.layers(recs, d)


def cad_layers(spark, sf):
    _, _, layers = _parsed(spark, sf)
    return layers.withColumn("color_aci", F.col("color_aci").cast("bigint"))


def cad_entities(spark, sf):
    _, recs, layers = _parsed(spark, sf)
    return C.entities(recs, layers).select(
        "drawing_id", "kind", "layer", "color_hex", "x1",
        "y1", "x2", "y2", "radius", "text", F.coalesce(F.size("points"), F.lit(0)).cast("bigint").alias("n_points"))


def cad_extents(spark, sf):
    d, recs, layers = _parsed(spark, sf)
    return C.extents(C.entities(recs, layers), d)


def cad_active_layers(spark, sf):
    d, recs, layers = _parsed(spark, sf)
    wanted = d.select("drawing_id", F.when(F.col("drawing_id") % 2 == 0, " FREE ,0")
                      .otherwise(F.lit("WO, WF,WP")).alias("layer_list"))
    return C.on_layers(C.entities(recs, layers), wanted).groupBy("drawing_id", "layer").agg(
        F.count("*").alias("entities"))


def cad_canvas(spark, sf):
    d, recs, layers = _parsed(spark, sf)
    ents = C.entities(recs, layers)
    fitted = C.fit(ents, C.extents(ents, d))
    return fitted.select("drawing_id", "canvas_w",
                         "canvas_h", *[F.round(c, 6).alias(c) for c in
                                       ("scale", "cx1", "cy1", "cx2", "cy2")])


def cad_layer_search(spark, sf):
    from quire.operators.search import filter_layers

    _, _, layers = _parsed(spark, sf)
    return filter_layers(layers, "FR").groupBy("layer", "is_visible").agg(
        F.count("*").alias("drawings"), F.sum("entity_count").alias("entities"))


def _element(group, elem, vr, value):
    """One explicit-VR data element as bytes."""
    size = F.octet_length(value)
    le16 = lambda n: F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))
    tag = F.concat(*[F.unhex(F.lit(f"{t & 255:02X}{t >> 8:02X}")) for t in (group, elem)])
    return F.concat(tag, F.encode(F.lit(vr), "utf-8"), F.unhex(le16(size)), value)


def _dicom_files(spark, sf):
    """An image object per order: header fields and eight signed samples from its columns."""
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                                 "o_orderstatus", "o_orderpriority"))
    k = F.col("o_orderkey")
    text = lambda c: F.encode(c, "utf-8")
    u16 = lambda n: F.unhex(F.concat(F.lpad(F.hex(n % 256), 2, "0"),
                                     F.lpad(F.hex(F.floor(n / 256)), 2, "0")))
    modality = F.when(k % 3 == 0, "MR").when(k % 3 == 1, "CT").otherwise(F.lit("US"))
    px = F.concat(*[u16((k * (i + 1)) % 65536) for i in range(8)])
    parts = [
        F.unhex(F.lit("00" * 128)), text(F.lit("DICM")),
        _element(0x0008, 0x0020, "DA", text(F.date_format("o_orderdate", "yyyyMMdd"))),
        _element(0x0008, 0x0060, "CS", text(modality)),
        _element(0x0010, 0x0010, "PN", text(F.concat(F.lit("Patient^"), "o_custkey", F.lit(" ")))),
        _element(0x0018, 0x0015, "CS", text(F.col("o_orderpriority"))),
        _element(0x0028, 0x0010, "US", u16(F.lit(2) + k % 2 * 0)),
        _element(0x0028, 0x0011, "US", u16(F.lit(4) + k % 2 * 0)),
        _element(0x0028, 0x0030, "DS", text(F.concat(F.lit("0.5\\"), k % 9, F.lit(".25")))),
        _element(0x0028, 0x0100, "US", u16(F.lit(16) + k % 2 * 0)),
        _element(0x0028, 0x0103, "US", u16(k % 2)),
        _element(0x0028, 0x1050, "DS", text(F.concat(k % 100, F.lit("\\7")))),
        _element(0x0028, 0x1052, "DS", text(F.concat(F.lit("-"), k % 1000))),
        # pixel data with the long form of the length
        F.unhex(F.lit("E07F1000")), text(F.lit("OW")), F.unhex(F.lit("000010000000")), px,
    ]
    return o.select(k.alias("object_id"), F.concat(*parts).alias("content"))


def dicom_headers(spark, sf):
    h = M.headers(_dicom_files(spark, sf))
    ints = ["rows", "columns", "bits_allocated", "bits_stored", "pixel_representation"]
    return h.select(F.col("object_id").cast("bigint").alias("object_id"), "patient_name",
                    "patient_id", "study_date", "modality", "body_part",
                    *[F.col(c).cast("bigint").alias(c) for c in ints], "rescale_intercept",
                    "rescale_slope", "window_center", "window_width", "spacing_x", "spacing_y",
                    "has_pixels", "reject",
                    *[F.col(c).cast("bigint").alias(c) for c in ("declared_rows", "declared_columns")])


def dicom_samples(spark, sf):
    return M.samples(_dicom_files(spark, sf)).select(
        F.col("object_id").cast("bigint").alias("object_id"), "idx", "raw")


def dicom_studies(spark, sf):
    return M.study_catalogue(M.headers(_dicom_files(spark, sf)))


def _price_samples(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    raw = F.floor(F.col("l_extendedprice") / 25)
    return li.select(F.col("l_suppkey").alias("object_id"),
                     M.rescale(raw, F.lit(1.0), F.lit(-1024.0)).alias("hu"))


def window_histogram(spark, sf):
    return M.histogram(M.preset_intensities(_price_samples(spark, sf))).withColumn(
        "intensity", F.col("intensity").cast("bigint"))


QUERIES = {f.__name__: f for f in (
    cad_layers, cad_entities, cad_extents, cad_active_layers, cad_canvas, cad_layer_search,
    dicom_headers, dicom_samples, dicom_studies, window_histogram)}


def _aci_sql(c: str) -> str:
    whens = " ".join(f"WHEN abs({c}) BETWEEN {lo} AND {hi} THEN '{v}'" for lo, hi, v in C.ACI_RANGES)
    return f"(CASE {whens} ELSE '{C.ACI_OTHER}' END)"


_KIND = "['line','circle','arc','polyline','text','solid',NULL][(k + i) % 7 + 1]"

CAD = f"""
e AS (
  SELECT k, i, {_KIND} AS kind, CASE i % 3 WHEN 0 THEN 'W' || st WHEN 1 THEN 'FREE' ELSE '0' END AS layer,
    CASE WHEN i % 2 = 0 THEN {_aci_sql('((k + i) % 260)')} END AS own,
    CASE WHEN {_KIND} = 'polyline' THEN 5.0 ELSE 0 END + k % 100 + i AS x1,
    CASE WHEN {_KIND} = 'polyline' THEN 7.0 ELSE 0 END + k % 50 - i AS y1,
    k % 70 + 2.0 * i AS x2, i * 3.0 AS y2, i + 1.0 AS r, 'T' || k AS t, st
  FROM (SELECT o_orderkey AS k, o_orderstatus AS st, unnest(range(0, o_orderkey % 6 + 1)) AS i FROM orders)),
def AS (
  SELECT o_orderkey AS k, 'W' || o_orderstatus AS layer,
    CASE WHEN o_orderkey % 4 = 0 THEN -(o_orderkey % 256) ELSE o_orderkey % 256 END AS aci,
    NOT (o_orderkey % 4 = 0 AND o_orderkey % 256 > 0) AS vis FROM orders
  UNION ALL SELECT o_orderkey, 'FROZEN', 3, o_orderkey % 2 = 0 FROM orders),
lay AS (
  SELECT k, layer, aci, {_aci_sql('aci')} AS hex, vis FROM def
  UNION ALL SELECT o_orderkey, '0', 7, '#333333', true FROM orders),
used AS (SELECT k, layer, count(*) AS n, arg_min(coalesce(own, '#333333'), i) AS c FROM e GROUP BY 1, 2),
inv AS (SELECT k, layer, coalesce(aci, 7) AS aci, coalesce(hex, c) AS hex, coalesce(vis, true) AS vis,
          coalesce(n, 0) AS n FROM lay FULL JOIN used USING (k, layer)),
ent AS (SELECT e.*, coalesce(own, inv.hex) AS color FROM e JOIN inv USING (k, layer) WHERE kind IS NOT NULL),
tr AS (
  SELECT k, CASE WHEN kind IN ('circle', 'arc') THEN x1 - r WHEN kind = 'polyline' THEN x1 - 5
                 WHEN kind = 'text' THEN x1 ELSE least(x1, x2) END AS ax,
    CASE WHEN kind IN ('circle', 'arc') THEN x1 + r WHEN kind = 'polyline' THEN x1
         WHEN kind = 'text' THEN x1 + length(t) * r * CAST(0.6 AS DOUBLE) ELSE greatest(x1, x2) END AS qx,
    CASE WHEN kind IN ('circle', 'arc') THEN y1 - r WHEN kind = 'polyline' THEN y1 - 7
         WHEN kind = 'text' THEN y1 ELSE least(y1, y2) END AS ay,
    CASE WHEN kind IN ('circle', 'arc') THEN y1 + r WHEN kind = 'polyline' THEN y1
         WHEN kind = 'text' THEN y1 + r ELSE greatest(y1, y2) END AS qy FROM ent),
bb AS (SELECT k, min(ax) AS ax, min(ay) AS ay, max(qx) AS qx, max(qy) AS qy FROM tr GROUP BY 1),
ext AS (
  SELECT o_orderkey AS k, CAST(CASE WHEN ok THEN ax ELSE 0 END AS DOUBLE) AS min_x,
    CAST(CASE WHEN ok THEN ay ELSE 0 END AS DOUBLE) AS min_y,
    CAST(CASE WHEN ok THEN qx ELSE 800 END AS DOUBLE) AS max_x,
    CAST(CASE WHEN ok THEN qy ELSE 600 END AS DOUBLE) AS max_y
  FROM (SELECT o_orderkey, bb.*, coalesce(ax < qx AND ay < qy, false) AS ok
        FROM orders LEFT JOIN bb ON bb.k = o_orderkey)),
cv AS (SELECT *, greatest(0.01, least(1200 / greatest(w, 1), 900 / greatest(h, 1), 10)) AS scale
       FROM (SELECT *, abs(max_x - min_x) + 80 AS w, abs(max_y - min_y) + 80 AS h FROM ext)),
cv2 AS (SELECT *, CAST(greatest(round(w * scale), 400) AS DOUBLE) AS canvas_w,
               CAST(greatest(round(h * scale), 300) AS DOUBLE) AS canvas_h FROM cv)
"""

DICOM = """
d AS (SELECT o_orderkey AS k, o_custkey, o_orderdate, o_orderpriority,
  CASE o_orderkey % 3 WHEN 0 THEN 'MR' WHEN 1 THEN 'CT' ELSE 'US' END AS modality FROM orders)
"""

SQL = {
    "cad_layers": f"""WITH {CAD}
SELECT k AS drawing_id, layer, CAST(aci AS BIGINT) AS color_aci, hex AS color_hex, vis AS is_visible,
       n AS entity_count FROM inv""",
    "cad_entities": f"""WITH {CAD}
SELECT k AS drawing_id, kind, layer, color AS color_hex, CAST(x1 AS DOUBLE) AS x1,
  CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, CAST(r AS DOUBLE) AS radius,
  t AS text, CAST(CASE WHEN kind = 'polyline' THEN 2 ELSE 0 END AS BIGINT) AS n_points FROM ent""",
    "cad_extents": f"WITH {CAD} SELECT k AS drawing_id, min_x, min_y, max_x, max_y FROM ext",
    "cad_active_layers": f"""WITH {CAD}
SELECT k AS drawing_id, layer, count(*) AS entities FROM ent
WHERE CASE WHEN k % 2 = 0 THEN layer IN ('FREE', '0') ELSE layer IN ('WO', 'WF', 'WP') END GROUP BY 1, 2""",
    "cad_canvas": f"""WITH {CAD}
SELECT ent.k AS drawing_id, canvas_w, canvas_h, round(scale, 6) AS scale,
  round((x1 - min_x + 40) * scale, 6) AS cx1, round(canvas_h - (y1 - min_y + 40) * scale, 6) AS cy1,
  round((x2 - min_x + 40) * scale, 6) AS cx2, round(canvas_h - (y2 - min_y + 40) * scale, 6) AS cy2
FROM ent JOIN cv2 ON cv2.k = ent.k""",
    "cad_layer_search": f"""WITH {CAD}
SELECT layer, vis AS is_visible, count(*) AS drawings, CAST(sum(n) AS BIGINT) AS entities
FROM inv WHERE contains(lower(layer), 'fr') GROUP BY 1, 2""",
    "dicom_headers": f"""WITH {DICOM}
SELECT k AS object_id, 'Patient^' || o_custkey AS patient_name, CAST(NULL AS VARCHAR) AS patient_id,
  strftime(o_orderdate, '%Y%m%d') AS study_date, modality, o_orderpriority AS body_part,
  CAST(2 AS BIGINT) AS rows, CAST(4 AS BIGINT) AS columns, CAST(16 AS BIGINT) AS bits_allocated,
  CAST(12 AS BIGINT) AS bits_stored, k % 2 AS pixel_representation,
  CAST('-' || (k % 1000) AS DOUBLE) AS rescale_intercept, CAST(1 AS DOUBLE) AS rescale_slope,
  CAST(k % 100 AS DOUBLE) AS window_center, CAST(400 AS DOUBLE) AS window_width,
  CAST((k % 9) || '.25' AS DOUBLE) AS spacing_x, CAST(0.5 AS DOUBLE) AS spacing_y,
  true AS has_pixels, CAST(NULL AS VARCHAR) AS reject, CAST(2 AS BIGINT) AS declared_rows,
  CAST(4 AS BIGINT) AS declared_columns FROM d""",
    "dicom_samples": f"""WITH {DICOM},
s AS (SELECT k, unnest(range(8)) AS idx FROM d)
SELECT k AS object_id, idx, CAST(CASE WHEN k % 2 = 1 AND k * (idx + 1) % 65536 > 32767
  THEN k * (idx + 1) % 65536 - 65536 ELSE k * (idx + 1) % 65536 END AS DOUBLE) AS raw FROM s""",
    "dicom_studies": f"""WITH {DICOM}
SELECT modality, o_orderpriority AS body_part, count(*) AS objects FROM d
GROUP BY ROLLUP (modality, o_orderpriority)""",
    "window_histogram": """
WITH s AS (SELECT l_suppkey AS object_id, floor(l_extendedprice / 25) - 1024 AS hu FROM lineitem),
p AS (SELECT * FROM (VALUES ('soft_tissue', 40.0, 400.0), ('lung', -600.0, 1500.0), ('bone', 400.0, 1800.0),
  ('brain', 40.0, 80.0), ('mediastinum', 50.0, 350.0)) AS t(preset, c, w)),
i AS (SELECT object_id, preset, CAST(CASE WHEN hu <= c - w / 2 THEN 0 WHEN hu >= c + w / 2 THEN 255
  ELSE round(CAST((hu - (c - w / 2)) AS DOUBLE) / CAST(w AS DOUBLE) * 255.0) END AS BIGINT) AS intensity FROM s, p)
SELECT object_id, preset, intensity, count(*) AS n FROM i GROUP BY 1, 2, 3""",
}
