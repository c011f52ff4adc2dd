"""Annotation, assembly, signature and form queries over events, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import annotations as A, assemble as B, forms as Fo, textlayer
from quire.plans import skew
from quire.sources import corpus
from quire.sources.tables import table

TYPES = ["highlight", "underline", "strikeout", "note", "freehand", "rectangle", "stamp", "redact"]
AT = "2024-03-05 06:07:08"


def _annotations(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    n = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (n % 8 + 1).cast("int"))
    pts = F.array(F.struct((n % 100).cast("double").alias("x"), F.lit(2.5).alias("y")),
                  F.struct(F.lit(7.0).alias("x"), (n % 50).cast("double").alias("y")))
    return e.select(
        F.col("user_id").alias("doc_id"), n.alias("seq"), kind.alias("annotation_type"),
        (n % 30 + 1).cast("int").alias("page_number"), (n % 5000 / 10).alias("x"),
        F.col("value").alias("y"), (n % 100 + 20).cast("double").alias("width"),
        (n % 40 + 10).cast("double").alias("height"),
        F.concat(F.lit("#"), F.lpad(F.hex(n % 65536), 6, "0")).alias("color"),
        F.concat("event_type", F.lit(" <O'Neil & co>")).alias("author"),
        F.date_format("ts", "yyyy-MM-dd").alias("created_at"),
        F.when(n % 3 == 0, F.col("props")).alias("content"),
        F.when(n % 16 == 4, pts).otherwise(F.array().cast(
            "array<struct<x:double,y:double>>")).alias("points"),
        F.when(n % 2 == 1, F.lit("RGPD")).alias("reason"),
        F.date_trunc("day", "ts").alias("batch_ts"))


def xfdf_export(spark, sf):
    return A.to_xfdf(_annotations(spark, sf)).select(
        "doc_id", F.md5("xfdf").alias("xfdf_md5"), F.length("xfdf").cast("bigint").alias("n_chars"))


def xfdf_import(spark, sf):
    back = A.from_xfdf(A.to_xfdf(_annotations(spark, sf)))
    return back.select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"),
        F.col("page_number").cast("bigint").alias("page_number"), "annotation_type",
        F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("width", 2).alias("width"),
        F.round("height", 2).alias("height"), "color", "opacity", "author", "created_at", "content",
        "reason")


def xfdf_losses(spark, sf):
    """What the exchange loses: types without a tag of their own, escapes, contents."""
    return A.round_trip_losses(_annotations(spark, sf)).groupBy("annotation_type").agg(
        F.count("*").alias("lost"))


def annotation_latest(spark, sf):
    return A.latest_batches(_annotations(spark, sf)).select("doc_id", "seq", "batch_ts")


def annotation_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return A.active_counts(docs, _annotations(spark, sf))


def annotations_by_connector(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", corpus.mapping_json(
            F.when(F.col("lang") == "en", "s3").otherwise(F.lit("filesystem")),
            F.concat("source", F.lit("/"), "doc_id"), F.create_map(F.lit("lang"), "lang")
        ).alias("json"))
    mapped = docs.select("doc_id", corpus.parse_mapping(F.col("json")).alias("mapping"))
    return A.by_connector(_annotations(spark, sf), mapped).groupBy("connector", "resource_id").agg(
        F.count("*").alias("annotations"))


def merged_rects(spark, sf):
    """Line items of an order as the fragments of one selection."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey",
                                             "l_partkey")
    rects = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).alias("page_number"),
        (F.col("l_suppkey") % 2).alias("selection"), (F.col("l_partkey") % 300).cast("double")
        .alias("x"), (F.col("l_suppkey") % 30).cast("double").alias("y"),
        F.col("l_quantity").alias("width"), F.lit(12.0).alias("height"))
    return A.merge_rects(rects).withColumn("page_number", F.col("page_number").cast("int"))


def _pages(spark, sf):
    return textlayer.pages(table(spark, sf, "documents").select("doc_id", "text")).withColumn(
        "rotation", (F.col("doc_id") % 3 * 90).cast("int"))


def _sources(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("build_id"), F.col("doc_id").alias("seq"), "doc_id")


def merged_pages(spark, sf):
    return B.merge_sources(_sources(spark, sf), _pages(spark, sf)).select(
        "build_id", "doc_id", F.col("merged_no").cast("bigint").alias("merged_no"),
        F.col("source_page").cast("bigint").alias("source_page"))


def built_documents(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("rotate", "delete", "keep", "insert_blank")])
    actions = table(spark, sf, "documents").select(
        F.col("source").alias("build_id"),
        F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("action"),
        (F.col("doc_id") * 7 % 61 + 1).alias("page_number"),
        F.when(F.col("doc_id") % 6 != 2, (F.col("doc_id") % 5 * 90 - 90).cast("int"))
        .alias("degrees"))
    built = B.apply_actions(B.merge_sources(_sources(spark, sf), _pages(spark, sf)), actions)
    return built.select(
        "build_id", "page_number", F.col("merged_no").cast("bigint").alias("merged_no"),
        F.col("rotation").cast("bigint").alias("rotation"), "shown_width", "shown_height")


def watermarks(spark, sf):
    d = F.col("doc_id")
    laid = B.watermark_layout(
        _pages(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id"),
        F.concat(F.lit("CONF ("), "source", F.lit(")")), (d % 13) / 10.0, (d % 40).cast("double"),
        (d % 7 * 15).cast("double"),
        F.when(d % 2 == 0, F.concat(F.lit("#"), F.lpad(F.hex(d * 977), 6, "0")))
        .otherwise(F.lit("blue")))
    return laid.select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), "wm_text", "wm_opacity",
        F.round("wm_cos", 9).alias("wm_cos"), F.round("wm_sin", 9).alias("wm_sin"), "wm_font_size",
        "wm_x", "wm_y", F.round("wm_half_width", 6).alias("wm_half_width"),
        F.round("wm_half_height", 6).alias("wm_half_height"), "wm_red", "wm_green", "wm_blue")


def digest_manifest(spark, sf):
    return B.manifest(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))


def signature_ledger(spark, sf):
    digests = B.manifest(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))
    d = F.col("doc_id")
    req = table(spark, sf, "documents").select(
        "doc_id", (d % 3 + 1).cast("int").alias("page_number"),
        F.concat(F.lit("Signer "), "lang").alias("signer_name"), (d % 400).cast("double").alias("x"),
        (d % 900).cast("double").alias("y"), (d % 200).cast("double").alias("width"),
        (d % 90).cast("double").alias("height"), F.when(d % 2 == 0, "Accord").alias("reason"),
        F.lit(None).cast("string").alias("location"))
    at = F.lit(AT).cast("timestamp")
    return B.signature_ledger(req, digests, _pages(spark, sf), at).withColumn(
        "page_number", F.col("page_number").cast("bigint"))


def digest_verification(spark, sf):
    """Digests recorded with the labels against those of the present texts."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    recorded = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").select(
        "doc_id", F.concat("text", F.col("toxic")).alias("content"))
    now = docs.select("doc_id", F.concat("text", F.lit("0")).alias("content"))
    return B.verify(B.manifest(recorded), B.manifest(now)).select("doc_id", "status")


def _objects(spark, sf):
    """Orders of a customer as form objects, each the child of the one before."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    o = skew.chunked_running(o, ["o_custkey"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096),
                             lags={"prev": F.col("o_orderkey")})
    k, p, prev = F.col("o_orderkey"), F.col("o_totalprice"), F.col("prev")
    fts = F.array(*[F.lit(t) for t in ("Tx", "Btn", "Ch", "Sig", None)])
    opt = F.array(
        F.struct(F.lit("a").alias("value"), F.lit("Option A").alias("display")),
        F.struct(F.concat(F.lit("b"), k).alias("value"), F.lit(None).cast("string").alias("display")))
    return o.select(
        F.col("o_custkey").alias("doc_id"), k.alias("obj_id"), prev.alias("parent_id"),
        (k % 4 + 1).cast("int").alias("page_number"), F.lit(842.0).alias("page_height"),
        F.element_at(fts, (k % 5 + 1).cast("int")).alias("ft"),
        F.when(k % 4 == 0, F.concat(F.lit("field"), k)).alias("t"),
        F.when(k % 6 == 0, F.col("o_orderstatus")).alias("v"),
        F.when(k % 9 == 0, "dv").alias("dv"),
        F.when(k % 3 == 0, F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4096), F.lit(32768),
                                                F.lit(3)), (k % 5 + 1).cast("int"))).alias("ff"),
        F.array(p % 500, p % 700, p % 300 + 100, p % 800 + 20).alias("rect"),
        F.when(k % 5 == 2, opt).alias("opt"), F.lit(True).alias("is_widget"))


def _field_table(spark, sf):
    return Fo.fields(_objects(spark, sf))


def form_fields(spark, sf):
    return _field_table(spark, sf).select(
        "doc_id", "obj_id", F.col("page_number").cast("bigint").alias("page_number"), "field_id",
        "name", "field_type", "x", "y", "width", "height", "value", "default_value", "read_only",
        "required", "multiline", F.array_join("options", "|").alias("options"))


def form_summary(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    return Fo.summary(_field_table(spark, sf), docs)


def form_fill(spark, sf):
    fields = _field_table(spark, sf)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    values = o.select(
        F.col("o_custkey").alias("doc_id"), F.concat(F.lit("field"), "o_orderkey").alias("name"),
        F.when(F.col("o_orderkey") % 8 == 0, "ON").otherwise(F.col("o_orderpriority"))
        .alias("new_value"))
    return Fo.fill(fields, values).select("doc_id", "obj_id", "name", "value", "updated")


QUERIES = {f.__name__: f for f in (
    xfdf_export, xfdf_import, xfdf_losses, annotation_latest, annotation_counts,
    annotations_by_connector, merged_rects, merged_pages, built_documents, watermarks,
    digest_manifest, signature_ledger, digest_verification, form_fields, form_summary, form_fill)}

ANN = """
ann AS (
  SELECT user_id AS doc_id, event_id AS seq,
    ['highlight','underline','strikeout','note','freehand','rectangle','stamp','redact'][event_id % 8 + 1] AS kind,
    ['highlight','stamp','stamp','text','ink','square','stamp','redact'][event_id % 8 + 1] AS tag,
    event_id % 30 + 1 AS page, event_id % 5000 / 10 AS x, value AS y, event_id % 100 + 20.0 AS w,
    event_id % 40 + 10.0 AS h, '#' || lpad(printf('%X', event_id % 65536), 6, '0') AS color,
    event_type || ' &lt;O&apos;Neil &amp; co&gt;' AS author, strftime(ts, '%Y-%m-%d') AS created_at,
    CASE WHEN event_id % 3 = 0 THEN props END AS content, event_id AS n,
    CASE WHEN event_id % 2 = 1 THEN 'RGPD' END AS reason, date_trunc('day', ts) AS batch_ts FROM events),
ann2 AS (
  SELECT *, '    <' || tag || ' page="' || (page - 1) || '" rect="' || printf('%.2f,%.2f,%.2f,%.2f', x, y, x + w, y + h)
    || '" color="' || color || '" title="' || author || '" date="' || created_at || '"'
    || CASE WHEN tag = 'redact' AND reason IS NOT NULL THEN ' reason="' || reason || '"' ELSE '' END AS head,
    replace(content, '"', '&quot;') AS esc FROM ann),
el AS (
  SELECT *, CASE WHEN tag IN ('square', 'stamp') THEN head || ' />' || chr(10)
    WHEN tag = 'ink' THEN head || '>' || chr(10) || CASE WHEN n % 16 = 4 THEN
      '      <inklist>' || chr(10) || '        <gesture>' || printf('%.1f,%.1f;%.1f,%.1f', CAST(n % 100 AS DOUBLE),
        CAST(2.5 AS DOUBLE), CAST(7 AS DOUBLE), CAST(n % 50 AS DOUBLE)) || '</gesture>' || chr(10) || '      </inklist>' || chr(10) ELSE '' END
      || '    </ink>' || chr(10)
    ELSE head || '>' || chr(10) || coalesce('      <contents>' || esc || '</contents>' || chr(10), '')
      || '    </' || tag || '>' || chr(10) END AS e FROM ann2)
"""

PG = """
pg AS (
  SELECT doc_id, source, unnest(range(1, 1 + greatest(1, CAST(ceil((len(string_split_regex(text, '\\r?\\n'))
    - CAST(text = '' OR regexp_matches(text, '\\n$') AS INT)) / 48.0) AS BIGINT)))) AS page_number
  FROM documents),
merged AS (
  SELECT source AS build_id, doc_id, page_number AS source_page, doc_id % 3 * 90 AS rotation,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, page_number) AS merged_no FROM pg)
"""

FIELDS = """
ob AS (
  SELECT o_custkey AS doc_id, o_orderkey AS k, o_totalprice AS p, o_orderstatus,
    CASE WHEN o_orderkey % 4 = 0 THEN 'field' || o_orderkey END AS t,
    CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus END AS v,
    ['Tx', 'Btn', 'Ch', 'Sig', NULL][o_orderkey % 5 + 1] AS ft,
    CASE WHEN o_orderkey % 3 = 0 THEN [1, 2, 4096, 32768, 3][o_orderkey % 5 + 1] END AS ff FROM orders),
inh AS (
  SELECT *, last_value(t IGNORE NULLS) OVER w AS it, last_value(v IGNORE NULLS) OVER w AS iv,
    coalesce(ft, lag(ft) OVER w) AS eft, coalesce(ff, lag(ff) OVER w, 0) AS eff,
    p % 500 AS x1, p % 700 AS y1, p % 300 + 100 AS x2, p % 800 + 20 AS y2
  FROM ob WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (
  SELECT doc_id, k AS obj_id, k % 4 + 1 AS page_number, it,
    coalesce(it, 'field_p' || (k % 4 + 1) || '_' || CAST(trunc(round(least(x1, x2), 2)) AS BIGINT) || '_'
      || CAST(greatest(trunc(round(842 - greatest(y1, y2), 2)), 0) AS BIGINT)) AS name,
    CASE eft WHEN 'Btn' THEN CASE WHEN (eff & 32768) <> 0 THEN 'radio' ELSE 'checkbox' END
      WHEN 'Ch' THEN 'choice' WHEN 'Sig' THEN 'signature' ELSE 'text' END AS field_type,
    round(least(x1, x2), 2) AS x, round(842 - greatest(y1, y2), 2) AS y,
    round(abs(x2 - x1), 2) AS width, round(abs(y2 - y1), 2) AS height, coalesce(iv, '') AS value,
    CASE WHEN k % 9 = 0 THEN 'dv' END AS default_value, (eff & 1) <> 0 AS read_only,
    (eff & 2) <> 0 AS required, (eff & 4096) <> 0 AS multiline,
    CASE WHEN k % 5 = 2 THEN 'Option A|b' || k END AS options FROM inh)
"""

SQL = {
    "xfdf_export": f"""WITH {ANN}, x AS (SELECT doc_id,
  '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">'
  || chr(10) || '  <annots>' || chr(10) || string_agg(e, '' ORDER BY seq) || '  </annots>' || chr(10)
  || '</xfdf>' || chr(10) AS xfdf FROM el GROUP BY doc_id)
SELECT doc_id, md5(xfdf) AS xfdf_md5, length(xfdf) AS n_chars FROM x""",
    "xfdf_import": f"""WITH {ANN}
SELECT doc_id,
  row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, page AS page_number,
  CASE tag WHEN 'text' THEN 'note' WHEN 'square' THEN 'rectangle' WHEN 'ink' THEN 'freehand' ELSE tag END
    AS annotation_type, round(CAST(x AS DOUBLE), 2) AS x, round(CAST(y AS DOUBLE), 2) AS y,
  CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height, color,
  CAST(CASE WHEN tag IN ('redact', 'text') THEN 1.0 ELSE 0.45 END AS DOUBLE) AS opacity, author, created_at,
  CASE WHEN tag IN ('highlight', 'text', 'redact') THEN esc END AS content,
  CASE WHEN tag = 'redact' THEN reason END AS reason FROM ann2""",
    "xfdf_losses": f"""WITH {ANN}
SELECT kind AS annotation_type, count(*) AS lost FROM ann
WHERE kind IN ('underline', 'strikeout') OR (content IS NOT NULL)
   OR (reason IS NOT NULL AND kind <> 'redact') GROUP BY 1""",
    "annotation_latest": f"""WITH {ANN}
SELECT doc_id, seq, batch_ts FROM ann QUALIFY batch_ts = max(batch_ts) OVER (PARTITION BY doc_id)""",
    "annotation_counts": """
SELECT d.doc_id, count(e.event_id) AS annotation_count FROM documents d
LEFT JOIN events e ON e.user_id = d.doc_id GROUP BY 1""",
    "annotations_by_connector": """
SELECT CASE WHEN lang = 'en' THEN 's3' ELSE 'filesystem' END AS connector,
  source || '/' || doc_id AS resource_id, count(*) AS annotations
FROM documents JOIN events ON user_id = doc_id GROUP BY 1, 2""",
    "merged_rects": """
WITH RECURSIVE r AS (
  SELECT l_orderkey AS doc_id, l_linenumber % 2 + 1 AS page_number, l_suppkey % 2 AS selection,
    CAST(l_partkey % 300 AS DOUBLE) AS x, CAST(l_suppkey % 30 AS DOUBLE) AS y, l_quantity AS w
  FROM lineitem WHERE l_quantity >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, selection
                                   ORDER BY floor(y / 4), x, y, w) AS rn FROM r),
walk AS (
  SELECT doc_id, page_number, selection, rn, 0 AS no, x, y, w FROM o WHERE rn = 1
  UNION ALL
  SELECT o.doc_id, o.page_number, o.selection, o.rn,
    CASE WHEN abs(k.y - o.y) < 6 AND o.x <= k.x + k.w + 6 THEN k.no ELSE k.no + 1 END,
    CASE WHEN abs(k.y - o.y) < 6 AND o.x <= k.x + k.w + 6 THEN k.x ELSE o.x END,
    CASE WHEN abs(k.y - o.y) < 6 AND o.x <= k.x + k.w + 6 THEN k.y ELSE o.y END,
    CASE WHEN abs(k.y - o.y) < 6 AND o.x <= k.x + k.w + 6
         THEN greatest(k.x + k.w, o.x + o.w) - k.x ELSE o.w END
  FROM walk k JOIN o ON o.doc_id = k.doc_id AND o.page_number = k.page_number
   AND o.selection = k.selection AND o.rn = k.rn + 1)
SELECT doc_id, page_number, selection, CAST(no AS BIGINT) AS rect_no, x, y, w AS width,
       CAST(12 AS DOUBLE) AS height
FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, selection, no
                                     ORDER BY rn DESC) = 1""",
    "merged_pages": f"WITH {PG} SELECT build_id, doc_id, merged_no, source_page FROM merged",
    "built_documents": f"""WITH {PG},
act AS (SELECT source AS build_id, ['rotate', 'delete', 'keep', 'insert_blank'][doc_id % 4 + 1] AS action,
  doc_id * 7 % 61 + 1 AS page_number, CASE WHEN doc_id % 6 <> 2 THEN doc_id % 5 * 90 - 90 END AS degrees
  FROM documents),
turn AS (SELECT build_id, page_number, sum(coalesce(degrees, 0)) AS t FROM act
  WHERE action IN ('rotate', 'keep') GROUP BY 1, 2),
kept AS (SELECT m.*, t.t FROM merged m LEFT JOIN turn t ON t.build_id = m.build_id AND t.page_number = merged_no
  WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.action = 'delete' AND a.build_id = m.build_id
                    AND a.page_number = m.merged_no)),
r AS (SELECT *, CAST(CASE WHEN t IS NULL THEN rotation ELSE ((rotation + t) % 360 + 360) % 360 END AS BIGINT) AS rot FROM kept)
SELECT build_id, row_number() OVER (PARTITION BY build_id ORDER BY merged_no) AS page_number, merged_no,
  rot AS rotation, CAST(CASE WHEN rot IN (90, 270) THEN 842 ELSE 595 END AS DOUBLE) AS shown_width,
  CAST(CASE WHEN rot IN (90, 270) THEN 595 ELSE 842 END AS DOUBLE) AS shown_height FROM r""",
    "watermarks": f"""WITH {PG},
p AS (SELECT doc_id, page_number, 'CONF \\(' || source || '\\)' AS t, doc_id % 13 / 10.0 AS o,
  CASE WHEN doc_id % 40 >= 10 THEN CAST(doc_id % 40 AS DOUBLE) ELSE greatest(595 * CAST(0.08 AS DOUBLE), 28) END AS s,
  radians(CASE WHEN doc_id % 7 = 0 THEN 45 ELSE doc_id % 7 * 15 END) AS a,
  lpad(printf('%X', doc_id * 977), 6, '0') AS hex FROM pg),
c AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN CAST('0x' || substr(hex, 1, 2) AS INT) / 255 ELSE 0.85 END AS r,
  CASE WHEN doc_id % 2 = 0 THEN CAST('0x' || substr(hex, 3, 2) AS INT) / 255 ELSE 0.15 END AS g,
  CASE WHEN doc_id % 2 = 0 THEN CAST('0x' || substr(hex, 5, 2) AS INT) / 255 ELSE 0.15 END AS b FROM p)
SELECT doc_id, page_number, t AS wm_text, CAST(least(greatest(o, 0.05), 1.0) AS DOUBLE) AS wm_opacity,
  round(cos(a), 9) AS wm_cos, round(sin(a), 9) AS wm_sin, s AS wm_font_size,
  CAST(297.5 AS DOUBLE) AS wm_x, CAST(421 AS DOUBLE) AS wm_y, round(strlen(t) * s * CAST(0.28 AS DOUBLE), 6) AS wm_half_width,
  round(s * CAST(0.35 AS DOUBLE), 6) AS wm_half_height, CAST(r AS DOUBLE) AS wm_red, CAST(g AS DOUBLE) AS wm_green,
  CAST(b AS DOUBLE) AS wm_blue FROM c""",
    "digest_manifest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "signature_ledger": f"""WITH {PG},
r AS (SELECT d.*, d.doc_id % 3 + 1 AS pn, d.doc_id % 900 AS yy, d.doc_id % 90 AS hh FROM documents d)
SELECT r.doc_id, pn AS page_number, 'Signer ' || lang AS signer_name, CAST(r.doc_id % 400 AS DOUBLE) AS stamp_x,
  CAST(greatest(842 - (yy + hh), 0) AS DOUBLE) AS stamp_y,
  CAST(greatest(r.doc_id % 200, 120) AS DOUBLE) AS stamp_width, CAST(greatest(hh, 60) AS DOUBLE) AS stamp_height,
  CASE WHEN r.doc_id % 2 = 0 THEN 'Accord' ELSE 'Approbation légale' END AS reason, 'Paris, FR' AS location,
  sha256(text) AS sha256, substr(sha256(text), 1, 16) AS short_hash,
  '05/03/2024 06:07:08 UTC' AS timestamp_utc, 'D:20240305060708Z' AS pdf_date
FROM r JOIN pg ON pg.doc_id = r.doc_id AND pg.page_number = pn""",
    "digest_verification": """
SELECT d.doc_id, CASE WHEN toxic IS NULL THEN 'new' WHEN toxic = 0 THEN 'ok' ELSE 'changed' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "form_fields": f"""WITH {FIELDS}
SELECT doc_id, obj_id, page_number, 'fld_' || page_number || '_' || name AS field_id, name, field_type,
  x, y, width, height, value, default_value, read_only, required, multiline, options FROM f""",
    "form_summary": """
SELECT c_custkey AS doc_id, count(o_orderkey) AS fields_count, count(o_orderkey) > 0 AS has_forms
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "form_fill": f"""WITH {FIELDS},
g AS (SELECT o_custkey AS doc_id, 'field' || o_orderkey AS name,
  CASE WHEN o_orderkey % 8 = 0 THEN 'ON' ELSE o_orderpriority END AS nv FROM orders)
SELECT f.doc_id, obj_id, f.name, CASE WHEN it IS NULL OR nv IS NULL THEN value
    WHEN field_type = 'checkbox' THEN CASE WHEN nv = 'ON' THEN 'Yes' ELSE 'Off' END ELSE nv END AS value,
  it IS NOT NULL AND nv IS NOT NULL AS updated FROM f LEFT JOIN g ON g.doc_id = f.doc_id AND g.name = f.name""",
}
