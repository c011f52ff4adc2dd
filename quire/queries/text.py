"""Text layer queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import textlayer as L
from quire.queries.shared import LINES, WS, words_of
from quire.sources.tables import spread, table


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))


def text_lines(spark, sf):
    return L.lines(docs(spark, sf)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        F.col("page_number").cast("bigint").alias("page_number"),
        F.col("page_count").cast("bigint").alias("page_count"), "line")


def text_pages(spark, sf):
    return L.pages(docs(spark, sf)).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"),
        F.col("page_count").cast("bigint").alias("page_count"),
        F.col("n_lines").cast("bigint").alias("n_lines"))


def text_mail_pages(spark, sf):
    return (
        L.mail_lines(docs(spark, sf)).groupBy("doc_id", F.col("page_number").cast("bigint")
                                              .alias("page_number"))
        .agg(F.count("*").alias("n_lines"))
    )


def text_layout(spark, sf):
    laid = L.layout(L.lines(docs(spark, sf)))
    return laid.select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "x", "y",
        X.escape_pdf(F.col("shown")).alias("shown"), "footer")


def text_truncated(spark, sf):
    """The truncating layout: what 95 columns keep of every line, and the rest."""
    laid = L.layout(L.lines(docs(spark, sf)), max_cols=95)
    return laid.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "shown",
                       (F.length("line") > 95).alias("is_cut"),
                       F.substr("line", F.lit(96)).alias("rest"))


def text_span_pages(spark, sf):
    """Page texts rebuilt from the span table."""
    return L.page_text(L.spans(L.lines(docs(spark, sf)))).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"),
        F.md5("page_text").alias("page_md5"), F.length("page_text").cast("bigint").alias("n_chars"))


def text_spans(spark, sf):
    return L.spans(L.lines(docs(spark, sf))).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.col("span_idx").cast("bigint").alias("span_idx"), "text", "x", "y", "width",
        "font_size")


def text_page_plain(spark, sf):
    return L.page_texts(docs(spark, sf)).where("page_text <> ''").select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"),
        F.md5("page_text").alias("page_md5"), F.length("page_text").cast("bigint").alias("n_chars"))


def text_headings(spark, sf):
    return L.headings(L.lines(docs(spark, sf))).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def text_wrapped(spark, sf):
    return (
        L.wrap(L.lines(docs(spark, sf)).select("doc_id", "line_no", "line"), "line", 80)
        .groupBy("doc_id").agg(F.count("*").alias("n_wrapped"))
    )


def text_flow_pages(spark, sf):
    return (
        L.flow_pages(docs(spark, sf).select("doc_id", "text"))
        .groupBy("doc_id", F.col("page_number").cast("bigint").alias("page_number"))
        .agg(F.count("*").alias("n_lines"), F.min("y").alias("lowest"))
    )


# nodes with references, some numeric once resolved, some malformed
REFERENCES = ("<b>&#49;&#50;</b><i> &#233;t&#xE9; &lt;b&gt; </i><u>A &nbsp; B</u><p>&#x1F642;</p>"
              "<p>R&D</p><p>&amp;#49;</p>")


def markup_text_nodes(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"))
    pages = pages.withColumn("html", F.concat("html", F.lit(REFERENCES)))
    return L.markup_nodes(pages).select(
        "page_id", F.col("node_no").cast("bigint").alias("node_no"), "node_text")


def escaped_markup(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"))
    return pages.select(
        "page_id", F.md5(X.escape_xml(F.col("html"))).alias("xml_md5"),
        F.md5(X.escape_pdf(F.col("html"))).alias("pdf_md5"))


def _boxes(line_rows):
    """One image box per line, derived from the line's own place and length."""
    return line_rows.where(F.col("line") != "").select(
        "doc_id", "page_number", F.col("line_no").alias("box_no"),
        (F.lit(X.LEFT_MARGIN) + 6.0 * (F.length("line") % 40) + 2.0).alias("x"),
        (L.span_top(F.col("line_no")) - 4.0).alias("top_y"),
        (40.0 + F.length("line") % 90).alias("width"))


def span_image_boxes(spark, sf):
    found = L.lines(docs(spark, sf).select("doc_id", "text"))
    return L.match_boxes(L.spans(found), _boxes(found)).where("box_no is not null").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        F.col("span_idx").cast("bigint").alias("span_idx"), "text",
        F.col("box_no").cast("bigint").alias("box_no"), "box_width")


def spans_fitted_to_boxes(spark, sf):
    found = L.lines(docs(spark, sf).select("doc_id", "text"))
    return L.fit_to_boxes(L.spans(found), _boxes(found)).where("scale > 1").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        F.col("span_idx").cast("bigint").alias("span_idx"), "text", F.round("x", 6).alias("x"),
        F.round("width", 6).alias("width"), F.round("font_size", 6).alias("font_size"))


QUERIES = {f.__name__: f for f in (
    text_lines, text_pages, text_mail_pages, text_layout, text_truncated,
    text_spans, text_page_plain, text_span_pages,
    text_headings, text_wrapped, text_flow_pages, markup_text_nodes, escaped_markup,
    span_image_boxes, spans_fitted_to_boxes,
)}

SQL = {
    "text_lines": f"""WITH {LINES}
SELECT doc_id, line_no, line_no // 48 + 1 AS page_number,
       CAST(ceil(n_lines / 48.0) AS BIGINT) AS page_count, line FROM lines""",
    "text_pages": r"""
WITH n AS (SELECT doc_id, len(string_split_regex(text, '\r?\n'))
             - CAST(text = '' OR regexp_matches(text, '\n$') AS INT) AS n FROM documents),
c AS (SELECT doc_id, n, greatest(CAST(ceil(n / 48.0) AS BIGINT), 1) AS page_count FROM n),
p AS (SELECT doc_id, n, page_count, unnest(range(1, page_count + 1)) AS page_number FROM c)
SELECT doc_id, page_number, page_count,
       CAST(greatest(least(48, n - (page_number - 1) * 48), 0) AS BIGINT) AS n_lines FROM p""",
    "text_mail_pages": f"""WITH {LINES}
SELECT doc_id, CAST(CASE WHEN line_no < 39 THEN 1 ELSE 2 + (line_no - 39) // 47 END AS BIGINT)
         AS page_number, count(*) AS n_lines FROM lines GROUP BY 1, 2""",
    "text_layout": rf"""WITH {LINES}
SELECT doc_id, line_no, CAST(50 AS DOUBLE) AS x, CAST(800 - 15 * (line_no % 48) AS DOUBLE) AS y,
       replace(replace(replace(replace(replace(line, '\', '\\'), '(', '\('), ')', '\)'),
         chr(13), '\r'), chr(10), '\n') AS shown,
       'Page ' || (line_no // 48 + 1) || ' / ' || CAST(ceil(n_lines / 48.0) AS BIGINT) AS footer
FROM lines""",
    "text_truncated": f"""WITH {LINES}
SELECT doc_id, line_no, left(line, 95) AS shown, length(line) > 95 AS is_cut,
  substr(line, 96) AS rest FROM lines""",
    "text_spans": f"""WITH {LINES}, {words_of("lines")}
SELECT doc_id, line_no // 48 + 1 AS page_number, line_no, idx AS span_idx, word AS text,
       CAST(50 + 6 * start_at AS DOUBLE) AS x, CAST(32 + 15 * (line_no % 48) AS DOUBLE) AS y,
       CAST(6 * length(word) AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS font_size FROM words""",
    "text_page_plain": f"""WITH {LINES}, {words_of("lines")},
l AS (SELECT doc_id, line_no, string_agg(word, ' ' ORDER BY idx) AS line FROM words GROUP BY ALL),
p AS (SELECT doc_id, line_no // 48 + 1 AS page_number,
             string_agg(line, chr(10) ORDER BY line_no) AS t FROM l GROUP BY ALL)
SELECT doc_id, page_number, md5(t) AS page_md5, length(t) AS n_chars FROM p""",
    "text_headings": rf"""WITH {LINES}
SELECT doc_id, line_no, line FROM lines
WHERE strlen(trim(line)) < 50 AND trim(line) <> ''
  AND (regexp_matches(trim(line), '^[1-6][.]')
       OR NOT regexp_matches(trim(line), '\p{{Ll}}|\p{{Lt}}|\p{{Lm}}|\p{{Lo}}'))
""",
    # state of the fold: lines so far * 10^9 + bytes of the open line
    "text_wrapped": f"""WITH {LINES},
w AS (SELECT doc_id, list_transform(regexp_extract_all(line, '[^{WS}]+'),
        lambda t: CAST(strlen(t) AS BIGINT)) AS ns FROM lines),
f AS (SELECT doc_id, list_reduce(ns, lambda a, n: CASE
        WHEN a > 0 AND a % 1000000000 + 1 + n <= 80 THEN a + 1 + n
        ELSE (a // 1000000000 + 1) * 1000000000 + n END, CAST(0 AS BIGINT)) // 1000000000 AS k FROM w)
SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_wrapped FROM f GROUP BY 1 HAVING sum(k) > 0""",
    "text_flow_pages": f"""WITH RECURSIVE {LINES},
walk AS (
  SELECT doc_id, line_no, line, 1 AS page, 780 AS y FROM lines WHERE line_no = 0
  UNION ALL
  SELECT l.doc_id, l.line_no, l.line,
    CASE WHEN w.line <> '' AND w.y - CASE WHEN w.line_no = 0 THEN 24 ELSE 16 END < 60
         THEN w.page + 1 ELSE w.page END,
    CASE WHEN w.line = '' THEN w.y - 12
         WHEN w.y - CASE WHEN w.line_no = 0 THEN 24 ELSE 16 END < 60 THEN 780
         ELSE w.y - CASE WHEN w.line_no = 0 THEN 24 ELSE 16 END END
  FROM (SELECT doc_id, line_no, trim(line) AS line, page, y FROM walk) w
  JOIN lines l ON l.doc_id = w.doc_id AND l.line_no = w.line_no + 1)
SELECT doc_id, CAST(page AS BIGINT) AS page_number, count(*) AS n_lines,
       CAST(min(y) AS DOUBLE) AS lowest FROM walk GROUP BY 1, 2""",
    "markup_text_nodes": rf"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html || '{REFERENCES}', '>([^<]+)<', 1)) AS t,
    unnest(range(len(regexp_extract_all(html || '{REFERENCES}', '>([^<]+)<', 1)))) AS i FROM pages),
u AS (SELECT page_id, i, array_to_string(list_transform(regexp_extract_all(t, '(&[^;&]*;|[^&]+)', 1),
    lambda p: CASE WHEN p LIKE '&#x%' THEN chr(('0x' || p[4:len(p) - 1])::INT)
      WHEN p LIKE '&#%' THEN chr((p[3:len(p) - 1])::INT) WHEN p = '&lt;' THEN '<'
      WHEN p = '&gt;' THEN '>' WHEN p = '&quot;' THEN '"' WHEN p = '&apos;' THEN chr(39)
      WHEN p = '&amp;' THEN '&' ELSE p END), '') AS t FROM t
  WHERE NOT regexp_matches(regexp_replace(t, '&(amp|lt|gt|quot|apos|#[0-9]{{1,7}}|#x[0-9A-Fa-f]{{1,6}});',
    '', 'g'), '&')),
n AS (SELECT page_id, i, regexp_replace(t, '^[{WS}]+|[{WS}]+$', '', 'g') AS node_text FROM u)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS node_no, node_text FROM n
WHERE strlen(node_text) > 1 AND NOT regexp_matches(node_text, '^\p{{N}}+$')""",
    "escaped_markup": r"""
SELECT page_id,
  md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
      '"', '&quot;'), '''', '&apos;')) AS xml_md5,
  md5(replace(replace(replace(replace(replace(html, '\', '\\'), '(', '\('), ')', '\)'),
      chr(13), '\r'), chr(10), '\n')) AS pdf_md5
FROM pages""",
    "span_image_boxes": f"""WITH {LINES}, {words_of("lines")},
boxes AS (
  SELECT doc_id, line_no // 48 AS pg, line_no AS box_no, 52.0 + 6 * (length(line) % 40) AS bx,
         28.0 + 15 * (line_no % 48) AS by, 40.0 + length(line) % 90 AS bw
  FROM lines WHERE line <> ''),
near AS (
  SELECT w.doc_id, w.line_no, w.idx, w.word, b.box_no, b.bw,
         row_number() OVER (PARTITION BY w.doc_id, w.line_no, w.idx ORDER BY b.box_no) AS rn
  FROM words w JOIN boxes b ON w.doc_id = b.doc_id AND w.line_no // 48 = b.pg
   AND abs(b.bx - (50 + 6 * w.start_at)) < 12 AND abs(b.by - (32 + 15 * (w.line_no % 48))) < 25)
SELECT doc_id, line_no, idx AS span_idx, word AS text, box_no, CAST(bw AS DOUBLE) AS box_width
FROM near WHERE rn = 1""",
}

SQL["text_span_pages"] = SQL["text_page_plain"]
