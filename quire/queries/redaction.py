"""Redaction queries: orders from hits, placement, text removal and leak check."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N
from quire.operators import pii, redact, textlayer
from quire.plans.durable import settled
from quire.queries.pii import CONTACT_HITS, CONTACTS, REFERENCE, contacts
from quire.queries.shared import words_of
from quire.sources.tables import table


def _orders(spark, sf):
    return pii.redaction_orders(pii.scan_text(contacts(spark, sf)))


def redaction_orders(spark, sf):
    pages = textlayer.pages(contacts(spark, sf))
    return redact.place(_orders(spark, sf), pages).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), "x", "width",
        "height", "pdf_y", "label", "label_shown", "label_x", "label_y")


def redacted_text(spark, sf):
    return redact.redact_texts(contacts(spark, sf), _orders(spark, sf)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", "is_redacted")


def redaction_leaks(spark, sf):
    """Hits per category before and after redaction."""
    text = contacts(spark, sf)
    # ids are twice the size of the rest of a hit, and made again from its place
    hits = settled(pii.scan_text(text).select(
        "doc_id", "page_number", "line_no", "span_idx", "span_count", "category", "matched_text",
        "x", "y", "width", "height"))
    hits = hits.withColumn("hit_id", pii.hit_id(["doc_id", "page_number", "line_no"]))
    done = redact.redact_texts(text, pii.redaction_orders(hits))
    left = redact.remaining_hits(done, hits)
    tagged = hits.select("category", F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        left.select("category", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return tagged.groupBy("category").agg(F.sum("b").alias("hits_before"),
                                          F.sum("a").alias("hits_after"))


def redacted_names(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".PDF").otherwise(F.lit(".docx")))
    return part.select("p_partkey", N.redacted_name(name).alias("redacted_name"),
                       N.watermarked_name(F.lower(name)).alias("watermarked_name"),
                       N.converted_name(name, F.col("p_partkey") % 3 == 0).alias("converted_name"))


QUERIES = {f.__name__: f for f in (
    redaction_orders, redacted_text, redaction_leaks, redacted_names)}

SQL = {
    "redaction_orders": f"""{CONTACT_HITS}, {REFERENCE}
SELECT doc_id, line_no // 48 + 1 AS page_number, CAST(x AS DOUBLE) AS x,
  CAST(width AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height,
  CAST(842 - (32 + 15 * (line_no % 48) + 10) AS DOUBLE) AS pdf_y, 'DONNEE SENSIBLE RGPD' AS label,
  true AS label_shown, CAST(x + 4 AS DOUBLE) AS label_x,
  CAST(842 - (32 + 15 * (line_no % 48) + 10) + 2 AS DOUBLE) AS label_y FROM kept""",
    "redacted_text": f"""{CONTACT_HITS}, {REFERENCE}, {words_of('lines', 'allw')},
hit AS (SELECT DISTINCT a.doc_id, a.line_no, a.idx FROM allw a JOIN kept k
  ON a.doc_id = k.doc_id AND a.line_no = k.line_no
  AND k.x < 50 + 6 * (a.start_at + length(a.word)) AND k.x + k.width > 50 + 6 * a.start_at),
red AS (SELECT doc_id, line_no, string_agg(CASE WHEN h.idx IS NULL THEN word
          ELSE 'DONNEE SENSIBLE RGPD' END, ' ' ORDER BY a.idx) AS line
  FROM allw a LEFT JOIN hit h USING (doc_id, line_no, idx)
  GROUP BY ALL HAVING count(h.idx) > 0)
SELECT l.doc_id, l.line_no, coalesce(r.line, l.line) AS line, r.line IS NOT NULL AS is_redacted
FROM lines l LEFT JOIN red r USING (doc_id, line_no)""",
    "redaction_leaks": f"""{CONTACT_HITS}, {REFERENCE}
SELECT category, count(*) AS hits_before, CAST(0 AS BIGINT) AS hits_after FROM kept GROUP BY 1""",
    "redacted_names": """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'redacted_' || p_name || '.PDF'
                       ELSE 'redacted_' || p_name || '.docx.pdf' END AS redacted_name,
       CASE WHEN p_size % 2 = 0 THEN lower(p_name) || '_filigrane.pdf'
            ELSE lower(p_name) || '.docx_filigrane.pdf' END AS watermarked_name,
       p_name || CASE WHEN p_partkey % 3 = 0 THEN '_converted.pdf' ELSE '.pdf' END AS converted_name FROM part""",
}
