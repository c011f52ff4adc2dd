"""Extraction queries; the files are written from table rows and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.queries.shared import LINES
from quire.plans.durable import settled
from quire.sources import extract as E, members
from quire.sources.tables import spread, table


def _files(df, ext, content):
    return df.select(F.col("doc_id").cast("string").alias("path"), F.lit(ext).alias("ext"),
                     content.alias("content"))


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))


def _as_rtf(text):
    for raw, escaped in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\r\n", "\n"),
                         ("\n", "\\par \n")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    head = F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Courier;}}{\\*\\generator made}\\f0 ")
    return F.encode(F.concat(head, text, F.lit("}")), "utf-8")


def rtf_lines(spark, sf):
    parts = E.decode(_files(_docs(spark, sf), "rtf", _as_rtf(F.col("text"))), ("rtf",))
    return E.part_lines(parts).select(
        F.col("path").cast("bigint").alias("doc_id"),
        F.col("line_no").cast("bigint").alias("line_no"), "line")


def _mails(spark, sf):
    t = spread(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    att = F.base64(F.encode(F.concat(F.lit("file "), "turn"), "utf-8"))
    mail = F.concat(
        F.lit("From: "), "role", F.lit("@example.com\r\nTo: conv"), "conv_id",
        F.lit("@example.com\r\nSubject: Turn "), "turn",
        F.lit("\r\nDate: Mon, 04 Mar 2024 10:00:00 +0000\r\nMIME-Version: 1.0\r\n"
              "Content-Type: multipart/mixed; boundary=zz\r\n\r\n--zz\r\n"
              "Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"),
        F.replace("text", F.lit("\n"), F.lit("\r\n")),
        F.lit("\r\n--zz\r\nContent-Type: text/csv\r\nContent-Disposition: attachment"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("; filename=t"), "turn", F.lit(".csv")))
        .otherwise(F.lit("")),
        F.lit("\r\nContent-Transfer-Encoding: base64\r\n\r\n"), att, F.lit("\r\n--zz--\r\n"))
    return t.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.lit("eml").alias("ext"),
                    F.encode(mail, "utf-8").alias("content"))


def mail_messages(spark, sf):
    return E.messages(E.decode(_mails(spark, sf))).select(
        "path", "subject", "sender", "recipient", "date",
        F.md5(F.rtrim(F.replace("body", F.lit("\r\n"), F.lit("\n")), F.lit("\n"))).alias("body_md5"))


def mail_attachments(spark, sf):
    return E.attachments(E.decode(_mails(spark, sf)))


def _zipped(member):
    @F.pandas_udf("binary")
    def pack(bodies: pd.Series) -> pd.Series:
        def one(body):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(member, body)
            return buf.getvalue()

        return bodies.map(one)

    return pack


def _docx_files(spark, sf):
    d = _docs(spark, sf)
    para = F.transform(X.lines(F.col("text")), lambda t: F.concat(
        F.lit("<w:p><w:pPr/><w:r><w:t xml:space=\"preserve\">"), X.escape_xml(t),
        F.lit("</w:t></w:r></w:p>")))
    image = F.lit('<w:p><w:r><w:t>Figure</w:t><wp:extent cx="1270000" cy="635000"/>'
                  '<a:blip r:embed="rId7"/></w:r></w:p>')
    xml = F.concat(F.lit("<w:document><w:body>"), F.array_join(para, ""), image,
                   F.lit("</w:body></w:document>"))
    return _files(d, "docx", _zipped("word/document.xml")(xml))


def _docx_columns(blocks):
    return blocks.select(
        F.col("path").cast("bigint").alias("doc_id"), F.col("para_no").cast("bigint")
        .alias("para_no"), "kind", "text", "is_heading", "rel_id", "cx_pt", "cy_pt")


def docx_paragraphs(spark, sf):
    return _docx_columns(E.docx_blocks(E.decode(_docx_files(spark, sf), ("docx",))))


def docx_pulled(spark, sf):
    """The same paragraphs from members that are never held whole."""
    return _docx_columns(members.docx_blocks(members.nodes(_docx_files(spark, sf))))


def _xlsx_files(spark, sf):
    d = _docs(spark, sf)
    cells = F.transform(X.lines(F.col("text")), lambda t: F.concat(
        F.lit("<si><t>"), X.escape_xml(t), F.lit("</t></si>")))
    xml = F.concat(F.lit("<sst>"), F.array_join(cells, ""), F.lit("</sst>"))
    return _files(d, "xlsx", _zipped("xl/sharedStrings.xml")(xml))


def _xlsx_columns(lines):
    return lines.select(
        F.col("path").cast("bigint").alias("doc_id"),
        F.col("line_no").cast("bigint").alias("line_no"), F.md5("line").alias("line_md5"))


def xlsx_rows(spark, sf):
    return _xlsx_columns(E.part_lines(E.decode(_xlsx_files(spark, sf), ("xlsx",))))


def xlsx_pulled(spark, sf):
    """The same lines from shared strings that are pulled one by one."""
    files = settled(_xlsx_files(spark, sf))
    return _xlsx_columns(members.xlsx_lines(files, settled(members.nodes(files))))


def odt_lines(spark, sf):
    d = _docs(spark, sf)
    body = F.transform(X.lines(F.col("text")), lambda t: F.concat(
        F.lit("<text:p>"), X.escape_xml(t), F.lit("</text:p>")))
    xml = F.concat(F.lit("<office:text>"), F.array_join(body, "\n"), F.lit("</office:text>"))
    files = _files(d, "odt", _zipped("content.xml")(xml))
    return E.part_lines(E.decode(files, ("odt",))).select(
        F.col("path").cast("bigint").alias("doc_id"),
        F.col("line_no").cast("bigint").alias("line_no"), "line")


def extraction_rejects(spark, sf):
    """Plain texts that claim to be archives are rejected, not fatal."""
    d = _docs(spark, sf)
    files = _files(d, "docx", F.encode("text", "utf-8"))
    return E.rejects(E.decode(files, ("docx",))).select(F.col("path").cast("bigint").alias("doc_id"), "ext")


# formats of the mixed corpus; every document takes one by its number
KINDS = ["rtf", "txt", "docx", "xlsx", "odt", "ods", "odp", "odg", "vsdx", "png", "xyz", "bin", "doc",
         "md", "docx"]


def _mixed(spark, sf):
    d = _docs(spark, sf)
    no = F.col("doc_id") % len(KINDS)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (no + 1).cast("int"))
    lines = X.lines(F.col("text"))

    def tagged(tag):
        return F.array_join(F.transform(lines, lambda t: F.concat(
            F.lit(f"<{tag}>"), X.escape_xml(t), F.lit(f"</{tag}>"))), "\n")

    broken = (kind == "docx") & (no == len(KINDS) - 1)
    member = {"docx": "word/document.xml", "xlsx": "xl/sharedStrings.xml", "vsdx": "visio/pages/page2.xml"}
    content = F.when(kind == "rtf", _as_rtf(F.col("text"))).when(
        broken | kind.isin("txt", "md", "xyz", "doc"), F.encode("text", "utf-8")).when(
        kind == "png", F.unhex(F.lit("89504E470D0A1A0A"))).when(
        kind == "bin", F.encode(F.concat("text", F.lit("\0")), "utf-8"))
    xml = F.when(kind == "docx", F.array_join(F.transform(lines, lambda t: F.concat(
        F.lit("<w:p><w:t>"), X.escape_xml(t), F.lit("</w:t></w:p>"))), "")).when(
        kind == "xlsx", F.array_join(F.transform(lines, lambda t: F.concat(
            F.lit("<si><t>"), X.escape_xml(t), F.lit("</t></si>"))), "")).otherwise(tagged("p"))
    for k in ("docx", "xlsx", "odt", "ods", "odp", "odg", "vsdx"):
        content = content.when(kind == k, _zipped(member.get(k, "content.xml"))(xml))
    return d.select(F.col("doc_id").cast("string").alias("path"), kind.alias("ext"),
                    content.alias("content"))


def extracted_lines(spark, sf):
    """Lines per file over all formats at once, with the rejects of the same pass."""
    reason = F.when(F.col("reason").startswith("BadZipFile"), "broken").otherwise(F.col("reason"))
    return E.extract_lines(_mixed(spark, sf)).groupBy(F.col("path").cast("bigint").alias("doc_id")).agg(
        F.count("line").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"),
        F.max(reason).alias("reason"))


QUERIES = {f.__name__: f for f in (
    rtf_lines, mail_messages, mail_attachments, docx_paragraphs, docx_pulled, xlsx_rows,
    xlsx_pulled, odt_lines,
    extraction_rejects, extracted_lines)}

_HEADING = (r"(strlen(line) < 50 AND (regexp_matches(line, '^[1-6][.]') OR NOT regexp_matches(line, "
            r"'\p{Ll}|\p{Lt}|\p{Lm}|\p{Lo}')))")

SQL = {
    "rtf_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines",
    "mail_messages": r"""
SELECT conv_id || '/' || turn AS path, 'Turn ' || turn AS subject, role || '@example.com' AS sender,
  'conv' || conv_id || '@example.com' AS recipient, '2024-03-04T10:00:00+00:00' AS date,
  md5(rtrim(text, chr(10))) AS body_md5 FROM conversations""",
    "mail_attachments": """
SELECT conv_id || '/' || turn AS path, 'att_1' AS attachment_id,
  CASE WHEN turn % 2 = 0 THEN 't' || turn || '.csv' ELSE 'attachment_1' END AS filename,
  'text/csv' AS mime_type, CAST(strlen('file ' || turn) AS BIGINT) AS size FROM conversations""",
    "docx_paragraphs": f"""WITH {LINES},
p AS (SELECT doc_id, line_no, trim(line) AS line FROM lines)
SELECT doc_id, line_no AS para_no, 'paragraph' AS kind, line AS text, {_HEADING} AS is_heading,
  CAST(NULL AS VARCHAR) AS rel_id, CAST(NULL AS DOUBLE) AS cx_pt, CAST(NULL AS DOUBLE) AS cy_pt
FROM p WHERE line <> ''
UNION ALL
SELECT doc_id, n, 'paragraph', 'Figure', false, NULL, NULL, NULL
FROM (SELECT d.doc_id, count(l.line_no) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY 1)
UNION ALL
SELECT doc_id, n, 'image', NULL, false, 'rId7', 100, 50
FROM (SELECT d.doc_id, count(l.line_no) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY 1)""",
    "xlsx_rows": f"""WITH {LINES},
c AS (SELECT doc_id, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i
      FROM lines WHERE trim(line) <> ''),
r AS (SELECT doc_id, i // 5 + 2 AS line_no, string_agg(t, '  |  ' ORDER BY i) AS line FROM c GROUP BY 1, 2)
SELECT doc_id, line_no, md5(line) AS line_md5 FROM r
UNION ALL SELECT doc_id, 0, md5('=== CLASSEUR EXCEL (XLSX) ===') FROM documents
UNION ALL SELECT doc_id, 1, md5(CASE WHEN doc_id IN (SELECT doc_id FROM c)
  THEN 'Données extraites des feuilles :' ELSE 'Feuille de calcul (aucune chaîne partagée détectée)' END)
FROM documents""",
    "odt_lines": rf"""WITH {LINES},
c AS (SELECT doc_id, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i
      FROM lines WHERE strlen(trim(line)) > 1 AND NOT regexp_matches(trim(line), '^\p{{N}}+$'))
SELECT doc_id, i AS line_no, t AS line FROM c
UNION ALL SELECT doc_id, 0, '=== DOCUMENT TEXTE OPENDOCUMENT (ODT) ===' FROM documents
UNION ALL SELECT doc_id, 1, 'Document diagramme .ODT prêt pour affichage vectoriel.' FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM c)""",
    "extraction_rejects": "SELECT doc_id, 'docx' AS ext FROM documents",
    "extracted_lines": rf"""WITH {LINES},
k AS (SELECT doc_id, text, {KINDS}[doc_id % {len(KINDS)} + 1] AS kind,
        doc_id % {len(KINDS)} = {len(KINDS) - 1} AS broken FROM documents),
x AS (SELECT doc_id, kind, broken, regexp_replace(line, '^[ \t\n\f\r\x0B]+|[ \t\n\f\r\x0B]+$', '', 'g') AS t,
        line, line_no FROM k JOIN lines USING (doc_id)),
plain AS (SELECT doc_id, line AS l FROM x WHERE kind IN ('rtf', 'txt', 'md', 'xyz')
  UNION ALL SELECT doc_id, t FROM x WHERE kind = 'docx' AND NOT broken AND t <> ''
  UNION ALL SELECT doc_id, t FROM x WHERE kind IN ('odt', 'ods', 'odp', 'odg', 'vsdx')
    AND strlen(t) > 1 AND NOT regexp_matches(t, '^\p{{N}}+$')
  UNION ALL SELECT doc_id, string_agg(t, '  |  ' ORDER BY i) FROM (
    SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i
    FROM x WHERE kind = 'xlsx' AND t <> '') GROUP BY doc_id, i // 5),
titles AS (SELECT doc_id, unnest(CASE kind
    WHEN 'xlsx' THEN ['=== CLASSEUR EXCEL (XLSX) ===', CASE WHEN doc_id IN (SELECT doc_id FROM plain)
      THEN 'Données extraites des feuilles :' ELSE 'Feuille de calcul (aucune chaîne partagée détectée)' END]
    ELSE list_filter([CASE kind WHEN 'odt' THEN '=== DOCUMENT TEXTE OPENDOCUMENT (ODT) ==='
      WHEN 'ods' THEN '=== TABLEUR OPENDOCUMENT (ODS) ===' WHEN 'odp' THEN '=== PRESENTATION OPENDOCUMENT (ODP) ==='
      WHEN 'odg' THEN '=== DESSIN / SCHEMA VECTORIEL OPENDOCUMENT (ODG) ==='
      ELSE '=== DIAGRAMME MICROSOFT VISIO (VSDX) ===' END, CASE WHEN doc_id NOT IN (SELECT doc_id FROM plain)
      THEN 'Document diagramme .' || upper(kind) || ' prêt pour affichage vectoriel.' END],
      lambda v: v IS NOT NULL) END) AS l
  FROM k WHERE kind IN ('xlsx', 'odt', 'ods', 'odp', 'odg', 'vsdx')),
every AS (SELECT * FROM plain UNION ALL SELECT * FROM titles),
n AS (SELECT doc_id, count(*) AS n, CAST(sum(length(l)) AS BIGINT) AS c FROM every GROUP BY 1),
r AS (SELECT doc_id, n, c, CASE WHEN broken THEN 'broken' WHEN kind = 'png' THEN 'no text decoder: image'
    WHEN kind = 'doc' THEN 'no text decoder: office' WHEN kind = 'bin' THEN 'binary' END AS reason
  FROM k LEFT JOIN n USING (doc_id))
SELECT doc_id, coalesce(n, 0) AS n_lines, c AS n_chars, reason FROM r
WHERE n IS NOT NULL OR reason IS NOT NULL""",
}
SQL["docx_pulled"], SQL["xlsx_pulled"] = SQL["docx_paragraphs"], SQL["xlsx_rows"]
