"""Text of mail, RTF, DOCX, XLSX and archive XML files.

Only what needs a decoder runs in Python, one file at a time and without state
between files: RTF control words, unzipping. Mail, XML text nodes, paragraphs,
rows and lines are left to Spark expressions.
"""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import mail as M, names as N, text as X

# The members read of each format, in order; a star stands for a number.
MEMBERS = {
    "docx": ["word/document.xml"],
    "xlsx": ["xl/sharedStrings.xml"],
    "odg": ["content.xml"], "odt": ["content.xml"], "ods": ["content.xml"], "odp": ["content.xml"],
    "vsdx": ["visio/pages/page*.xml", "visio/document.xml"],
}
# Fixed value: bytes that a member may inflate to when it is read whole; quire.sources.members pulls
# longer ones.
MEMBER_LIMIT = 30 << 20
# Titles and fallback lines of extracted archives.
TITLES = {
    "odg": "=== DESSIN / SCHEMA VECTORIEL OPENDOCUMENT (ODG) ===",
    "vsdx": "=== DIAGRAMME MICROSOFT VISIO (VSDX) ===",
    "odt": "=== DOCUMENT TEXTE OPENDOCUMENT (ODT) ===",
    "ods": "=== TABLEUR OPENDOCUMENT (ODS) ===",
    "odp": "=== PRESENTATION OPENDOCUMENT (ODP) ===",
}
XLSX_TITLE = "=== CLASSEUR EXCEL (XLSX) ==="
XLSX_FOUND = "Données extraites des feuilles :"
XLSX_EMPTY = "Feuille de calcul (aucune chaîne partagée détectée)"
XLSX_JOIN, XLSX_ROW = "  |  ", 5
# Extensions of mail messages.
MAIL = ("eml", "msg")
# RTF groups without readable text, control words that write a character.
RTF_SKIPPED = ("fonttbl", "colortbl", "stylesheet", "info")
RTF_WORDS = {"par": "\n", "line": "\n", "row": "\n", "tab": "\t"}

_RTF = re.compile(
    r"(?P<open>\{(?:(?=\\(?P<dest>[A-Za-z*]+)))?)|(?P<close>\})|\\(?P<escaped>[\\{}])"
    r"|\\'(?P<hex>[0-9A-Fa-f]{0,2})|(?P<blank>\\~)|\\(?P<word>[A-Za-z]*)[-0-9]* ?"
    r"|(?P<eol>[\r\n]+)|(?P<plain>[^\\{}\r\n]+)")


def rtf_text(data: bytes) -> str:
    """Readable text of an RTF stream."""
    out: list[str] = []
    depth, hidden_at = 0, None
    for m in _RTF.finditer(data.decode("utf-8", "replace")):
        kind = m.lastgroup if m.lastgroup != "dest" else "open"
        if kind == "open":
            depth += 1
            dest = m["dest"] or ""
            if hidden_at is None and (dest in RTF_SKIPPED or dest.startswith("*")):
                hidden_at = depth
        elif kind == "close":
            if hidden_at is not None and depth <= hidden_at:
                hidden_at = None
            depth = max(depth - 1, 0)
        elif hidden_at is None:
            if kind in ("escaped", "plain"):
                out.append(m[kind])
            elif kind == "hex":
                code = int(m["hex"], 16) if m["hex"] else 0
                out.append(chr(code) if code >= 32 else "")
            elif kind == "blank":
                out.append(" ")
            elif kind == "word":
                out.append(RTF_WORDS.get(m["word"], ""))
    return "".join(out)


def _decode_rtf(data: bytes) -> list[dict]:
    return [{"part": "text", "body": rtf_text(data)}]


def _decode_archive(ext: str):
    def decode(data: bytes) -> list[dict]:
        bodies = []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for wanted in MEMBERS[ext]:
                pattern = re.compile(re.escape(wanted).replace(r"\*", "([0-9]+)"))
                found = [m for m in map(pattern.fullmatch, z.namelist()) if m]
                for m in sorted(found, key=lambda m: [int(n) for n in m.groups()]):
                    with z.open(m[0]) as stream:  # what it inflates to is not told reliably
                        body = stream.read(MEMBER_LIMIT + 1)
                    if len(body) > MEMBER_LIMIT:
                        raise ValueError(f"{m[0]} inflates to more than {MEMBER_LIMIT} bytes")
                    bodies.append(body.decode("utf-8", "replace"))
        return [{"part": "xml", "body": "\n".join(bodies)}]

    return decode


DECODERS = {"rtf": _decode_rtf, **{ext: _decode_archive(ext) for ext in MEMBERS}}

_FIELDS = ("part", "name", "body", "subject", "sender", "recipient", "date", "mime", "size", "reason")
_PARTS = "array<struct<%s>>" % ",".join(
    f"{f}:{'bigint' if f == 'size' else 'string'}" for f in _FIELDS)


def _parts(ext: Column, content: Column, formats: tuple[str, ...]) -> Column:
    """Decoded parts of a file; only files with a decoder are handed to Python."""
    @F.pandas_udf(_PARTS)
    def decoded(exts: pd.Series, contents: pd.Series) -> pd.Series:
        def one(kind, data):
            if data is None:
                return None
            try:
                found = DECODERS[kind](bytes(data))
            except Exception as e:  # a broken file must not end the job
                found = [{"part": "reject", "reason": f"{type(e).__name__}: {e}"}]
            return [{f: part.get(f) for f in _FIELDS} for part in found]

        return pd.Series([one(k, d) for k, d in zip(exts, contents)], dtype=object)

    python = [f for f in formats if f in DECODERS]
    found = [decoded(ext, F.when(ext.isin(*python), content))] if python else []
    mail = [f for f in formats if f in MAIL]
    return F.coalesce(*[F.when(ext.isin(*mail), M.message_parts(content))] * bool(mail), *found)


def decode(files: DataFrame, formats: tuple[str, ...] = (*DECODERS, *MAIL)) -> DataFrame:
    """Decoded parts of files (path, ext, content); unreadable files become a reject row.

    ``formats`` are the extensions to decode; files of others have no parts.
    """
    parts = files.select("path", "ext", _parts(F.col("ext"), F.col("content"), formats).alias("_parts"))
    return parts.select("path", "ext", F.explode_outer("_parts").alias("_p")).where(
        "_p is not null").select("path", "ext", "_p.*")


# --- from decoded parts to lines, in Spark --------------------------------------

def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{X.WS}]+|[{X.WS}]+$", "")


_T_NODE = r"<(?:\w+:)?t(?: [^>]*)?>([^<]*)</(?:\w+:)?t>"
_PARAGRAPH = r"(?s)<(?:\w+:)?p(?: [^>]*)?(?<!/)>(.*?)</(?:\w+:)?p>"
_PIECES = (r"(<(?:\w+:)?t(?: [^>]*)?>[^<]*</(?:\w+:)?t>|<(?:\w+:)?(?:blip|imagedata) [^>]*>"
           r"|<(?:\w+:)?extent [^>]*>)")
_IMAGE = r"^<(?:\w+:)?(?:blip|imagedata) "


def _docx_blocks(xml: Column) -> Column:
    """Blocks per paragraph: array of struct<blocks, ends_in_text>.

    A picture ends the text before it, which then counts as a plain paragraph.
    """
    # walk the pieces of one paragraph: text gathers until a picture or the end
    block = "struct<text:string,rel_id:string,cx_pt:double,cy_pt:double>"
    nothing = F.lit(None).cast("double")
    start = F.struct(F.lit("").alias("text"), nothing.alias("cx"), nothing.alias("cy"),
                     F.expr(f"cast(array() as array<{block}>)").alias("done"))

    def paragraph(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(None).cast("string").alias("rel_id"),
                        nothing.alias("cx_pt"), nothing.alias("cy_pt"))

    def points(piece: Column, attr: str) -> Column:
        return F.regexp_extract(piece, rf'[ :]{attr}="([^"]*)"', 1).try_cast("double") / 12700.0

    def flushed(acc: Column) -> Column:
        body = _trimmed(acc["text"])
        return F.when(body != "", F.array_append(acc["done"], paragraph(body))).otherwise(acc["done"])

    def step(acc: Column, piece: Column) -> Column:
        is_image, is_extent = piece.rlike(_IMAGE), piece.rlike(r"^<(?:\w+:)?extent ")
        rel = F.regexp_extract(piece, r'[ :](?:embed|link|id)="([^"]*)"', 1)
        image = F.struct(F.lit(None).cast("string").alias("text"), rel.alias("rel_id"),
                         acc["cx"].alias("cx_pt"), acc["cy"].alias("cy_pt"))
        return (
            F.when(is_image & (rel != ""), F.struct(
                F.lit("").alias("text"), nothing.alias("cx"), nothing.alias("cy"),
                F.array_append(flushed(acc), image).alias("done")))
            .when(is_image, acc)
            .when(is_extent, F.struct(
                acc["text"].alias("text"), F.coalesce(points(piece, "cx"), acc["cx"]).alias("cx"),
                F.coalesce(points(piece, "cy"), acc["cy"]).alias("cy"), acc["done"].alias("done")))
            .otherwise(F.struct(
                F.concat(acc["text"], F.coalesce(
                    X.unescape_xml(_trimmed(F.regexp_extract(piece, _T_NODE, 1))), F.lit("")))
                .alias("text"), acc["cx"].alias("cx"), acc["cy"].alias("cy"),
                acc["done"].alias("done"))))

    def walk(body: Column) -> Column:
        return F.aggregate(
            F.regexp_extract_all(body, F.lit(_PIECES), 1), start, step,
            lambda acc: F.struct(flushed(acc).alias("blocks"),
                                 (_trimmed(acc["text"]) != "").alias("ends_in_text")))

    return F.transform(F.regexp_extract_all(xml, F.lit(_PARAGRAPH), 1), walk)


def docx_paragraph_blocks(xml: Column) -> Column:
    """The blocks of an XML text of one paragraph."""
    return F.get(_docx_blocks(xml), F.lit(0))


def docx_blocks(parts: DataFrame) -> DataFrame:
    """Paragraphs and image references of DOCX bodies in order."""
    xml = parts.where((F.col("ext") == "docx") & (F.col("part") == "xml"))
    return block_rows(xml.select("path", _docx_blocks(F.col("body")).alias("_ps")).select(
        "path", F.posexplode("_ps").alias("para_no", "_b")))


def block_rows(paras: DataFrame) -> DataFrame:
    """One row for each block of paragraphs (path, para_no, _b)."""
    rows = paras.select(
        "path", "para_no", (F.size("_b.blocks") - 1).alias("_last"),
        F.col("_b.ends_in_text").alias("_text"), F.posexplode("_b.blocks").alias("block_no", "b"))
    at_end = F.col("_text") & (F.col("block_no") == F.col("_last"))
    return rows.select(
        "path", "para_no", "block_no", F.when(F.col("b.rel_id").isNull(), "paragraph")
        .otherwise("image").alias("kind"), F.col("b.text").alias("text"),
        (at_end & X.is_heading(F.coalesce("b.text", F.lit("")))).alias("is_heading"),
        F.col("b.rel_id").alias("rel_id"), F.col("b.cx_pt").alias("cx_pt"),
        F.col("b.cy_pt").alias("cy_pt"))


def _docx_lines(xml: Column) -> Column:
    texts = F.transform(F.flatten(F.transform(_docx_blocks(xml), lambda p: p["blocks"])),
                        lambda b: b["text"])
    return F.array_compact(texts)


def _xlsx_lines(xml: Column) -> Column:
    """Shared strings, five to a line, below a title."""
    strings = X.text_nodes(xml, r"<t(?: [^>]*)?>([^<]*)</t>")

    def rows(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(s) / XLSX_ROW).cast("int") - 1),
            lambda i: F.array_join(F.slice(s, i * XLSX_ROW + 1, XLSX_ROW), XLSX_JOIN))

    return X.bind(strings, lambda s: F.when(
        F.size(s) > 0, F.concat(F.array(F.lit(XLSX_TITLE), F.lit(XLSX_FOUND)), rows(s))
    ).otherwise(F.array(F.lit(XLSX_TITLE), F.lit(XLSX_EMPTY))))


def _archive_lines(ext: Column, xml: Column) -> Column:
    """Text nodes of an OpenDocument or Visio archive below a title."""
    nodes = X.markup_text_nodes(xml)
    titles = F.create_map(*[F.lit(v) for kv in TITLES.items() for v in kv])
    empty = F.concat(F.lit("Document diagramme ."), F.upper(ext),
                     F.lit(" prêt pour affichage vectoriel."))
    return X.bind(nodes, lambda n: F.concat(
        F.array(F.try_element_at(titles, ext)),
        F.when(F.size(n) > 0, n).otherwise(F.array(empty))))


def _part_lines(ext: Column, part: Column, body: Column) -> Column:
    """Lines of one decoded part; null for parts without text."""
    xml = part == "xml"
    return (
        F.when(part.isin("text", "message"), X.lines(body))
        .when(xml & (ext == "docx"), _docx_lines(body))
        .when(xml & (ext == "xlsx"), _xlsx_lines(body))
        .when(xml & ext.isin(*TITLES), _archive_lines(ext, body)))


def part_lines(parts: DataFrame) -> DataFrame:
    """Text lines of decoded parts."""
    lines = _part_lines(F.col("ext"), F.col("part"), F.col("body"))
    return parts.select("path", lines.alias("_l")).select(
        "path", F.posexplode_outer("_l").alias("line_no", "line")).where("line_no is not null")


def messages(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("part") == "message").select(
        "path", "subject", "sender", "recipient", "date", "body")


def attachments(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("part") == "attachment").select(
        "path", F.col("name").alias("attachment_id"), F.col("subject").alias("filename"),
        F.col("mime").alias("mime_type"), "size")


def rejects(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("part") == "reject").select("path", "ext", "reason")


def no_text_reason(ext: Column, content: Column) -> Column:
    """Why a file without a decoder is no text; null if it can be read as text."""
    families = F.create_map(*[F.lit(v) for family, exts in N.FAMILIES.items()
                              if family not in ("markdown", "text") for e in exts
                              for v in (e, family)])
    family = F.try_element_at(families, ext)
    return (F.when(family.isNotNull(), F.concat(F.lit("no text decoder: "), family))
            .when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")
            .when(F.contains(content, F.lit(b"\0")), "binary"))


def extract_lines(files: DataFrame) -> DataFrame:
    """Text lines of all files (path, ext, content), and rows with the reason of each reject.

    path, line_no, line, reason. Known archives, mail and RTF are decoded, text
    and unknown formats that hold text stay in the JVM, everything else and
    every file that cannot be read is a reject, in one pass over the files.
    """
    known = F.col("ext").isin(*DECODERS, *MAIL)
    rows = files.select(
        "path", "ext", "content",
        _parts(F.col("ext"), F.col("content"), (*DECODERS, *MAIL)).alias("_parts"),
        F.when(~known, no_text_reason(F.col("ext"), F.col("content"))).alias("_reason"))
    plain = F.when(~known & F.col("_reason").isNull(), F.col("content").cast("string"))
    parts = rows.select("path", "ext", plain.alias("_plain"), "_reason",
                        F.explode_outer("_parts").alias("_p"))
    lines = F.when(F.col("_plain").isNotNull(), X.lines(F.col("_plain"))).otherwise(
        _part_lines(F.col("ext"), F.col("_p.part"), F.col("_p.body")))
    reason = F.coalesce("_reason", F.when(F.col("_p.part") == "reject", F.col("_p.reason")))
    return parts.select("path", lines.alias("_l"), reason.alias("reason")).select(
        "path", F.posexplode_outer("_l").alias("line_no", "line"), "reason").where(
        "line_no is not null or reason is not null")
