"""Lines, words, pages and escaping as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Page model of the plain-text rendition.
LINES_PER_PAGE = 48
LEFT_MARGIN = 50.0
FIRST_BASELINE = 800.0
LINE_PITCH = 15.0
CHAR_WIDTH = 6.0
FONT_SIZE = 10.0
PAGE_WIDTH = 595.0
PAGE_HEIGHT = 842.0

# Mail body page model (first and later baselines, step, floor).
MAIL_FIRST = 670
MAIL_NEXT = 800
MAIL_STEP = 16
MAIL_FLOOR = 60

WS = r" \t\n\f\r\x0B"
WORD = rf"[^{WS}]+"
_WS_CHARS = " \t\n\f\r\x0b"

# Words are located block by block so that a line of a million words costs
# n * sqrt(n) small copies instead of n * n.
_BLOCK = rf"((?:[{WS}]*+[^{WS}]++){{1,64}})"
_SEGMENT = rf"([{WS}]*[^{WS}]+)"


def raw_lines(text: Column) -> Column:
    """Parts of a text between LF or CRLF; a final line end leaves an empty part."""
    return F.split(text, "\r?\n", -1)


def line_count(parts: Column) -> Column:
    """Number of lines: all parts but one trailing empty part."""
    return F.size(parts) - (F.element_at(parts, -1) == "").cast("int")


def lines(text: Column) -> Column:
    """Lines of a text without one trailing empty line."""
    return bind(raw_lines(text), lambda parts: F.slice(parts, 1, line_count(parts)))


def page_of_line(line_no: Column, per_page: int = LINES_PER_PAGE) -> Column:
    """1-based page of a 0-based line number."""
    return (F.floor(line_no / per_page) + 1).cast("int")


def page_count(n_lines: Column, per_page: int = LINES_PER_PAGE) -> Column:
    """Pages needed for a number of lines; an empty text still has one page."""
    return F.greatest(F.ceil(n_lines / per_page), F.lit(1)).cast("int")


def mail_page_of_line(line_no: Column) -> Column:
    """Page of a mail body line: the first page holds fewer lines."""
    first = -(-(MAIL_FIRST - MAIL_FLOOR) // MAIL_STEP)
    later = -(-(MAIL_NEXT - MAIL_FLOOR) // MAIL_STEP)
    return (
        F.when(line_no < first, F.lit(1))
        .otherwise(F.floor((line_no - first) / later) + 2)
        .cast("int")
    )


def words(line: Column) -> Column:
    """Whitespace-separated words of a line."""
    return F.regexp_extract_all(line, F.lit(f"({WORD})"), 1)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use`` as a variable."""
    return F.transform(F.array(value), use)[0]


def _ends(parts: Column, start: Column) -> Column:
    """End offset of every part of a string cut into consecutive parts."""
    return F.aggregate(
        parts,
        F.struct(start.alias("pos"), F.expr("cast(array() as array<int>)").alias("ends")),
        lambda a, part: F.struct(
            (a["pos"] + F.length(part)).alias("pos"),
            F.array_append(a["ends"], a["pos"] + F.length(part)).alias("ends"),
        ),
        lambda a: a["ends"],
    )


def located_words(line: Column) -> Column:
    """Words of a line as array<struct<text, start>>, start = 0-based offset."""
    def in_block(block: Column, end: Column) -> Column:
        return bind(
            F.regexp_extract_all(block, F.lit(_SEGMENT), 1),
            lambda segs: F.zip_with(
                segs, _ends(segs, end - F.length(block)),
                lambda seg, stop: bind(F.ltrim(seg, F.lit(_WS_CHARS)), lambda w: F.struct(
                    w.alias("text"), (stop - F.length(w)).alias("start"))),
            ),
        )

    return bind(
        F.regexp_extract_all(line, F.lit(_BLOCK), 1),
        lambda blocks: F.flatten(F.zip_with(blocks, _ends(blocks, F.lit(0)), in_block)),
    )


def truncate(text: Column, n: int) -> Column:
    """First n characters (code points)."""
    return F.substring(text, 1, n)


def escape_xml(text: Column) -> Column:
    """Text made safe for XML content and attributes."""
    # XML entities; the ampersand goes first.
    for raw, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def escape_pdf(text: Column) -> Column:
    """Text made safe for a PDF literal string."""
    # PDF string escapes; the backslash goes first.
    for raw, escaped in (
        ("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\r", "\\r"), ("\n", "\\n"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def is_heading(line: Column) -> Column:
    """Short numbered line, or short line without a letter that is not upper case."""
    body = F.trim(line)
    return (
        (F.octet_length(body) < 50)
        & (body != "")
        & (body.rlike(r"^[1-6]\.") | ~body.rlike(r"[\p{L}&&[^\p{Lu}]]"))
    )


# an ampersand that begins no known reference
_BAD_REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});)"


def unescape_xml(text: Column) -> Column:
    """Text with its references resolved; null if one is unknown or not closed."""
    def point(digits: Column, base: int) -> Column:
        # the code point as four bytes; there is no character function beyond 255
        number = F.lpad(F.conv(digits, base, 16), 8, "0")
        return F.decode(F.unhex(number), "UTF-32")

    def resolved(piece: Column) -> Column:
        return (F.when(piece.startswith("&#x"), point(F.regexp_extract(piece, "([0-9A-Fa-f]+);", 1), 16))
                .when(piece.startswith("&#"), point(F.regexp_extract(piece, "([0-9]+);", 1), 10))
                .otherwise(piece))

    pieces = F.regexp_extract_all(text, F.lit("(&[^;&]*;|[^&]+)"), 1)
    whole = F.when(text.contains("&#"), F.array_join(F.transform(pieces, resolved), "")).otherwise(text)
    # XML entities; the ampersand goes last.
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
                        ("&amp;", "&")):
        whole = F.replace(whole, F.lit(entity), F.lit(raw))
    return F.when(~text.contains("&"), text).when(~text.rlike(_BAD_REFERENCE), whole)


def text_nodes(markup: Column, pattern: str) -> Column:
    """Trimmed, unescaped matches of a text-node pattern; empty and malformed ones left out."""
    edges = rf"^[{WS}]+|[{WS}]+$"
    found = F.transform(F.regexp_extract_all(markup, F.lit(pattern), 1), lambda t: F.regexp_replace(
        unescape_xml(F.regexp_replace(t, edges, "")), edges, ""))
    return F.filter(found, lambda t: t.isNotNull() & (t != ""))


def markup_text_nodes(html: Column) -> Column:
    """Trimmed text between tags, longer than one byte and not all numeric."""
    return F.filter(text_nodes(html, r">([^<]+)<"),
                    lambda t: (F.octet_length(t) > 1) & ~t.rlike(r"^\p{N}+$"))


def diff_tokens(text: Column) -> Column:
    """Whitespace runs, alphanumeric runs and single other characters."""
    return F.regexp_extract_all(
        text, F.lit(r"((?U)\s+|[\p{IsAlphabetic}\p{N}]+|[^\s\p{IsAlphabetic}\p{N}])"), 1
    )
