"""Mail messages in Spark expressions: headers, MIME parts, transfer encodings, charsets.

A message is read as one character a byte (ISO-8859-1), so that cutting it never
changes a byte; text is decoded by the charset of its part at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.text import bind

# What stands for a missing subject and sender; months.
NO_SUBJECT, NO_SENDER = "(Sans objet)", "Inconnu"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# levels of parts within parts that are opened
DEPTH = 4
_CUT = "\x00\x01"
_LATIN = "ISO-8859-1"


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def header(head: Column, name: str) -> Column:
    """Value of the first header of a name, continuation lines joined; null without one."""
    unfolded = F.regexp_replace(head, r"\r?\n[ \t]+", " ")
    return _filled(F.trim(F.regexp_extract(unfolded, rf"(?idm)^{name}:[ \t]*([^\r\n]*)", 1)))


def parameter(value: Column, name: str) -> Column:
    """Parameter of a header value, with or without quotes; null without one."""
    quoted = F.regexp_extract(value, rf'(?i);\s*{name}="([^"]*)"', 1)
    bare = F.regexp_extract(value, rf'(?i);\s*{name}=([^";\s]+)', 1)
    return F.coalesce(_filled(quoted), _filled(bare))


def _bytes(text: Column) -> Column:
    return F.encode(text, _LATIN)


def quoted_printable(text: Column) -> Column:
    """Characters of quoted-printable text, one a byte."""
    joined = F.regexp_replace(text, r"=[ \t]*\r?\n", "")
    pieces = F.regexp_extract_all(joined, F.lit("(=[0-9A-Fa-f]{2}|[^=]+|=)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(
        p.rlike("^=[0-9A-Fa-f]{2}$"), F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int")))
        .otherwise(p)), "")


def from_base64(text: Column) -> Column:
    """Bytes of base64 text; the text's own bytes if it is none."""
    letters = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    return F.coalesce(F.try_to_binary(letters, F.lit("base64")), _bytes(text))


def in_charset(data: Column, charset: Column) -> Column:
    """Text of bytes: UTF-8 and ASCII, anything else one character a byte."""
    name = F.lower(F.coalesce(charset, F.lit("utf-8")))
    return F.when(name.isin("utf-8", "utf8", "us-ascii", "ascii"),
                  F.make_valid_utf8(data.cast("string"))).otherwise(F.decode(data, _LATIN))


_ENCODED = r"=\?([^?\s]+)\?([bBqQ])\?([^?\s]*)\?="


def words(value: Column) -> Column:
    """Header text with its encoded words decoded; blanks between two of them fall away."""
    near = F.regexp_replace(value, rf"({_ENCODED})\s+(?={_ENCODED})", "$1")
    pieces = F.regexp_extract_all(near, F.lit(rf"({_ENCODED}|(?:(?!{_ENCODED})[\s\S])+)"), 1)

    def plain(piece: Column) -> Column:
        charset, kind, text = (F.regexp_extract(piece, _ENCODED, n) for n in (1, 2, 3))
        data = F.when(F.lower(kind) == "b", from_base64(text)).otherwise(
            _bytes(quoted_printable(F.replace(text, F.lit("_"), F.lit(" ")))))
        return F.when(piece.rlike(f"^{_ENCODED}$"), in_charset(data, charset)).otherwise(
            in_charset(_bytes(piece), F.lit("utf-8")))

    return F.array_join(F.transform(pieces, plain), "")


def iso_date(value: Column) -> Column:
    """Date header as ISO time in the header's zone; empty if it is none."""
    pattern = (r"(?i)(\d{1,2})\s+(" + "|".join(MONTHS) + r")[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})"
               r"(?::(\d{2}))?\s*([+-]\d{4}|GMT|UTC?|Z)?")
    day, month, year, hour, minute, second, zone = (F.regexp_extract(value, pattern, n)
                                                    for n in range(1, 8))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(month))
    offset = F.when(zone.isin("", "-0000"), "").when(
        zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))
    ).otherwise(F.lit("+00:00"))
    text = F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-"),
                    F.lpad(day, 2, "0"), F.lit("T"), F.lpad(hour, 2, "0"), F.lit(":"), minute,
                    F.lit(":"), F.when(second == "", "00").otherwise(second), offset)
    return F.coalesce(F.when(value.rlike(pattern), text), F.lit(""))


def _part(text: Column, inside: Column, alternative: Column) -> Column:
    """Head and body of a message or part, cut at the first blank line."""
    def cut(pieces: Column) -> Column:
        return F.struct(pieces[0].alias("head"), F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))
                        .alias("body"), inside.alias("inside"), alternative.alias("alternative"))

    # a part without headers begins with the blank line
    return bind(F.split(F.regexp_replace(text, r"^(?=\r?\n)", "\n"), r"\r?\n\r?\n", 2), cut)


def _media(head: Column) -> Column:
    kind = F.regexp_extract(F.coalesce(header(head, "Content-Type"), F.lit("")), r"^([^;\s]+)", 1)
    return F.lower(F.coalesce(_filled(kind), F.lit("text/plain")))


def _opened(parts: Column) -> Column:
    """Parts, a multipart one replaced by the parts it holds."""
    def pieces(p: Column) -> Column:
        boundary = parameter(header(p["head"], "Content-Type"), "boundary")
        line = F.concat(F.lit(r"\r?\n--\Q"), boundary, F.lit(r"\E(--)?[ \t]*(?![^\r\n])"))
        marked = F.regexp_replace(F.concat(F.lit("\n"), p["body"]), line, F.lit(_CUT + "$1"))
        within = F.filter(F.slice(F.split(marked, _CUT, -1), 2, 1 << 30), lambda x: ~x.startswith("--"))
        other = p["alternative"] | (_media(p["head"]) == "multipart/alternative")
        return F.transform(within, lambda x: _part(F.regexp_replace(x, r"^\r?\n", ""),
                                                   F.lit(True), other))

    many = lambda p: (_media(p["head"]).startswith("multipart/")
                      & parameter(header(p["head"], "Content-Type"), "boundary").isNotNull())
    return F.flatten(F.transform(parts, lambda p: F.when(many(p), pieces(p)).otherwise(F.array(p))))


def leaves(content: Column) -> Column:
    """All parts that hold content: mime, name, data, charset, attached, inside, alternative."""
    raw = F.decode(content, _LATIN)
    parts = F.array(_part(raw, F.lit(False), F.lit(False)))
    for _ in range(DEPTH):
        parts = _opened(parts)

    def leaf(p: Column) -> Column:
        kind, placed = header(p["head"], "Content-Type"), header(p["head"], "Content-Disposition")
        coding = F.lower(F.coalesce(header(p["head"], "Content-Transfer-Encoding"), F.lit("")))
        data = F.when(coding == "base64", from_base64(p["body"])).when(
            coding == "quoted-printable", _bytes(quoted_printable(p["body"]))).otherwise(
            _bytes(p["body"]))
        return F.struct(
            _media(p["head"]).alias("mime"),
            words(F.coalesce(parameter(placed, "filename"), parameter(kind, "name"))).alias("name"),
            data.alias("data"), parameter(kind, "charset").alias("charset"),
            F.coalesce(F.lower(placed).startswith("attachment"), F.lit(False)).alias("attached"),
            p["inside"].alias("inside"), p["alternative"].alias("alternative"))

    return F.transform(parts, leaf)


def message_parts(content: Column) -> Column:
    """A message and its attachments as an array of structs in the order of the mail.

    The body is the first plain text that is not attached, else the first HTML.
    What stands beside the body as an alternative is no attachment.
    """
    head = _part(F.decode(content, _LATIN), F.lit(False), F.lit(False))["head"]
    none, no_size = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def rows(found: Column) -> Column:
        def first(kind: str) -> Column:
            at = F.filter(F.transform(found, lambda p, i: F.when(
                (p["mime"] == kind) & ~p["attached"], i)), lambda i: i.isNotNull())
            return F.get(at, F.lit(0))

        def with_body(places: Column) -> Column:
            plain, html = places[0], places[1]
            body = F.get(found, F.coalesce(plain, html))
            text = in_charset(body["data"], body["charset"])
            text = F.when(plain.isNotNull(), text).otherwise(F.replace(F.replace(
                text, F.lit("<br>"), F.lit("\n")), F.lit("</p>"), F.lit("\n\n")))
            message = F.struct(
                F.lit("message").alias("part"), none.alias("name"),
                F.coalesce(text, F.lit("")).alias("body"),
                F.coalesce(words(header(head, "Subject")), F.lit(NO_SUBJECT)).alias("subject"),
                F.coalesce(words(header(head, "From")), F.lit(NO_SENDER)).alias("sender"),
                F.coalesce(words(header(head, "To")), F.lit("")).alias("recipient"),
                iso_date(F.coalesce(header(head, "Date"), F.lit(""))).alias("date"),
                none.alias("mime"), no_size.alias("size"), none.alias("reason"))
            others = F.filter(found, lambda p, i: p["inside"] & ~p["alternative"] & ~F.coalesce(
                i == F.coalesce(plain, html), F.lit(False)))
            attached = F.transform(others, lambda p, i: F.struct(
                F.lit("attachment").alias("part"), F.concat(F.lit("att_"), i + 1).alias("name"),
                none.alias("body"),
                F.coalesce(_filled(p["name"]), F.concat(F.lit("attachment_"), i + 1))
                .alias("subject"), none.alias("sender"), none.alias("recipient"),
                none.alias("date"), p["mime"].alias("mime"),
                F.octet_length(p["data"]).cast("bigint").alias("size"), none.alias("reason")))
            return F.concat(F.array(message), attached)

        return bind(F.array(first("text/plain"), first("text/html")), with_body)

    return bind(leaves(content), rows)
