"""Ids, file names, extensions, formats, URLs and permissions as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import text as X

# Extension families.
FAMILIES = {
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "webp", "tiff", "tif", "bmp", "gif"],
    "video": ["mp4", "webm", "ogv", "ogg", "mov", "avi", "mkv", "m4v", "3gp"],
    "audio": ["mp3", "wav", "flac", "aac", "m4a"],
    "email": ["eml", "msg"],
    "office": ["docx", "doc", "xlsx", "xls", "pptx", "ppt", "odt", "ods", "odp", "odg",
               "rtf", "vsd", "vsdx"],
    "cad": ["dxf", "dwg"],
    "dicom": ["dcm", "dicom"],
    "apple": ["heic", "heif", "icns", "dng", "pict", "pct"],
    "markdown": ["md", "markdown"],
    "text": ["svg", "txt", "csv", "tsv", "log", "json", "xml", "yaml", "yml"],
}

# MIME types by context (file read, metadata, download).
MIME_READ = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "webp": "image/webp",
}
MIME_METADATA = {
    "mp4": "video/mp4", "m4v": "video/mp4", "webm": "video/webm", "ogv": "video/ogg",
    "ogg": "video/ogg", "mov": "video/quicktime", "avi": "video/x-msvideo",
    "mkv": "video/x-matroska", "mp3": "audio/mpeg", "wav": "audio/wav",
    "flac": "audio/flac", "aac": "audio/aac", "m4a": "audio/mp4",
}
MIME_DOWNLOAD = {
    "pdf": "application/pdf", "mp4": "video/mp4", "m4v": "video/mp4",
    "webm": "video/webm", "ogv": "video/ogg", "ogg": "video/ogg",
    "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska",
    "mp3": "audio/mpeg", "wav": "audio/wav", "dxf": "application/dxf",
    "dwg": "image/vnd.dwg", "dcm": "application/dicom", "dicom": "application/dicom",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp",
}

OFFICE_FAST_LIMIT = 5 * 1024 * 1024
UPLOAD_LIMIT = 100 * 1024 * 1024


def content_id(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def basename(path: Column) -> Column:
    """Last path component; null where there is none (empty, '/', '..')."""
    trimmed = F.regexp_replace(path, r"(/+\.?)+$", "")
    last = F.regexp_extract(trimmed, r"([^/]*)$", 1)
    return F.when(~last.isin("", ".", ".."), last)


def sanitize_filename(name: Column) -> Column:
    """Base name without separators and control characters, at most 255 bytes."""
    base = F.coalesce(basename(name), F.lit("document.pdf"))
    clean = F.regexp_replace(base, r"[\\/\x00-\x1F\x7F\x{80}-\x{9F}]", "")
    clean = F.when(clean.isin("", ".", ".."), F.lit("document.pdf")).otherwise(clean)
    short = F.concat(
        F.lit("doc_"), F.substring(clean, 1, 32), F.lit("."), extension(clean, "pdf")
    )
    return F.when(F.octet_length(clean) > 255, short).otherwise(clean)


def is_doc_id(doc_id: Column) -> Column:
    return doc_id.rlike("^[A-Za-z0-9_-]{1,64}$")


def extension(name: Column, default: str = "") -> Column:
    """Last suffix of a base name; a leading dot starts no suffix."""
    found = F.regexp_extract(name, r"[^/]\.([^./]*)$", 1)
    has_one = name.rlike(r"[^/]\.[^./]*$")
    return F.when(has_one, found).otherwise(F.lit(default))


def routing_extension(name: Column) -> Column:
    return F.lower(extension(name, ""))


def format_dimension(spark: SparkSession) -> DataFrame:
    """One row per known extension: family, media flags and the three MIME types."""
    rows = [
        (ext, family, family == "video", family == "audio",
         MIME_READ.get(ext, "application/octet-stream"),
         MIME_METADATA.get(ext, {"video": "video/mp4", "audio": "audio/mpeg",
                                 "image": f"image/{ext}"}.get(family, "application/pdf")),
         MIME_DOWNLOAD.get(ext, "application/octet-stream"))
        for family, exts in FAMILIES.items() for ext in exts
    ]
    return spark.createDataFrame(
        rows,
        "ext string, family string, is_video boolean, is_audio boolean, "
        "mime_read string, mime_metadata string, mime_download string",
    )


def office_engine(ext: Column, size: Column, complex_wrap: Column) -> Column:
    """Conversion engine an office file would be routed to."""
    fast = ext.isin("docx", "xlsx", "pptx") & (size < OFFICE_FAST_LIMIT) & ~(
        (ext == "docx") & complex_wrap
    )
    return F.when(fast, "fast").otherwise("high_fidelity")


def has_complex_wrapping(document_xml: Column) -> Column:
    return document_xml.rlike("wrapTight|wrapPolygon|wrapSquare|wrapThrough")


def url_filename(url: Column) -> Column:
    """Name taken from the part after the last '?' and then the last '/'."""
    after_query = F.element_at(F.split(url, r"\?", -1), -1)
    last = F.element_at(F.split(after_query, "/", -1), -1)
    return F.when(last.contains("."), last).otherwise(F.lit("remote_document.pdf"))


def disposition_filename(header: Column) -> Column:
    """Name in a Content-Disposition header; null when there is none."""
    part = F.element_at(F.split(F.get(F.split(header, "filename=", -1), F.lit(1)), ";", -1), 1)
    name = F.regexp_replace(F.trim(part), r"""["'\r\n]""", "")
    return F.when(name != "", name)


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) URL; null when the URL has another scheme."""
    host = F.lower(F.regexp_extract(
        url, r"^(?i:https?)://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)(?::[0-9]*)?(?:[/?#]|$)", 1
    ))
    return F.when(host != "", host)


def _number(part: Column) -> Column:
    """Value of a decimal, octal (leading 0) or hexadecimal (0x) number; null if it is none."""
    base = lambda digits, n: F.conv(digits, n, 10).try_cast("bigint")
    return (
        F.when(part.rlike("^0x[0-9a-f]{0,12}$"), F.coalesce(base(F.substring(part, 3, 12), 16),
                                                           F.lit(0)))
        .when(part.rlike("^0[0-7]{1,15}$"), base(part, 8))
        .when(part.rlike("^(0|[1-9][0-9]{0,11})$"), part.try_cast("bigint")))


def ipv4_value(host: Column) -> Column:
    """Number of an IPv4 address in any spelling a URL may use; null if it is none.

    One to four parts, each decimal, octal or hexadecimal; the last one fills
    the remaining bytes.
    """
    def value(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        head = F.slice(parts, 1, F.size(parts) - 1)
        room = F.element_at(F.array(*[F.lit(256 ** k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
        fits = ((n <= 4) & (last < room)
                & F.forall(head, lambda p: F.coalesce(p < 256, F.lit(False))))
        lead = F.aggregate(head, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
        return F.when(fits, lead * room + last)

    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1)
    return X.bind(F.transform(labels, _number), value)


def is_restricted_ipv4(value: Column) -> Column:
    """Whether an IPv4 number is private, local, reserved or multicast."""
    def restricted(v: Column) -> Column:
        a, b = F.floor(v / 2 ** 24), F.floor(v / 2 ** 16) % 256
        return (a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
                | ((a == 192) & (b == 168)) | (a >= 224))

    return X.bind(value, restricted)


def ipv6_groups(host: Column) -> Column:
    """Eight 16-bit numbers of a bracketed IPv6 literal; null if it is none."""
    inner = F.regexp_extract(host, r"^\[([0-9a-f:.]+)\]$", 1)
    dotted = r"(?:^|:)([0-9]{1,3}(?:\.[0-9]{1,3}){3})$"

    def with_hex_tail(text: Column) -> Column:
        four = ipv4_value(F.regexp_extract(text, dotted, 1))
        return F.when(~text.rlike(dotted), text).otherwise(X.bind(four, lambda v: F.concat(
            F.regexp_replace(text, r"[0-9.]+$", ""), F.lower(F.hex(F.floor(v / 65536))),
            F.lit(":"), F.lower(F.hex(v % 65536)))))

    def groups_of(text: Column) -> Column:
        return F.filter(F.split(text, ":", -1), lambda g: g != "")

    def whole(halves: Column) -> Column:
        def filled(pair: Column) -> Column:
            zeros = 8 - F.size(pair[0]) - F.size(pair[1])
            return F.when(zeros >= 1, F.concat(
                pair[0], F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), pair[1]))

        return F.when(F.size(halves) == 1, groups_of(halves[0])).when(
            F.size(halves) == 2, X.bind(F.transform(halves, groups_of), filled))

    # a single colon stands only between two groups
    good = (lambda g: (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")))
    return X.bind(with_hex_tail(inner), lambda t: F.when(
        ~t.rlike("^:(?!:)|(?<!:):$|:::"), X.bind(X.bind(F.split(t, "::", -1), whole), lambda g: F.when(
            good(g), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int"))))))


def is_restricted_ipv6(groups: Column) -> Column:
    """Loopback, unspecified, multicast, unique local, link-local and embedded IPv4."""
    def restricted(g: Column) -> Column:
        embedded = F.forall(F.slice(g, 1, 5), lambda x: x == 0) & g[5].isin(0, 0xFFFF)
        return F.when(embedded, is_restricted_ipv4(g[6].cast("bigint") * 65536 + g[7])).otherwise(
            (F.floor(g[0] / 256) == 0xFF) | (F.floor(g[0] / 512) == 0xFC >> 1)
            | (F.floor(g[0] / 64) == 0xFE80 >> 6))

    return X.bind(groups, restricted)


def url_is_safe(url: Column) -> Column:
    """Scheme http(s), a host, no local name, no restricted literal address.

    A host whose last label is a number is an IPv4 address, in whatever
    spelling, or no host at all. Names are not resolved.
    """
    def safe(host: Column) -> Column:
        local = host.rlike(r"(^|\.)localhost\.?$|\.(local|internal)\.?$")
        numeric = host.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
        return F.coalesce(
            F.when(local, False)
            .when(host.startswith("["), ~is_restricted_ipv6(ipv6_groups(host)))
            .when(numeric, ~is_restricted_ipv4(ipv4_value(host)))
            .when(host.isNotNull(), True),
            F.lit(False))

    return X.bind(url_host(url), safe)


def is_traversal(path: Column) -> Column:
    """Relative path that would leave its root."""
    return path.contains("..") | path.contains("\0")


def strip_root(path: Column) -> Column:
    return F.regexp_replace(path, r"^[/\\]+", "")


def may_download(permissions: Column) -> Column:
    """Download permission from a comma list; no list means allowed."""
    denied = permissions.contains("no-download") | (
        permissions.contains("read-only") & ~permissions.contains("download")
    )
    return ~F.coalesce(denied, F.lit(False))


def redacted_name(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".pdf"), F.concat(F.lit("redacted_"), name)).otherwise(
        F.concat(F.lit("redacted_"), name, F.lit(".pdf"))
    )


def watermarked_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.pdf$", ""), F.lit("_filigrane.pdf"))


def converted_name(name: Column, watermarked: Column) -> Column:
    """Name of a converted file: its stem, marked when a watermark was drawn."""
    base = basename(name)
    stem = F.coalesce(F.regexp_replace(base, r"([^/])\.[^.]*$", "$1"), F.lit("document"))
    return F.concat(stem, F.when(watermarked, "_converted.pdf").otherwise(F.lit(".pdf")))
