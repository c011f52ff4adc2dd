"""Content-addressed catalog: ids, duplicates, routing, retention, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import names as N

# Default page box and retention.
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
RETENTION_SECONDS = 900

# Caps per request.
CAPS = {
    "page": (1, 50_000), "annotations": (0, 10_000), "redactions": (0, 2_000),
    "sources": (1, 50), "actions": (0, 5_000), "query_bytes": (0, 500), "form_values": (0, 1_000),
}


def identify(files: DataFrame, content: str = "content") -> DataFrame:
    """Content id, cleaned name and extension of arriving files (filename, arrival)."""
    clean = N.sanitize_filename(F.col("filename"))
    return files.withColumns({
        "content_id": N.content_id(F.col(content)), "clean_name": clean,
        "ext": N.extension(clean, "pdf"),
    })


def catalog(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row per (content, extension): first stored copy, latest name, copies.

    A partial aggregate: a text copied into a third of all rows is reduced on
    every task before it is shuffled.
    """
    found = identify(files, content)
    order = F.struct("arrival", key)
    return found.groupBy("content_id", "ext").agg(
        F.min_by(key, order).alias("stored_key"),
        F.max_by("clean_name", order).alias("filename"),
        F.count("*").alias("copies"),
        F.min(F.octet_length(content)).cast("bigint").alias("n_bytes"),
        F.min(order).alias("first_seen"), F.max(order).alias("last_seen"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """One catalog of the catalogs of several arrivals."""
    return parts.groupBy("content_id", "ext").agg(
        F.min_by("stored_key", "first_seen").alias("stored_key"),
        F.max_by("filename", "last_seen").alias("filename"), F.sum("copies").alias("copies"),
        F.min("n_bytes").alias("n_bytes"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))


def route(files: DataFrame) -> DataFrame:
    """Family, media flags and MIME types by extension; unknown ones are text."""
    dim = N.format_dimension(files.sparkSession)  # some sixty fixed rows
    octets = F.lit("application/octet-stream")
    return (
        files.withColumn("ext", N.routing_extension(F.col("filename")))
        .join(F.broadcast(dim), "ext", "left")
        .withColumns({
            "family": F.coalesce("family", F.lit("text")),
            "is_video": F.coalesce("is_video", F.lit(False)),
            "is_audio": F.coalesce("is_audio", F.lit(False)),
            "mime_read": F.coalesce("mime_read", octets),
            "mime_metadata": F.coalesce("mime_metadata", F.lit("application/pdf")),
            "mime_download": F.coalesce("mime_download", octets),
        })
    )


def file_stem(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def lookup(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored files (name) of the wanted ids (doc_id), without sidecars and renditions."""
    wanted = ids.where(N.is_doc_id(F.col("doc_id"))).select("doc_id")
    name = F.col("name")
    return (
        files.where(~name.rlike(r"\.(meta|xfdf|connector)$") & ~name.contains(".rendition."))
        .withColumn("doc_id", file_stem(name))
        .join(wanted, "doc_id", "left_semi")
    )


def expired(files: DataFrame, now: Column, ttl: int = RETENTION_SECONDS) -> DataFrame:
    """Files to purge (name, mtime): whole documents by their .meta age, and leftovers."""
    age = F.floor(F.col("now_s") - F.col("mtime_s"))
    aged = (
        files.withColumns({"now_s": F.unix_micros(now) / 1e6,
                           "mtime_s": F.unix_micros("mtime") / 1e6})
        .withColumn("_old", age > ttl).drop("now_s", "mtime_s")
        .withColumn("_stem", file_stem(F.col("name")))
    )
    name = F.col("name")
    docs = aged.where(name.endswith(".meta") & F.col("_old")).select(
        F.regexp_replace(name, r"\.meta$", "").alias("_stem"))
    docs = docs.where(N.is_doc_id(F.col("_stem"))).distinct().withColumn("_doc", F.lit(True))
    leftover = F.col("_old") & (name.contains(".rendition.") | name.endswith(".tmp"))
    return (
        aged.join(docs, "_stem", "left").where(F.col("_doc") | leftover)
        .drop("_doc", "_old").withColumnRenamed("_stem", "doc_id")
    )


def survivors(files: DataFrame, purged: DataFrame) -> DataFrame:
    return files.join(purged.select("name"), "name", "left_anti")


def cascade(child: DataFrame, purged_docs: DataFrame) -> DataFrame:
    """Rows of a child table whose document is kept."""
    return child.join(purged_docs.select("doc_id"), "doc_id", "left_anti")


def page_geometry(pages: DataFrame) -> DataFrame:
    """Width and height from CropBox, else MediaBox, else A4; swapped on a quarter turn."""
    box = F.coalesce("crop_box", "media_box")
    usable = F.size(box) == 4

    def extent(low: int, default: float) -> Column:
        a, b = F.get(box, F.lit(low)), F.get(box, F.lit(low + 2))
        return F.when(usable, F.abs(F.coalesce(b, F.lit(default)) - F.coalesce(a, F.lit(0.0)))
                      ).otherwise(F.lit(default))

    w, h = extent(0, PAGE_WIDTH), extent(1, PAGE_HEIGHT)
    rotation = F.coalesce("rotate", F.lit(0))
    turned = rotation.isin(90, 270)
    return pages.withColumns({
        "width": F.when(turned, h).otherwise(w), "height": F.when(turned, w).otherwise(h),
        "rotation": rotation,
    }).drop("crop_box", "media_box", "rotate")


def roll_up(pages: DataFrame) -> DataFrame:
    """Documents with page_count and their pages in order."""
    page = F.struct("page_number", "width", "height", "rotation")
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.array_sort(F.collect_list(page)).alias("pages"))


def caps_violations(requests: DataFrame) -> DataFrame:
    """Requests (request_id, kind, amount) outside their cap, with the broken rule."""
    kind, amount = F.col("kind"), F.col("amount")
    low, high = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for name, (lo, hi) in CAPS.items():
        low = F.when(kind == name, lo).otherwise(low)
        high = F.when(kind == name, hi).otherwise(high)
    reason = F.when(amount < low, F.concat(kind, F.lit("_below_"), low)).when(
        amount > high, F.concat(kind, F.lit("_above_"), high))
    return requests.withColumn("reason", reason).where("reason is not null")


def profile(routed: DataFrame) -> DataFrame:
    """Documents, bytes and pages per family and extension, with subtotals."""
    return routed.rollup("family", "ext").agg(
        F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"),
        F.sum("page_count").alias("pages"))
