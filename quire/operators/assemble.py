"""Assembly of documents, watermark layout, signature ledger, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as X
from quire.plans import skew
from quire.plans.durable import settled

PAGE_BLOCK = 4096
SOURCE_BLOCK = 1024


def merge_sources(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of the sources (build_id, seq, doc_id) in order, numbered through.

    Offsets come from running page counts of the sources; no page is sorted.
    """
    counts = pages.groupBy("doc_id").agg(F.max("page_number").alias("_n"))
    placed = skew.chunked_running(
        settled(sources.join(counts, "doc_id")), ["build_id"], ["seq"], F.floor(F.col("seq") / SOURCE_BLOCK),
        sums={"_upto": F.col("_n")})
    return placed.join(pages, "doc_id").select(
        "build_id", "doc_id",
        (F.col("_upto") - F.col("_n") + F.col("page_number")).alias("merged_no"),
        F.col("page_number").alias("source_page"), "width", "height", "rotation")


def apply_actions(merged: DataFrame, actions: DataFrame) -> DataFrame:
    """Delete and rotate pages (build_id, action, page_number, degrees), then renumber.

    Rotations add up; pages without an action are kept; blank pages are ignored.
    """
    target = F.col("page_number").alias("merged_no")
    deleted = actions.where(F.col("action") == "delete").select("build_id", target)
    turns = (
        actions.where(F.col("action").isin("rotate", "keep"))
        .groupBy("build_id", target)
        .agg(F.sum(F.coalesce("degrees", F.lit(0))).alias("_turn"))
    )
    kept = settled(
        merged.join(turns, ["build_id", "merged_no"], "left")
        .join(deleted, ["build_id", "merged_no"], "left_anti")
    )
    numbered = skew.chunked_running(
        kept, ["build_id"], ["merged_no"], F.floor(F.col("merged_no") / PAGE_BLOCK),
        sums={"page_number": F.lit(1)})
    rotation = F.coalesce("rotation", F.lit(0))
    turned = F.when(F.col("_turn").isNull(), rotation).otherwise(
        F.pmod(rotation + F.col("_turn"), F.lit(360)))
    quarter = F.col("rotation").isin(90, 270)
    return numbered.withColumn("rotation", turned.cast("int")).withColumns({
        "shown_width": F.when(quarter, F.col("height")).otherwise(F.col("width")),
        "shown_height": F.when(quarter, F.col("width")).otherwise(F.col("height")),
    }).drop("_turn")


# Watermark limits and defaults.
WM_OPACITY_MIN, WM_OPACITY_MAX, WM_OPACITY_DEFAULT = 0.05, 1.0, 0.2
WM_ANGLE_MIN, WM_ANGLE_DEFAULT = 0.1, 45.0
WM_FONT_MIN, WM_FONT_SHARE, WM_FONT_FLOOR = 10.0, 0.08, 28.0
WM_HALF_WIDTH, WM_HALF_HEIGHT = 0.28, 0.35
WM_DEFAULT_RGB = (0.85, 0.15, 0.15)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def hex_rgb(color: Column) -> list[Column]:
    """Red, green, blue as shares of 255; the default where the color is no hex triple."""
    clean = F.regexp_replace(color, "^#+", "")
    ok = clean.rlike("^[0-9A-Fa-f]{6}$")
    return [F.when(ok, F.conv(F.substring(clean, 1 + 2 * i, 2), 16, 10).cast("int") / 255.0)
            .otherwise(F.lit(d)) for i, d in enumerate(WM_DEFAULT_RGB)]


def watermark_layout(pages: DataFrame, text: Column, opacity: Column, font_size: Column,
                     rotation: Column, color: Column) -> DataFrame:
    """Placement of a watermark on every page; a blank text marks none."""
    angle = F.when(_finite(rotation), rotation).otherwise(F.lit(WM_ANGLE_DEFAULT))
    angle = F.radians(F.when(F.abs(angle) > WM_ANGLE_MIN, angle).otherwise(F.lit(WM_ANGLE_DEFAULT)))
    size = F.when(font_size >= WM_FONT_MIN, font_size).otherwise(F.greatest(
        F.least("width", "height") * WM_FONT_SHARE, F.lit(WM_FONT_FLOOR)))
    shown = X.escape_pdf(text)
    red, green, blue = hex_rgb(color)
    return pages.where(F.trim(text) != "").withColumns({
        "wm_text": shown,
        "wm_opacity": F.when(_finite(opacity), F.least(
            F.greatest(opacity, F.lit(WM_OPACITY_MIN)), F.lit(WM_OPACITY_MAX))
        ).otherwise(F.lit(WM_OPACITY_DEFAULT)),
        "wm_cos": F.cos(angle), "wm_sin": F.sin(angle),
        "wm_font_size": size, "wm_x": F.col("width") / 2.0, "wm_y": F.col("height") / 2.0,
        "wm_half_width": F.octet_length(shown) * size * WM_HALF_WIDTH,
        "wm_half_height": size * WM_HALF_HEIGHT,
        "wm_red": red, "wm_green": green, "wm_blue": blue,
    })


# Smallest stamp, default reason and location, date formats.
STAMP_MIN_WIDTH, STAMP_MIN_HEIGHT = 120.0, 60.0
SIGN_REASON, SIGN_LOCATION = "Approbation légale", "Paris, FR"
SIGN_TIME_FORMAT, SIGN_PDF_FORMAT = "dd/MM/yyyy HH:mm:ss 'UTC'", "'D:'yyyyMMddHHmmss'Z'"


def manifest(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


def signature_ledger(requests: DataFrame, digests: DataFrame, pages: DataFrame,
                     at: Column) -> DataFrame:
    """Ledger rows of signature requests on existing pages, at a given time."""
    joined = requests.join(digests.select("doc_id", "sha256"), "doc_id").join(
        pages.select("doc_id", "page_number", F.col("height").alias("_page_height")),
        ["doc_id", "page_number"])
    stamp_y = F.greatest(F.col("_page_height") - (F.col("y") + F.col("height")), F.lit(0.0))
    return joined.select(
        "doc_id", "page_number", "signer_name", F.col("x").alias("stamp_x"),
        stamp_y.alias("stamp_y"), F.greatest("width", F.lit(STAMP_MIN_WIDTH)).alias("stamp_width"),
        F.greatest("height", F.lit(STAMP_MIN_HEIGHT)).alias("stamp_height"),
        F.coalesce("reason", F.lit(SIGN_REASON)).alias("reason"),
        F.coalesce("location", F.lit(SIGN_LOCATION)).alias("location"),
        "sha256", F.substring("sha256", 1, 16).alias("short_hash"),
        F.date_format(at, SIGN_TIME_FORMAT).alias("timestamp_utc"),
        F.date_format(at, SIGN_PDF_FORMAT).alias("pdf_date"))


def verify(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded digests against recomputed ones: ok, changed, missing or new."""
    a = recorded.select("doc_id", F.col("sha256").alias("recorded"))
    b = current.select("doc_id", F.col("sha256").alias("current"))
    status = (
        F.when(F.col("recorded").isNull(), "new").when(F.col("current").isNull(), "missing")
        .when(F.col("recorded") == F.col("current"), "ok").otherwise("changed"))
    return a.join(b, "doc_id", "full").withColumn("status", status)
