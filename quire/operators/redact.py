"""Redaction orders as record transformations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as X
from quire.operators import pii, textlayer
from quire.plans.durable import settled

DEFAULT_LABEL = "CONFIDENTIEL"


#: Orders come from texts, which are much larger than the tables' files: by the size of those Spark would
#: send all of them to every executor.
SHUFFLED = "merge"


def label() -> Column:
    return F.coalesce("overlay_text", "reason", F.lit(DEFAULT_LABEL))


def place(orders: DataFrame, pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_number"),
          ) -> DataFrame:
    """Orders of existing pages in bottom-left coordinates with their label."""
    heights = pages.select(*keys, F.col("height").alias("_page_height"))
    y = F.greatest(F.col("_page_height") - (F.col("y") + F.col("height")), F.lit(0.0))
    return (
        orders.join(heights.hint(SHUFFLED), list(keys))
        .withColumns({
            "pdf_y": y,
            "label": label(),
            "label_shown": F.col("height") >= 10.0,
            "label_x": F.col("x") + 4.0,
            "label_y": y + F.col("height") / 2.0 - 3.0,
        })
        .drop("_page_height")
    )


def _on_lines(orders: DataFrame, per_page: int, *columns: Column) -> DataFrame:
    """doc_id, line_no and ``columns`` of every text line whose word boxes an order overlaps."""
    top0 = X.PAGE_HEIGHT - X.FIRST_BASELINE - X.FONT_SIZE
    # a line [top, top + font) overlaps (y, y + h) strictly
    first = F.floor((F.col("y") - top0 - X.FONT_SIZE) / X.LINE_PITCH) + 1
    last = F.ceil((F.col("y") + F.col("height") - top0) / X.LINE_PITCH) - 1
    lo, hi = F.greatest(first, F.lit(0)), F.least(last, F.lit(per_page - 1))
    return (
        orders.where(lo <= hi)
        .withColumn("_on_page", F.explode(F.sequence(lo, hi)))
        .select("doc_id", ((F.col("page_number") - 1) * per_page + F.col("_on_page"))
                .cast("int").alias("line_no"), *columns)
    )


def _edges() -> list[Column]:
    return [label().alias("label"), F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1")]


def covered_lines(orders: DataFrame, per_page: int = X.LINES_PER_PAGE) -> DataFrame:
    """Orders per text line whose word boxes they overlap.

    Lines lie on a fixed pitch, so the overlap in y is a number range and the
    later join is an equi join on (doc_id, line_no).
    """
    order = F.struct("order_id", *_edges()).alias("order")
    return _on_lines(orders, per_page, order).groupBy("doc_id", "line_no").agg(
        F.array_sort(F.collect_set("order")).alias("orders"))


def covered_documents(orders: DataFrame, per_page: int = X.LINES_PER_PAGE) -> DataFrame:
    """The orders of ``covered_lines`` as one map by line number for each document.

    Both groupings need one shuffle, by document; ids that are hexadecimal digits are sent as half
    as many bytes.
    """
    packed = F.when(F.col("order_id").rlike("^(?:[0-9a-f]{2})+\\z"), F.unhex("order_id"))
    found = _on_lines(orders, per_page, F.struct(
        packed.alias("packed"), F.when(packed.isNull(), F.col("order_id")).alias("order_id"),
        *_edges()).alias("order"))
    plain = F.transform(F.collect_set("order"), lambda o: F.struct(
        F.coalesce(F.lower(F.hex(o["packed"])), o["order_id"]).alias("order_id"),
        *[o[c].alias(c) for c in ("label", "x0", "x1")]))
    return (
        found.repartition("doc_id").groupBy("doc_id", "line_no")
        .agg(F.array_sort(plain).alias("orders"))
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("line_no", "orders"))).alias("_by_line"))
    )


def _redacted(line: Column, orders: Column) -> Column:
    """A line with every overlapped word replaced by the label of the first order."""
    def hit(word: Column) -> Column:
        x0 = X.LEFT_MARGIN + X.CHAR_WIDTH * word["start"]
        x1 = x0 + X.CHAR_WIDTH * F.length(word["text"])
        first = F.get(F.filter(orders, lambda o: (o["x0"] < x1) & (o["x1"] > x0)), F.lit(0))
        return F.coalesce(first["label"], word["text"])

    return F.when(orders.isNotNull(), F.array_join(F.transform(X.located_words(line), hit), " ")
                  ).otherwise(line)


def redact_lines(lines: DataFrame, orders: DataFrame, per_page: int = X.LINES_PER_PAGE) -> DataFrame:
    """Lines of a table with the words under an order removed; others pass through unchanged."""
    found = covered_lines(orders, per_page).hint(SHUFFLED)
    return lines.join(found, ["doc_id", "line_no"], "left").select(
        *[F.col(c) for c in lines.columns if c != "line"],
        _redacted(F.col("line"), F.col("orders")).alias("line"),
        F.col("orders").isNotNull().alias("is_redacted")).select(*lines.columns, "is_redacted")


def redact_texts(docs: DataFrame, orders: DataFrame, text: str = "text",
                 per_page: int = X.LINES_PER_PAGE) -> DataFrame:
    """Lines of documents with the words under an order removed: line_no, line, is_redacted.

    The orders of a document meet its row once; its lines are cut and redacted
    there, so no line takes part in a join.
    """
    found = covered_documents(orders, per_page)
    kept = [c for c in docs.columns if c != text]
    cells = F.transform(X.lines(F.col(text)), lambda line, no: F.struct(
        line.alias("line"), F.try_element_at("_by_line", no).alias("orders")))
    return (
        docs.join(found.hint(SHUFFLED), "doc_id", "left").select(*kept, F.posexplode(cells).alias("line_no", "_c"))
        .select(*kept, "line_no", _redacted(F.col("_c.line"), F.col("_c.orders")).alias("line"),
                F.col("_c.orders").isNotNull().alias("is_redacted"))
    )


def rebuild_text(lines: DataFrame) -> DataFrame:
    """Texts from lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text"))


def remaining_hits(redacted: DataFrame, hits: DataFrame) -> DataFrame:
    """Original hits found again in redacted lines (doc_id, line_no, line); none is expected.

    A label next to kept digits may by chance read as a new number; that is no leak, so
    the new hits are matched with the original ones. Few lines hold anything to scan after the
    redaction, so no line takes part in a join: what is found is written out and meets the hits.
    """
    again = settled(pii.scan_text(redacted.select("doc_id", F.col("line_no").alias("orig_line"),
                                                  F.col("line").alias("text"))))
    known = hits.select("doc_id", F.col("line_no").alias("orig_line"), "category", "matched_text")
    found = known.join(again.select(known.columns).distinct(), known.columns, "left_semi")
    return again.join(found.distinct(), known.columns, "left_semi")
