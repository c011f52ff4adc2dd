"""Text layer: documents to lines, pages and positioned word spans.

Everything but the two sequential paginations runs row by row inside the JVM:
a document is one input row, so lines and spans are generated without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as X
from quire.plans.grouped import Arrays, map_sorted_runs


def lines(docs: DataFrame, text: str = "text", per_page: int = X.LINES_PER_PAGE) -> DataFrame:
    """One row per line: line_no (0-based), line, page_number, page_count."""
    kept = [c for c in docs.columns if c != text]
    # the outer form keeps the optimizer from splitting every text a second time
    # for an inferred "not empty" filter; the range test drops what it adds
    return (
        docs.select(*kept, X.raw_lines(F.col(text)).alias("_lines"))
        .select(*kept, X.line_count(F.col("_lines")).alias("_n"),
                F.posexplode_outer("_lines").alias("line_no", "line"))
        .where(F.col("line_no") < F.coalesce("_n", F.lit(0)))
        .select(
            *kept, "line_no", "line",
            X.page_of_line(F.col("line_no"), per_page).alias("page_number"),
            X.page_count(F.col("_n"), per_page).alias("page_count"),
        )
    )


def pages(docs: DataFrame, text: str = "text", per_page: int = X.LINES_PER_PAGE) -> DataFrame:
    """One row per page, also for empty texts, with the number of its lines."""
    kept = [c for c in docs.columns if c != text]
    n, p = F.col("_n"), F.col("page_number")
    return (
        docs.select(*kept, X.raw_lines(F.col(text)).alias("_lines"))
        .select(*kept, X.line_count(F.col("_lines")).alias("_n"))
        .select(*kept, "_n", F.explode(F.sequence(F.lit(1), X.page_count(n, per_page)))
                .alias("page_number"))
        .select(
            *kept, "page_number",
            X.page_count(n, per_page).alias("page_count"),
            F.greatest(F.least(F.lit(per_page), n - (p - 1) * per_page), F.lit(0))
            .cast("int").alias("n_lines"),
            F.lit(X.PAGE_WIDTH).alias("width"), F.lit(X.PAGE_HEIGHT).alias("height"),
            F.lit(0).alias("rotation"),
        )
    )


def layout(df: DataFrame, per_page: int = X.LINES_PER_PAGE, max_cols: int | None = None) -> DataFrame:
    """Baseline position of every line, its drawn text and the page footer."""
    on_page = F.col("line_no") % per_page
    shown = F.col("line") if max_cols is None else X.truncate(F.col("line"), max_cols)
    return df.withColumns({
        "x": F.lit(X.LEFT_MARGIN),
        "y": X.FIRST_BASELINE - X.LINE_PITCH * on_page,
        "shown": shown,
        "footer": F.format_string("Page %d / %d", F.col("page_number"), F.col("page_count")),
    })


def mail_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines of mail bodies with the page of a shorter first page."""
    return lines(docs, text).withColumn(
        "page_number", X.mail_page_of_line(F.col("line_no"))
    ).drop("page_count")


def span_top(line_no: Column, per_page: int = X.LINES_PER_PAGE) -> Column:
    """Top-left y of the words of a line."""
    return (X.PAGE_HEIGHT - X.FIRST_BASELINE - X.FONT_SIZE) + X.LINE_PITCH * (line_no % per_page)


def span_boxes(located: Column, line_no: Column) -> Column:
    """Located words as array<struct<text, x, y, width, height, font_size>>."""
    return F.transform(located, lambda w: F.struct(
        w["text"].alias("text"),
        (X.LEFT_MARGIN + X.CHAR_WIDTH * w["start"]).alias("x"),
        span_top(line_no).alias("y"),
        (X.CHAR_WIDTH * F.length(w["text"])).alias("width"),
        F.lit(X.FONT_SIZE).alias("height"),
        F.lit(X.FONT_SIZE).alias("font_size"),
    ))


def spans(df: DataFrame) -> DataFrame:
    """Positioned word spans of lines (span_idx is 0-based inside the line)."""
    kept = [c for c in df.columns if c != "line"]
    return (
        df.select(*kept, X.located_words(F.col("line")).alias("_ws"))
        .select(*kept, F.posexplode("_ws").alias("span_idx", "_w"))
        .select(
            *kept, "span_idx", F.col("_w.text").alias("text"),
            (X.LEFT_MARGIN + X.CHAR_WIDTH * F.col("_w.start")).alias("x"),
            span_top(F.col("line_no")).alias("y"),
            (X.CHAR_WIDTH * F.length("_w.text")).alias("width"),
            F.lit(X.FONT_SIZE).alias("height"), F.lit(X.FONT_SIZE).alias("font_size"),
        )
    )


def page_texts(docs: DataFrame, text: str = "text", per_page: int = X.LINES_PER_PAGE,
               words_only: bool = True) -> DataFrame:
    """Plain text of every page, cut inside the document's row: no shuffle.

    words_only: words joined by a blank, lines without words left out; else the
    lines as they are.
    """
    kept = [c for c in docs.columns if c != text]

    def page(ls: Column, p: Column) -> Column:
        part = F.slice(ls, (p - 1) * per_page + 1, per_page)
        if words_only:
            part = F.filter(F.transform(part, lambda s: F.array_join(X.words(s), " ")),
                            lambda s: s != "")
        return F.array_join(part, "\n")

    cut = X.bind(X.lines(F.col(text)), lambda ls: F.transform(
        F.sequence(F.lit(1), X.page_count(F.size(ls), per_page)), lambda p: page(ls, p)))
    return (
        docs.select(*kept, cut.alias("_pages"))
        .select(*kept, F.posexplode_outer("_pages").alias("_p", "page_text"))
        .where("_p is not null")
        .select(*kept, (F.col("_p") + 1).alias("page_number"), "page_text")
    )


def page_text(span_rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Plain text of pages from a span table, as page_texts gives it for texts.

    Words are joined per line first, so no aggregate holds more than a line of words.
    """
    def joined(col: str, place: str, sep: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(place, col)))
        return F.array_join(F.transform(ordered, lambda s: s[col]), sep)

    return (
        span_rows.groupBy(*keys, "line_no").agg(joined("text", "span_idx", " ").alias("line"))
        .groupBy(*keys).agg(joined("line", "line_no", "\n").alias("page_text"))
    )


def wrap(df: DataFrame, col: str, max_chars: int) -> DataFrame:
    """Greedy word wrap by byte length; one row per wrapped line (wrap_no 0-based).

    The end of a line is looked up in the running sizes of the words.
    """
    @F.pandas_udf("array<string>")
    def wrapped(texts):
        def fold(text):
            words = (text or "").split()
            upto = np.cumsum([0, *(len(w.encode()) + 1 for w in words)])
            out, at = [], 0
            while at < len(words):
                end = int(np.searchsorted(upto, upto[at] + max_chars + 1, "right")) - 1
                end = max(end, at + 1)  # a word longer than a line has one for itself
                out.append(" ".join(words[at:end]))
                at = end
            return out

        return texts.map(fold)

    kept = [c for c in df.columns if c != col]
    return df.select(*kept, wrapped(F.col(col)).alias("_w")).select(
        *kept, F.posexplode("_w").alias("wrap_no", col))


# Variable-height page model (start, floor, heading, line, blank).
FLOW_TOP, FLOW_FLOOR = 780, 60
FLOW_HEADING, FLOW_LINE, FLOW_BLANK = 24, 16, 12


def flow_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pages of lines with different heights: first line 24, others 16, blank 12.

    A page ends with the first line that is not blank and falls below the floor;
    it is looked up in the running heights, once a page.
    """
    @F.pandas_udf("struct<page_number:array<int>,y:array<double>>")
    def placed(line_lists):
        import pandas as pd

        def place(items):
            n = len(items)
            filled = np.fromiter((bool(x.strip()) for x in items), bool, n)
            height = np.where(filled, FLOW_LINE, FLOW_BLANK)
            if n and filled[0]:
                height[0] = FLOW_HEADING
            upto = np.concatenate([[0], np.cumsum(height)])
            ends, starts = np.flatnonzero(filled) + 1, [0]
            while True:
                below = np.searchsorted(upto, upto[starts[-1]] + FLOW_TOP - FLOW_FLOOR, "right")
                k = np.searchsorted(ends, below)
                if k == len(ends):
                    break
                starts.append(int(ends[k]))
            page = np.searchsorted(starts, np.arange(n), "right")
            return page, FLOW_TOP - (upto[:n] - upto[np.array(starts)[page - 1]]).astype(float)

        rows = [place(x) for x in line_lists]
        return pd.DataFrame({"page_number": [p for p, _ in rows], "y": [y for _, y in rows]})

    kept = [c for c in docs.columns if c != text]
    found = docs.select(*kept, X.lines(F.col(text)).alias("_lines"))
    both = F.arrays_zip(F.col("_lines").alias("line"), F.col("_at.page_number").alias("page_number"),
                        F.col("_at.y").alias("y"))
    return (
        found.withColumn("_at", placed("_lines"))
        .select(*kept, both.alias("_both"))
        .select(*kept, F.posexplode("_both").alias("line_no", "_p"))
        .select(*kept, "line_no", F.col("_p.line").alias("line"),
                F.col("_p.page_number").alias("page_number"), F.col("_p.y").alias("y"))
    )


def headings(line_rows: DataFrame) -> DataFrame:
    return line_rows.where(X.is_heading(F.col("line")))


def markup_nodes(pages_df: DataFrame, html: str = "html") -> DataFrame:
    """Text nodes of markup, one row each (node_no 0-based among the kept ones)."""
    kept = [c for c in pages_df.columns if c != html]
    return pages_df.select(*kept, X.markup_text_nodes(F.col(html)).alias("_nodes")).select(
        *kept, F.posexplode("_nodes").alias("node_no", "node_text"))


# Tolerances between a word and an image box; the next word's own.
BOX_DX, BOX_DY, NEXT_DX = 12.0, 25.0, 8.0


def _with_boxes(span_rows: DataFrame, boxes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Spans with the first box near their corner, and the outermost boxes starting close by.

    The band test becomes an equi join on cells of the tolerance's size: a box is
    listed in its own cell and the eight around it, so a page full of boxes does
    not meet a page full of words pairwise. The boxes of a cell are one row, so a
    span meets them once and is shuffled once.
    """
    near_by = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    cells = (
        boxes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(
            "box_no", F.col("x").alias("box_x"), F.col("width").alias("box_width"),
            F.col("top_y").alias("box_y")).alias("_box"))
        .withColumn("_dx", F.explode(near_by)).withColumn("_dy", F.explode(near_by))
        .groupBy(*[f"_{k}" for k in keys],
                 (F.floor(F.col("_box.box_x") / BOX_DX) + F.col("_dx")).alias("_col"),
                 (F.floor(F.col("_box.box_y") / BOX_DY) + F.col("_dy")).alias("_row"))
        .agg(F.collect_list("_box").alias("_boxes"))
    )
    same = [span_rows[k] == cells[f"_{k}"] for k in keys]
    found = span_rows.join(
        cells, [*same, F.floor(span_rows["x"] / BOX_DX) == cells["_col"],
                F.floor(span_rows["y"] / BOX_DY) == cells["_row"]], "left")
    near = F.filter("_boxes", lambda b: (F.abs(b["box_x"] - F.col("x")) < BOX_DX)
                    & (F.abs(b["box_y"] - F.col("y")) < BOX_DY))
    close = F.transform(F.filter("_near", lambda b: F.abs(b["box_x"] - F.col("x")) < NEXT_DX),
                        lambda b: b["box_x"])
    return (found.select(*[span_rows[c] for c in span_rows.columns], near.alias("_near"))
            .select(*span_rows.columns, F.array_min("_near").alias("_box"),
                    F.array_min(close).alias("near_min"), F.array_max(close).alias("near_max"))
            .select(*span_rows.columns, "_box.box_no", "_box.box_x", "_box.box_width", "near_min",
                    "near_max"))


def match_boxes(span_rows: DataFrame, boxes: DataFrame,
                keys: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Spans with the first image box (by box_no) near their corner, null without one."""
    return _with_boxes(span_rows, boxes, keys).drop("near_min", "near_max")


# Grouping and scaling of words over an image box.
RIGHT_SLACK, OTHER_BOX = 15.0, 2.0
TRIM_ONE, TRIM_MORE, MAX_WIDTH_SCALE, MAX_FONT_SCALE, MIN_FONT = 0.855, 0.935, 1.25, 1.20, 10.0


def _box_groups(g: Arrays, lines: np.ndarray) -> Arrays:
    """Group of every word of some lines: words run on from a matched one inside its box.

    ``lines`` are the places of their first words. All lines take a step at a time, each from its
    last group to the next word that has a box.
    """
    n = len(g["x"])
    start, end = np.arange(n), np.arange(n)
    last = np.append(lines[1:], n) - 1
    matched = np.where(np.isnan(g["box_x"]), n, start)
    following = np.append(np.minimum.accumulate(matched[::-1])[::-1], n)
    head = following[lines]
    head, last = head[head <= last], last[head <= last]
    at = head
    x_max = g["x"] + g["width"]
    while len(head):
        word = np.minimum(at + 1, n - 1)
        bx, lo, hi = g["box_x"][head], g["near_min"][word], g["near_max"][word]
        other = ~np.isnan(lo) & ((np.abs(lo - bx) > OTHER_BOX) | (np.abs(hi - bx) > OTHER_BOX))
        right = bx + g["box_width"][head] + RIGHT_SLACK
        on = (at < last) & ~other & ~(x_max[word] > right)
        start[word[on]] = head[on]
        end[head[~on]] = at[~on]
        head = np.where(on, head, following[at + 1])
        at = np.where(on, word, head)
        left = at <= last
        head, at, last = head[left], at[left], last[left]
    end = end[start]
    return {"group_x": g["x"][start], "group_width": np.abs(x_max[end] - g["x"][start]),
            "group_size": (end - start + 1).astype(np.int32),
            "target_width": g["box_width"][start], "first_bytes": g["n_bytes"][start]}


def fit_to_boxes(span_rows: DataFrame, boxes: DataFrame,
                 keys: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Stretch the words drawn over an image box to the width of the box.

    The matching is a join, the grouping walks the words of all lines of a batch, and the
    scaling is plain columns.
    """
    ident = [*keys, "line_no", "span_idx"]
    types = dict(span_rows.dtypes)
    nan = F.lit(float("nan"))
    rows = _with_boxes(span_rows, boxes, keys).select(
        *ident, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")],
        F.octet_length("text").alias("n_bytes"), "text",
        *[F.coalesce(F.col(c).cast("double"), nan).alias(c)
          for c in ("box_x", "box_width", "near_min", "near_max")])
    schema = ", ".join(f"{k} {types[k]}" for k in ident) + (
        ", x double, y double, width double, height double, n_bytes int, text string, "
        "box_x double, box_width double, near_min double, near_max double, group_x double, "
        "group_width double, group_size int, target_width double, first_bytes int")
    grouped = map_sorted_runs(
        rows, [*keys, "line_no"], ["span_idx"], _box_groups,
        ["x", "width", "n_bytes", "box_x", "box_width", "near_min", "near_max"], schema)
    one = F.col("group_size") == 1
    wanted = F.col("target_width") * F.when(one, TRIM_ONE).otherwise(TRIM_MORE)
    raw = F.when(F.col("group_width") > 0, wanted / F.col("group_width")).otherwise(F.lit(1.0))
    keep = F.isnan("target_width") | (one & (F.col("first_bytes") <= 1)) | (raw <= 1.0)
    scale = F.when(keep, 1.0).otherwise(F.least(raw, F.lit(MAX_WIDTH_SCALE)))
    return grouped.withColumn("scale", scale).select(
        *ident, "text",
        F.when(F.col("scale") > 1, F.col("group_x") + (F.col("x") - F.col("group_x")) * F.col("scale"))
        .otherwise(F.col("x")).alias("x"), "y", (F.col("width") * F.col("scale")).alias("width"),
        "height", F.greatest(F.col("height") * F.least("scale", F.lit(MAX_FONT_SCALE)),
                             F.lit(MIN_FONT)).alias("font_size"), "scale")
