"""Annotations: XFDF exchange, replace-all upserts, counts, rectangle merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import text as X

# XFDF tags of the annotation types; any other type becomes a stamp.
TAGS = {"highlight": "highlight", "note": "text", "rectangle": "square", "freehand": "ink",
        "redact": "redact"}
OTHER_TAG = "stamp"
# XFDF frame.
XFDF_HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n'
             '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">\n  <annots>\n')
XFDF_TAIL = "  </annots>\n</xfdf>\n"
# What a read annotation gets where XFDF says nothing.
DEFAULT_RECT = (50.0, 50.0, 100.0, 30.0)
DEFAULT_COLORS = {"redact": "#000000", "note": "#f59e0b"}
DEFAULT_COLOR, DEFAULT_AUTHOR = "#fef08a", "Utilisateur"
FULL_OPACITY, LIGHT_OPACITY = 1.0, 0.45


def _pick(col: Column, mapping: dict, otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(table, col), otherwise)


def xfdf_element(row_type: Column) -> Column:
    """XFDF element of one annotation row."""
    esc = X.escape_xml
    tag = _pick(row_type, TAGS, F.lit(OTHER_TAG))
    num = "%.2f"
    rect = F.format_string(
        ",".join([num] * 4), "x", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height"))
    reason = F.when((tag == "redact") & F.col("reason").isNotNull(),
                    F.concat(F.lit(' reason="'), esc(F.col("reason")), F.lit('"'))
                    ).otherwise(F.lit(""))
    head = F.concat(
        F.lit("    <"), tag, F.lit(' page="'), F.greatest(F.col("page_number") - 1, F.lit(0)),
        F.lit('" rect="'), rect, F.lit('" color="'), esc(F.col("color")), F.lit('" title="'),
        esc(F.col("author")), F.lit('" date="'), esc(F.col("created_at")), F.lit('"'), reason)
    close = F.concat(F.lit("    </"), tag, F.lit(">\n"))
    contents = F.coalesce(F.concat(F.lit("      <contents>"), esc(F.col("content")),
                                   F.lit("</contents>\n")), F.lit(""))
    points = F.array_join(F.transform(
        "points", lambda p: F.format_string("%.1f,%.1f", p["x"], p["y"])), ";")
    ink = F.when(F.size("points") > 0, F.concat(
        F.lit("      <inklist>\n        <gesture>"), points,
        F.lit("</gesture>\n      </inklist>\n"))).otherwise(F.lit(""))
    open_, empty = F.lit(">\n"), F.lit(" />\n")
    return (
        F.when(tag.isin("square", "stamp"), F.concat(head, empty))
        .when(tag == "ink", F.concat(head, open_, ink, close))
        .otherwise(F.concat(head, open_, contents, close))
    )


def to_xfdf(annotations: DataFrame) -> DataFrame:
    """One XFDF text per document (doc_id, xfdf), elements in the order of ``seq``.

    The group of a document is its text, which is one value of the result.
    """
    rows = annotations.select("doc_id", "seq", xfdf_element(F.col("annotation_type")).alias("e"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "e")))
    body = F.array_join(F.transform(ordered, lambda s: s["e"]), "")
    return rows.groupBy("doc_id").agg(
        F.concat(F.lit(XFDF_HEAD), body, F.lit(XFDF_TAIL)).alias("xfdf"))


# An opening tag line, and, unless it closes itself, the lines up to the next closing tag.
_HEAD = r"^[ \t]*<(?:highlight|text|square|ink|redact|stamp) [^\n]*"
_BLOCK = rf"(?m)({_HEAD}/>[ \t\r]*$|{_HEAD}(?:\n(?![ \t]*</)[^\n]*+)*+)"


def from_xfdf(docs: DataFrame, text: str = "xfdf") -> DataFrame:
    """Annotations of XFDF texts, line based.

    As lossy as the exchange itself: other types come back as stamps, points are
    dropped, entities stay escaped, ids are new (derived from the place).
    """
    kept = [c for c in docs.columns if c != text]
    blocks = docs.select(*kept, F.regexp_extract_all(text, F.lit(_BLOCK), 1).alias("_blocks")).select(
        *kept, F.posexplode("_blocks").alias("seq", "_block"))
    head = F.trim(F.element_at(F.split("_block", "\n"), 1), F.lit(" \t\r"))
    rows = blocks.select(*kept, "seq", "_block", head.alias("_head"))

    def attr(name: str) -> Column:
        return F.when(F.col("_head").contains(f'{name}="') & F.col("_head").rlike(f'{name}="[^"]*"'),
                      F.regexp_extract("_head", f'{name}="([^"]*)"', 1))

    tag = F.regexp_extract("_head", r"^<([a-z]+) ", 1)
    kind = _pick(tag, {v: k for k, v in TAGS.items()}, F.lit("stamp"))
    contents = F.regexp_extract_all(
        "_block", F.lit(r"(?m)^[ \t]*<contents>([^\n]*)</contents>[ \t\r]*$"), 1)
    numbers = F.array_compact(F.transform(F.split(attr("rect"), ","), lambda s: s.try_cast("double")))
    fields = rows.withColumns({
        "annotation_type": kind, "_rect": numbers,
        "content": F.when(~F.col("_head").endswith("/>"), F.try_element_at(contents, F.lit(-1))),
    })
    usable = F.size("_rect") == 4
    corner = [F.get("_rect", F.lit(i)) for i in range(4)]
    values = (corner[0], corner[1], F.abs(corner[2] - corner[0]), F.abs(corner[3] - corner[1]))
    rect = {n: F.when(usable, v).otherwise(F.lit(d))
            for n, v, d in zip(("x", "y", "width", "height"), values, DEFAULT_RECT)}
    page = F.coalesce(F.when(attr("page").rlike("^[+]?[0-9]+$"), attr("page").try_cast("bigint")),
                      F.lit(0))
    t = F.col("annotation_type")
    return fields.select(
        *kept, "seq", F.sha2(F.concat_ws(":", *kept, "seq"), 256).alias("annotation_id"),
        (page + 1).cast("int").alias("page_number"), "annotation_type",
        *[e.alias(n) for n, e in rect.items()],
        F.coalesce(attr("color"), _pick(t, DEFAULT_COLORS, F.lit(DEFAULT_COLOR))).alias("color"),
        F.when(t.isin("redact", "note"), FULL_OPACITY).otherwise(LIGHT_OPACITY).alias("opacity"),
        F.coalesce(attr("title"), F.lit(DEFAULT_AUTHOR)).alias("author"),
        F.coalesce(attr("date"), F.lit("")).alias("created_at"), "content",
        attr("reason").alias("reason"),
    )


def latest_batches(annotations: DataFrame) -> DataFrame:
    """Replace-all upsert: rows of the newest batch of every document."""
    newest = annotations.groupBy("doc_id").agg(F.max("batch_ts").alias("batch_ts"))
    return annotations.join(newest, ["doc_id", "batch_ts"], "left_semi")


def active_counts(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Number of annotations of every document, 0 where there is none."""
    n = annotations.groupBy("doc_id").agg(F.count("*").alias("annotation_count"))
    return docs.select("doc_id").join(n, "doc_id", "left").fillna(0, ["annotation_count"])


def round_trip_losses(annotations: DataFrame) -> DataFrame:
    """Annotations whose page, type or content did not survive export and import."""
    back = from_xfdf(to_xfdf(annotations))
    cols = ["doc_id", "page_number", "annotation_type", "content", "reason"]
    return annotations.select(*cols).exceptAll(back.select(*cols))


def by_connector(annotations: DataFrame, mappings: DataFrame) -> DataFrame:
    """Annotations with the connector and resource their document came from."""
    return annotations.join(
        mappings.select("doc_id", "mapping.connector", "mapping.resource_id"), "doc_id")


# Tolerances of rectangle merging.
MIN_SIDE, ROW_TOLERANCE, LINE_TOLERANCE, TOUCH_GAP = 2.0, 4.0, 6.0, 6.0


def _merged_runs(rects: Column) -> Column:
    """Rectangles of one selection in their order, those that touch joined to one."""
    box = "struct<x:double,y:double,width:double,height:double>"
    start = F.struct(F.lit(None).cast(box).alias("open"), F.expr(f"cast(array() as array<{box}>)")
                     .alias("done"))

    def step(acc: Column, r: Column) -> Column:
        last = acc["open"]
        touches = ((F.abs(last["y"] - r["y"]) < LINE_TOLERANCE)
                   & (F.abs(last["height"] - r["height"]) < LINE_TOLERANCE)
                   & (r["x"] <= last["x"] + last["width"] + TOUCH_GAP))
        wider = F.greatest(last["x"] + last["width"], r["x"] + r["width"]) - last["x"]
        fresh = F.struct(*[r[c].cast("double").alias(c) for c in ("x", "y", "width", "height")])
        return (
            F.when(last.isNull(), F.struct(fresh.alias("open"), acc["done"].alias("done")))
            .when(touches, F.struct(
                F.struct(last["x"].alias("x"), last["y"].alias("y"), wider.alias("width"),
                         last["height"].alias("height")).alias("open"), acc["done"].alias("done")))
            .otherwise(F.struct(fresh.alias("open"),
                                F.array_append(acc["done"], last).alias("done"))))

    return F.aggregate(rects, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))


def merge_rects(rects: DataFrame) -> DataFrame:
    """Merge the rectangles of a selection that touch on one line.

    Rows are bands of the tolerance's height, then x; sorting by a tolerance
    itself is not transitive and would depend on the input order. A selection
    is one user's mark on one page.
    """
    keys = ["doc_id", "page_number", "selection"]
    ordered = F.sort_array(F.collect_list(F.struct(
        F.floor(F.col("y") / ROW_TOLERANCE).alias("_row"), "x", "y", "width", "height")))
    rows = rects.where((F.col("width") >= MIN_SIDE) & (F.col("height") >= MIN_SIDE))
    return rows.groupBy(*keys).agg(ordered.alias("_rects")).select(
        *keys, F.posexplode(_merged_runs(F.col("_rects"))).alias("rect_no", "r")).select(
        *keys, F.col("rect_no").cast("bigint").alias("rect_no"), "r.*")
