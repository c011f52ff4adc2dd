"""Drawing exchange files as layer and entity tables.

A drawing is one input row. Its text is cut into records by a small function
inside its task; only records are written and shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Colors by index number; first entry of each range and its color.
ACI_RANGES = [
    (1, 1, "#FF0000"), (2, 2, "#FFFF00"), (3, 3, "#00FF00"), (4, 4, "#00FFFF"),
    (5, 5, "#0066FF"), (6, 6, "#FF00FF"), (7, 7, "#FFFFFF"), (8, 8, "#808080"),
    (9, 9, "#C0C0C0"), (10, 19, "#FF3333"), (20, 39, "#FFA500"), (40, 59, "#FFD700"),
    (60, 79, "#7CFC00"), (80, 99, "#32CD32"), (100, 119, "#00CED1"), (120, 139, "#1E90FF"),
    (140, 159, "#4169E1"), (160, 179, "#8A2BE2"), (180, 199, "#9400D3"), (200, 219, "#FF1493"),
    (220, 239, "#DC143C"), (240, 249, "#A52A2A"), (250, 255, "#505050"),
]
ACI_OTHER = "#0066CC"
# The implicit layer, the default color number, the color without a layer.
IMPLICIT_LAYER, DEFAULT_ACI, NO_LAYER_COLOR = "0", 7, "#333333"
# Extent of a degenerate drawing, text width per byte and height.
EMPTY_EXTENT = (0.0, 0.0, 800.0, 600.0)
TEXT_ASPECT, TEXT_HEIGHT = 0.6, 2.5
# Canvas of the fit transform.
MARGIN, CANVAS_W, CANVAS_H, MIN_W, MIN_H = 40.0, 1200.0, 900.0, 400.0, 300.0
MAX_SCALE, MIN_SCALE = 10.0, 0.01
# Entity kinds that become geometry.
KINDS = {"LINE": "line", "CIRCLE": "circle", "ARC": "arc", "LWPOLYLINE": "polyline",
         "POLYLINE": "polyline", "TEXT": "text", "MTEXT": "text", "SOLID": "solid",
         "TRACE": "solid"}


def aci_hex(aci: Column) -> Column:
    """Color of an index number; the sign only tells visibility."""
    a = F.abs(aci)
    color = F.when(F.lit(False), "")
    for lo, hi, value in ACI_RANGES:
        color = color.when(a.between(lo, hi), value)
    return color.otherwise(ACI_OTHER)


# Records that open and close sections and tables.
SECTION, END_SECTION, TABLE, END_TABLE = "SECTION", "ENDSEC", "TABLE", "ENDTAB"
#: records that are handed on at a time
RECORDS = 10_000
_LINE_END, _SPACES = re.compile("\r?\n"), " \t\r\x0b\x0c"
_WHOLE = re.compile("[+-]?[0-9]+")
_DOUBLE = re.compile("([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)[dDfF]?")
_HEX = re.compile("[+-]?0[xX](?:[0-9a-fA-F]+[.]?[0-9a-fA-F]*|[.][0-9a-fA-F]+)[pP][+-]?[0-9]+")
_NAMED = {"inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan"}


def _double(value: str) -> float | None:
    """A number in the forms that a cast reads; null for other text."""
    if found := _DOUBLE.fullmatch(value):
        return float(found[1])
    if _HEX.fullmatch(value):
        return float.fromhex(value)
    return float(value) if value.lower() in _NAMED else None


def _whole(value: str) -> int | None:
    if not _WHOLE.fullmatch(value):
        return None
    n = int(value)
    return n if -2 ** 31 <= n < 2 ** 31 else None


def drawing_records(content: str) -> Iterator[tuple[int, str, str, str, list[tuple[str, str]]]]:
    """Pair number, type, section, table and pairs of the records of a drawing: runs of group-code
    pairs that start at a code 0. A record that opens or closes a section or table lies in what it
    sets."""
    if "\n" not in content:
        return
    rows = [s.strip(_SPACES) for s in _LINE_END.split(content)]
    if rows[-1] == "":
        rows.pop()
    pairs = [*zip(rows[::2], rows[1::2])]
    starts = [i for i, (code, _) in enumerate(pairs) if code == "0"]
    section = table = ""
    for a, b in zip(starts, [*starts[1:], len(pairs)]):
        kind, items = pairs[a][1], pairs[a + 1:b]
        name = items[0][1] if items and items[0][0] == "2" else None
        if kind == END_SECTION:
            section = table = ""
        elif kind == END_TABLE:
            table = ""
        elif kind == SECTION and name is not None:
            section = name
        elif kind == TABLE and name is not None and section == "TABLES":
            table = name
        yield a + 1, kind, section, table, items


def _points(items: list[tuple[str, str]]) -> list[dict]:
    """Vertices: every y (code 20) with the x (code 10) read last before it."""
    x, out = 0.0, []
    for code, value in items:
        if code in ("10", "20") and (v := _double(value)) is not None:
            if code == "10":
                x = v
            else:
                out.append({"x": x, "y": v})
    return out


_DOUBLES = {"10": ("x1", 0.0), "20": ("y1", 0.0), "11": ("x2", 0.0), "21": ("y2", 0.0),
            "40": ("radius", 0.0), "50": ("start_angle", 0.0), "51": ("end_angle", 360.0)}
_FIELDS = {"rec": pa.int32(), "type": pa.string(), "section": pa.string(), "in_table": pa.string(),
           "name": pa.string(), "layer": pa.string(), "aci": pa.int32(), "text": pa.string(),
           "negative": pa.bool_(), "odd_flag": pa.bool_(), "flag": pa.int32(),
           **{n: pa.float64() for n, _ in _DOUBLES.values()}, "height": pa.float64(),
           "points": pa.list_(pa.struct({"x": pa.float64(), "y": pa.float64()}))}
_FIELDS_TYPE = ("rec int, type string, section string, in_table string, name string, layer string, "
                "aci int, text string, negative boolean, odd_flag boolean, flag int, x1 double, "
                "y1 double, x2 double, y2 double, radius double, start_angle double, "
                "end_angle double, height double, points array<struct<x:double,y:double>>")


def _fields(kind: str, items: list[tuple[str, str]]) -> tuple:
    """Last readable value of each field, whether a color is negative and whether a flag is odd."""
    text: dict[str, str] = {}
    number = {n: d for n, d in _DOUBLES.values()}
    height, aci, flag, negative, odd = TEXT_HEIGHT, None, None, False, False
    for code, value in items:
        if code in _DOUBLES:
            if (v := _double(value)) is not None:
                number[_DOUBLES[code][0]] = v
                height = v if code == "40" else height
        elif code == "62":
            if (n := _whole(value)) is not None:
                aci, negative = n, negative or n < 0
        elif code == "70":
            if (n := _whole(value)) is not None:
                flag, odd = n, odd or n & 1 != 0
        elif code in ("1", "2", "8"):
            text[code] = value
    points = _points(items) if kind in ("LWPOLYLINE", "POLYLINE") else None
    return (text.get("2"), text.get("8"), aci, text.get("1"), negative, odd, flag, *number.values(),
            height, points)


def records(drawings: DataFrame, key: str = "drawing_id", content: str = "content") -> DataFrame:
    """Records opened by code 0 with their place (section, in_table) and fields."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []

            def flush() -> pa.RecordBatch:
                cols = [*zip(*rows)] or [()] * len(_FIELDS)
                return pa.record_batch(
                    [batch.column(0).take(pa.array(of, pa.int64())),
                     *[pa.array(c, t) for c, t in zip(cols, _FIELDS.values())]], names=[key, *_FIELDS])

            for no, drawing in enumerate(batch.column(1)):
                for pos, kind, section, table, items in drawing_records(drawing.as_py() or ""):
                    of.append(no)
                    rows.append((pos, kind, section, table, *_fields(kind, items)))
                    if len(rows) >= RECORDS:
                        yield flush()
                        of, rows = [], []
            yield flush()

    kind = drawings.schema[key].dataType.simpleString()
    return drawings.select(key, content).mapInArrow(run, f"`{key}` {kind}, {_FIELDS_TYPE}")


def _layer_record() -> Column:
    return (F.col("type") == "LAYER") & (F.col("in_table") == "LAYER")


def defined_layers(recs: DataFrame, drawings: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Layers of the layer table and the implicit one; the last definition of a name counts."""
    visible = ~(F.coalesce("negative", F.lit(False)) | F.coalesce("odd_flag", F.lit(False)))
    aci = F.coalesce("aci", F.lit(DEFAULT_ACI))
    written = recs.where(_layer_record()).select(
        key, F.coalesce("name", F.lit("Layer")).alias("layer"), aci.alias("color_aci"),
        aci_hex(aci).alias("color_hex"), visible.alias("is_visible"), "rec")
    implicit = drawings.select(
        key, F.lit(IMPLICIT_LAYER).alias("layer"), F.lit(DEFAULT_ACI).alias("color_aci"),
        F.lit(NO_LAYER_COLOR).alias("color_hex"), F.lit(True).alias("is_visible"),
        F.lit(0).alias("rec"))
    row = F.struct("color_aci", "color_hex", "is_visible")
    return written.unionByName(implicit).groupBy(key, "layer").agg(
        F.max_by(row, "rec").alias("_l")).select(key, "layer", "_l.*")


def _entity_records(recs: DataFrame) -> DataFrame:
    reserved = F.col("type").isin("SECTION", "ENDSEC", "TABLE", "ENDTAB")
    return recs.where((F.col("section") == "ENTITIES") & ~reserved & ~_layer_record()).withColumns({
        "layer": F.coalesce("layer", F.lit(IMPLICIT_LAYER)),
        "own_color": F.when(F.col("aci").isNotNull(), aci_hex(F.col("aci"))),
    })


def layers(recs: DataFrame, drawings: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Layer inventory with entity counts; unknown layers take their first entity's color."""
    used = _entity_records(recs).groupBy(key, "layer").agg(
        F.count("*").alias("entity_count"),
        F.min_by(F.coalesce("own_color", F.lit(NO_LAYER_COLOR)), "rec").alias("_first_color"))
    return defined_layers(recs, drawings, key).join(used, [key, "layer"], "full").select(
        key, "layer", F.coalesce("color_aci", F.lit(DEFAULT_ACI)).alias("color_aci"),
        F.coalesce("color_hex", "_first_color").alias("color_hex"),
        F.coalesce("is_visible", F.lit(True)).alias("is_visible"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


def entities(recs: DataFrame, layer_rows: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Entities that become geometry, with their own or their layer's color."""
    kinds = F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])
    found = _entity_records(recs).withColumn("kind", F.try_element_at(kinds, F.col("type")))
    colors = layer_rows.select(key, "layer", F.col("color_hex").alias("_layer_color"))
    return found.where("kind is not null").join(colors, [key, "layer"], "left").select(
        key, "rec", "kind", "layer", F.coalesce("own_color", "_layer_color").alias("color_hex"),
        "x1", "y1", "x2", "y2", "radius", "start_angle", "end_angle", "height",
        F.coalesce("text", F.lit("")).alias("text"), "points",
        F.coalesce(F.col("flag").bitwiseAND(1) != 0, F.lit(False)).alias("is_closed"))


def _tracked() -> Column:
    """Corners that an entity adds to the extent."""
    def at(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x1, y1, r = F.col("x1"), F.col("y1"), F.col("radius")
    width = F.octet_length("text") * F.col("height") * TEXT_ASPECT
    two = F.array(at(x1, y1), at(F.col("x2"), F.col("y2")))
    return (
        F.when(F.col("kind").isin("circle", "arc"), F.array(at(x1 - r, y1 - r), at(x1 + r, y1 + r)))
        .when(F.col("kind") == "polyline", F.col("points"))
        .when(F.col("kind") == "text", F.array(at(x1, y1), at(x1 + width, y1 + F.col("height"))))
        .otherwise(two))


def extents(entity_rows: DataFrame, drawings: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Bounding box per drawing; a fixed box where it is empty or flat."""
    def axis(c: str) -> Column:
        return F.transform("_pts", lambda p: p[c])

    box = entity_rows.select(key, _tracked().alias("_pts")).groupBy(key).agg(
        F.min(F.array_min(axis("x"))).alias("min_x"), F.min(F.array_min(axis("y"))).alias("min_y"),
        F.max(F.array_max(axis("x"))).alias("max_x"), F.max(F.array_max(axis("y"))).alias("max_y"))
    flat = ~F.coalesce((F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y")),
                       F.lit(False))
    names = ("min_x", "min_y", "max_x", "max_y")
    return drawings.select(key).join(box, key, "left").select(
        key, *[F.when(flat, F.lit(d)).otherwise(F.col(n)).alias(n)
               for n, d in zip(names, EMPTY_EXTENT)])


def on_layers(entity_rows: DataFrame, wanted: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Entities on wanted layers, given as comma lists (key, layer_list)."""
    names = wanted.select(key, F.explode(F.split("layer_list", ",")).alias("layer")).select(
        key, F.trim("layer").alias("layer")).where("layer <> ''")
    return entity_rows.join(names, [key, "layer"], "left_semi")


def fit(entity_rows: DataFrame, extent_rows: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Canvas coordinates: scaled to fit, y turned downwards."""
    w = F.abs(F.col("max_x") - F.col("min_x")) + 2 * MARGIN
    h = F.abs(F.col("max_y") - F.col("min_y")) + 2 * MARGIN
    scale = F.greatest(F.lit(MIN_SCALE), F.least(
        CANVAS_W / F.greatest(w, F.lit(1.0)), CANVAS_H / F.greatest(h, F.lit(1.0)),
        F.lit(MAX_SCALE)))
    canvas = extent_rows.select(
        key, "min_x", "min_y", scale.alias("scale"),
        F.greatest(F.round(w * scale), F.lit(MIN_W)).alias("canvas_w"),
        F.greatest(F.round(h * scale), F.lit(MIN_H)).alias("canvas_h"))

    def tx(x):
        return (x - F.col("min_x") + MARGIN) * F.col("scale")

    def ty(y):
        return F.col("canvas_h") - (y - F.col("min_y") + MARGIN) * F.col("scale")

    return entity_rows.join(canvas, key).withColumns({
        "cx1": tx(F.col("x1")), "cy1": ty(F.col("y1")),
        "cx2": tx(F.col("x2")), "cy2": ty(F.col("y2"))}).drop("min_x", "min_y")
