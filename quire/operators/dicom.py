"""Medical image headers and sample windowing."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Window presets (name, center, width).
PRESETS = [
    ("soft_tissue", 40.0, 400.0), ("lung", -600.0, 1500.0), ("bone", 400.0, 1800.0),
    ("brain", 40.0, 80.0), ("mediastinum", 50.0, 350.0),
]
# Header tags (group, element) and how their value is read.
TAGS = {
    (0x0008, 0x0020): ("study_date", "text"), (0x0008, 0x0060): ("modality", "text"),
    (0x0008, 0x103E): ("series_description", "text"), (0x0010, 0x0010): ("patient_name", "text"),
    (0x0010, 0x0020): ("patient_id", "text"), (0x0018, 0x0015): ("body_part", "text"),
    (0x0028, 0x0010): ("rows", "side"), (0x0028, 0x0011): ("columns", "side"),
    (0x0028, 0x0030): ("spacing", "pair"), (0x0028, 0x0100): ("bits_allocated", "u16"),
    (0x0028, 0x0101): ("bits_stored", "u16"), (0x0028, 0x0103): ("pixel_representation", "u16"),
    (0x0028, 0x1050): ("window_center", "first"), (0x0028, 0x1051): ("window_width", "first"),
    (0x0028, 0x1052): ("rescale_intercept", "number"), (0x0028, 0x1053): ("rescale_slope", "number"),
}
PIXEL_DATA = (0x7FE0, 0x0010)
LONG_VR = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN")
SEQUENCE_END = b"\xfe\xff\xdd\xe0"
UNDEFINED = 0xFFFFFFFF
# Header defaults and caps.
DEFAULTS = {
    "modality": "CT", "rows": 512, "columns": 512, "bits_allocated": 16, "bits_stored": 12,
    "pixel_representation": 0, "rescale_intercept": -1024.0, "rescale_slope": 1.0,
    "window_center": 40.0, "window_width": 400.0,
}
MAX_SIDE, MAX_SIDE_WITHOUT_PIXELS, MAX_PIXELS = 4096, 1024, 16_777_216

HEADER_SCHEMA = (
    "object_id string, patient_name string, patient_id string, study_date string, "
    "modality string, body_part string, series_description string, rows int, columns int, "
    "bits_allocated int, bits_stored int, pixel_representation int, rescale_intercept double, "
    "rescale_slope double, window_center double, window_width double, spacing_x double, "
    "spacing_y double, has_pixels boolean, reject string, declared_rows int, declared_columns int"
)
_COLUMNS = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _elements(data: bytes, total: int) -> Iterator[tuple[tuple[int, int], memoryview, int, int]]:
    """Data elements up to the pixel data: tag, value, declared length, bytes there are.

    ``total`` is the size of the object, of which ``data`` may be the beginning.
    """
    view, at = memoryview(data), 132 if data[128:132] == b"DICM" else 0
    while at + 8 <= len(data):
        tag = struct.unpack_from("<HH", data, at)
        vr = data[at + 4:at + 6]
        explicit = vr.isalpha() and vr.isupper()
        fmt, at = ("<I", at + 8) if explicit and vr in LONG_VR else (
            ("<H", at + 6) if explicit else ("<I", at + 4))
        if at + struct.calcsize(fmt) > len(data):
            return
        (length,) = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        end = min(at + length, len(data))
        yield tag, view[at:end], length, min(length, total - at)
        if tag == PIXEL_DATA:
            return
        if length == UNDEFINED:
            mark = data.find(SEQUENCE_END, at)
            while mark >= 0 and (mark - at) % 2:
                mark = data.find(SEQUENCE_END, mark + 1)
            if mark < 0:
                return
            end = mark + 8
        at = end


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _read(kind: str, raw: memoryview):
    if kind in ("u16", "side"):
        if len(raw) < 2:
            return None
        return struct.unpack_from("<H", raw)[0]
    text = bytes(raw).decode("utf-8", "replace").strip("\0").strip()
    if kind == "text":
        return text
    if kind == "pair":
        parts = [_number(p.strip()) for p in text.split("\\")[:2]]
        return (parts[1], parts[0]) if len(parts) == 2 and None not in parts else None
    return _number(text.split("\\")[0].strip() if kind == "first" else text)


def read_header(data: bytes, total: int | None = None) -> tuple[dict, memoryview | None]:
    """Header fields and, where present, the plain pixel bytes of one object."""
    total = len(data) if total is None else total
    if total < 132:
        return {"reject": "too_short"}, None
    found, pixels = dict(DEFAULTS), None
    found["has_pixels"], found["cut_off"] = False, len(data) < total
    for tag, raw, length, there in _elements(data, total):
        if tag == PIXEL_DATA:
            found["cut_off"] = False
            if length == UNDEFINED:
                found["has_pixels"] = True
            elif found["rows"] * found["columns"] > MAX_PIXELS:
                found["reject"] = "too_many_pixels"
            elif there > 0 and found["bits_allocated"] in (8, 16):
                found["has_pixels"], pixels = True, raw
        elif tag in TAGS:
            name, kind = TAGS[tag]
            value = _read(kind, raw)
            if value is not None:
                found[name] = value
    # the size that is shown has limits; the declared one is kept beside it
    most = MAX_SIDE if found["has_pixels"] else MAX_SIDE_WITHOUT_PIXELS
    for side in ("rows", "columns"):
        found[f"declared_{side}"] = found[side]
        found[side] = min(max(found[side], 1), most)
    spacing = found.pop("spacing", (None, None))
    found["spacing_x"], found["spacing_y"] = spacing
    return found, pixels


def before_pixels(content: Column) -> Column:
    """Beginning of an object up to the length of its pixel data, which stays in the JVM.

    The last place that could be the pixel tag is taken, so that a value that
    looks like it cuts nothing off an object with pixels; without such a place
    it is the whole object.
    """
    size, tag = F.octet_length(content), "\xe0\x7f\x10\x00"
    back = F.instr(F.reverse(F.decode(content, "ISO-8859-1")), tag[::-1])
    return F.when(back > 0, F.substr(content, F.lit(1), size - back + 9)).otherwise(content)


def headers(files: DataFrame) -> DataFrame:
    """Header row per object (object_id, content); unreadable ones carry a reject reason.

    The few objects whose beginning ends without the pixel data are read whole.
    """
    fields = HEADER_SCHEMA.split(", ", 1)[1]
    types = {n: _ARROW[t] for n, t in (c.split() for c in f"{fields}, cut_off boolean".split(", "))}

    def found(contents: pa.Array, totals: pa.Array) -> pa.Array:
        rows = [{} if c is None else read_header(c, n)[0]
                for c, n in zip(contents.to_pylist(), totals.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([r.get(n) for r in rows], t) for n, t in types.items()], names=[*types])

    # a filter on the result would otherwise read every header a second time
    read = F.arrow_udf(found, f"{fields}, cut_off boolean").asNondeterministic()
    total = F.octet_length("content")
    first = files.select(F.col("object_id").cast("string").alias("object_id"), "content",
                         read(before_pixels(F.col("content")), total).alias("_h"))
    again = read(F.when(F.col("_h.cut_off"), F.col("content")), total)
    both = first.select("object_id", "_h", again.alias("_whole"))
    head = F.when(F.col("_h.cut_off"), F.col("_whole")).otherwise(F.col("_h"))
    return both.select("object_id", head.alias("_h")).select("object_id", *[
        F.col(f"_h.{c}").alias(c) for c in _COLUMNS[1:]])


def samples(files: DataFrame, block: int = 65_536) -> DataFrame:
    """Raw samples (object_id, idx, raw) of objects with plain pixel data."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0  # (object_id, first sample) and samples not handed on yet

        def flush() -> pa.RecordBatch:
            sizes = [len(p) for p in parts]
            at = np.concatenate([np.arange(a, a + k) for (_, a), k in zip(ids, sizes)])
            names = pa.array([i for i, _ in ids], pa.string()).take(
                pa.array(np.repeat(np.arange(len(ids)), sizes)))
            return pa.record_batch([names, pa.array(at, pa.int64()), pa.array(np.concatenate(parts))],
                                   names=["object_id", "idx", "raw"])

        for batch in batches:
            for i, content in zip(*(c.to_pylist() for c in batch.columns)):
                head, pixels = ({}, None) if content is None else read_header(content)
                if pixels is None:
                    continue
                kind = "u1" if head["bits_allocated"] == 8 else (
                    "<i2" if head["pixel_representation"] == 1 else "<u2")
                size = np.dtype(kind).itemsize
                raw = np.frombuffer(pixels, kind, len(pixels) // size)
                raw = raw[:head["declared_rows"] * head["declared_columns"]]
                for a in range(0, len(raw), block):
                    ids.append((i, a))
                    parts.append(raw[a:a + block].astype(float))
                    n += len(parts[-1])
                    if n >= block:
                        yield flush()
                        ids, parts, n = [], [], 0
        if parts:
            yield flush()

    return files.select(F.col("object_id").cast("string"), "content").mapInArrow(
        run, "object_id string, idx bigint, raw double")


def rescale(raw: Column, slope: Column, intercept: Column) -> Column:
    return raw * slope + intercept


def intensity(value: Column, center: Column, width: Column) -> Column:
    """Linear window to 0..255; the width is at least 1."""
    ww = F.greatest(width, F.lit(1.0))
    low, high = center - ww / 2.0, center + ww / 2.0
    ramp = F.round((value - low) / ww * 255.0).cast("int")
    return F.when(value <= low, 0).when(value >= high, 255).otherwise(ramp)


def preset_intensities(values: DataFrame, value: str = "hu") -> DataFrame:
    """One row per sample and preset; the five presets are constants of the row."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("preset"),
                 intensity(F.col(value), F.lit(c), F.lit(w)).alias("intensity"))
        for n, c, w in PRESETS])
    return values.withColumn("_rows", rows).select(*values.columns, F.inline("_rows"))


def histogram(intensities: DataFrame, key: str = "object_id") -> DataFrame:
    return intensities.groupBy(key, "preset", "intensity").agg(F.count("*").alias("n"))


def study_catalogue(header_rows: DataFrame) -> DataFrame:
    """Objects per modality and body part, with subtotals; rejected ones left out."""
    return header_rows.where("reject is null").rollup("modality", "body_part").agg(
        F.count("*").alias("objects"))
