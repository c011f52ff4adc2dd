"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.plans.durable import settled

#: the white space that separates words: space and the control characters 9 to 13
SPACES = " \t\n\x0b\x0c\r"
#: rows of numbers that may be sent to every executor (16 bytes a row: 32 MB)
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column], F.lit(""))


def bucket(column: Column, parts: int) -> Column:
    """crc32 of a value's text, modulo ``parts``; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def small_side(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of a few numbers, written out; with a broadcast hint if at most ``most`` were counted.

    Beyond that size the rows take part in an ordinary shuffled join.
    """
    kept = settled(rows)
    return F.broadcast(kept) if kept.count() <= most else kept


def one_of_each(docs: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id.

    ``components`` gives doc_id and component_id of rows (doc_id, text). Where rows lack a doc_id or
    share one, rows are numbered and written out first: each counts by itself, and of a component
    the smallest doc_id stays, then the lowest number; rows without doc_id come last.
    """
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        gone = small_side(components(docs.select("doc_id", "text")).filter("doc_id <> component_id")
                          .select(F.col("doc_id").alias("gone_id")))
        return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    rows = settled(docs.select(F.monotonically_increasing_id().alias("number"),
                               F.struct(*docs.columns).alias("row")))
    found = components(rows.select(F.col("number").alias("doc_id"), "row.text")).select(
        F.col("doc_id").alias("number"), "component_id")
    place = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("number"))
    first = settled(rows.select("number", place.alias("place")).join(found, "number")
                    .groupBy("component_id").agg(F.min("place").alias("place")))
    kept = small_side(first.select(F.col("place.number").alias("number")))
    return rows.join(kept, "number", "left_semi").select("row.*")


def pigeonhole_masks(bits: int, blocks: int, differing: int) -> list[int]:
    """Masks such that two numbers differing in at most ``differing`` bits agree under one."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - differing)]


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return value - (1 << 64) if value >= 1 << 63 else value


def text_slices(texts, most: int = 4_000_000):
    """Places (a, b) of neighbouring texts of at most ``most`` bytes together, or of one text."""
    begin = total = 0
    for k, text in enumerate(texts):
        n = len(text.as_buffer() or b"")
        if total + n > most and k > begin:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)
