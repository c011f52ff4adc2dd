"""Case-insensitive search over word spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions import text as X
from quire.operators import textlayer
from quire.plans.durable import settled


#: places of texts that are looked at together
_PLACES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def clean_query(query: Column) -> Column:
    return F.lower(F.regexp_replace(query, rf"^[{X.WS}]+|[{X.WS}]+$", ""))


def search_spans(spans: DataFrame, query: str) -> DataFrame:
    """Spans containing the query; a blank query matches nothing."""
    needle = query.strip().lower()
    if not needle:
        return spans.limit(0)
    return spans.where(F.contains(F.lower("text"), F.lit(needle)))


def search_text(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Search in texts; documents and lines without the query are never cut into words."""
    needle = query.strip().lower()
    if not needle or any(c.isspace() for c in needle):
        return textlayer.spans(textlayer.lines(docs, text)).limit(0)
    found = textlayer.lines(docs.where(F.contains(F.lower(text), F.lit(needle))), text)
    return search_spans(
        textlayer.spans(found.where(F.contains(F.lower("line"), F.lit(needle)))), query)


def search_many(spans: DataFrame, queries: DataFrame, gram: int = 3) -> DataFrame:
    """Match many queries (query_id, query) against spans at once.

    Spans are reduced to their distinct texts, which are matched; the spans with
    their coordinates join the result. A phrase matches spans that hold it.
    """
    texts = spans.select(F.lower("text").alias("word")).distinct()
    # written out, so that the size of the pairs is known when the spans are joined
    # and the spans stay in place if it is small
    pairs = settled(matched_texts(texts, queries, gram))
    return spans.withColumn("word", F.lower("text")).join(pairs, "word").drop("word")


def count_many(spans: DataFrame, queries: DataFrame, by: list[str], gram: int = 3) -> DataFrame:
    """Number of spans by query and the columns ``by``, without joining single spans."""
    texts = settled(spans.groupBy(*by, F.lower("text").alias("word")).agg(F.count("*").alias("_n")))
    pairs = matched_texts(texts.select("word").distinct(), queries, gram)
    return texts.join(pairs, "word").groupBy("query_id", *by).agg(F.sum("_n").alias("total_matches"))


def _grams(texts: pa.Array, sizes: list[int], needed: np.ndarray | None = None) -> pa.Array:
    """Different pieces of ``sizes`` bytes of each text, of them only the ``needed`` ones (ascending).

    A piece is a number: a one, then its bytes. All places of a batch are looked at together, some at a
    time, so a long text takes no more memory than short ones.
    """
    held = texts.cast(pa.binary())
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset:held.offset + len(held) + 1]
    raw = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends.astype(np.int64) - ends[0]
    if needed is not None:
        known = np.zeros(1 << 16, bool)  # rejects most pieces by a hash
        known[(needed * _MIX >> np.uint64(48)).astype(np.int64)] = True
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in sizes:
        for a in range(0, len(raw) - n + 1, _PLACES):
            part = raw[a:a + _PLACES + n - 1].astype(np.uint64)
            piece = np.ones(len(part) - n + 1, np.uint64)
            for k in range(n):
                piece = piece << np.uint64(8) | part[k:len(part) - n + 1 + k]
            at = np.arange(len(piece))
            if needed is not None:
                at = np.flatnonzero(known[(piece * _MIX >> np.uint64(48)).astype(np.int64)])
                piece = piece[at]
                some = needed[np.minimum(np.searchsorted(needed, piece), len(needed) - 1)] == piece
                at, piece = at[some], piece[some]
            row = np.searchsorted(ends, at + a, "right") - 1
            inside = at + a + n <= ends[row + 1]
            row, piece = row[inside], piece[inside]
            order = np.lexsort((piece, row))
            row, piece = row[order], piece[order]
            new = np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]))[:len(row)]
            rows.append(row[new])
            found.append(piece[new])
    row, piece = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((piece, row))
    row, piece = row[order], piece[order]
    new = np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]))[:len(row)]
    upto = np.searchsorted(row[new], np.arange(len(held) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(piece[new].view(np.int64)))


def _with_grams(rows: DataFrame, col: str, gram: int, needed: DataFrame | None = None) -> DataFrame:
    """``rows`` with each piece of ``gram`` bytes of a text, shorter texts with themselves; only those
    of ``needed`` (_gram), of any size, if given."""
    if needed is None:
        def cut(texts: pa.Array) -> pa.Array:
            out = [_grams(pa.array([t], pa.string()), [min(gram, len(t.encode()))])
                   for t in texts.to_pylist()]
            return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))
    else:
        # there are no more than 256**gram of them
        wanted = np.sort(needed.select("_gram").distinct().toPandas()["_gram"].to_numpy(np.int64))
        shared = rows.sparkSession.sparkContext.broadcast(wanted.astype(np.uint64))
        sizes = sorted({(int(w).bit_length() - 1) // 8 for w in wanted})

        def cut(texts: pa.Array) -> pa.Array:
            return _grams(texts, sizes, shared.value)

    # the outer form keeps the optimizer from cutting every text twice for a "not empty" filter
    return rows.withColumn("_grams", F.arrow_udf(cut, "array<bigint>")(col)).select(
        *rows.columns, F.explode_outer("_grams").alias("_gram")).where("_gram is not null")


def matched_texts(texts: DataFrame, queries: DataFrame, gram: int = 3) -> DataFrame:
    """Pairs (word, query_id) of the distinct texts that hold a query.

    Substring search becomes equi joins: a query is compared only with the texts
    that hold its rarest n-gram of bytes, so a common piece does not pair every text
    with every query. Queries shorter than n bytes use a piece of their own length. Of the
    pieces of a text only those that a query has leave it, first to be counted, then the rarest
    ones to be met; what is written are numbered texts.
    """
    gram = min(gram, 7)  # a piece is a number of 64 bits
    wanted = queries.select("query_id", clean_query(F.col("query")).alias("needle")).where(
        F.col("needle") != "")
    needle_grams = settled(_with_grams(wanted, "needle", gram))
    numbered = settled(texts.select("word", F.monotonically_increasing_id().alias("_text")))
    frequency = _with_grams(numbered, "word", gram, needle_grams).groupBy("_gram").agg(
        F.count("*").alias("_words"))
    # a query with a gram that no word has cannot match and may drop out here
    rarest = settled(needle_grams.join(frequency, "_gram").groupBy("query_id", "needle").agg(
        F.min_by("_gram", F.struct("_words", "_gram")).alias("_gram")))
    candidates = settled(_with_grams(numbered, "word", gram, rarest).select("_text", "_gram").join(
        rarest, "_gram").select("_text", "query_id", "needle"))
    return numbered.join(candidates, "_text").where(
        F.contains("word", F.col("needle"))).select("word", "query_id")


def counts(matches: DataFrame, by: list[str]) -> DataFrame:
    return matches.groupBy(*by).agg(F.count("*").alias("total_matches"))


def ordinals(matches: DataFrame, search: list[str], order: list[str]) -> DataFrame:
    """Number k of N of every match within one search of one document, with wrap-around.

    The groups are the matches of one document, whose text was one input row.
    """
    whole = Window.partitionBy(*search)
    along = whole.orderBy(*order)
    ends = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct(*order)
    return (
        matches.withColumns({
            "match_no": F.row_number().over(along),
            "match_count": F.count("*").over(whole),
            "_next": F.coalesce(F.lead(here).over(along), F.first(here).over(ends)),
            "_prev": F.coalesce(F.lag(here).over(along), F.last(here).over(ends)),
        })
        .withColumns({f"next_{c}": F.col(f"_next.{c}") for c in order})
        .withColumns({f"prev_{c}": F.col(f"_prev.{c}") for c in order})
        .drop("_next", "_prev")
    )


def filter_layers(layers: DataFrame, needle: str) -> DataFrame:
    return layers.where(F.contains(F.lower("layer"), F.lit(needle.lower())))
