"""A stored index of words and their pieces, for many searches over documents that are added to.

Two tables of increments. ``words`` holds the occurrences: a row has a word, the documents of a block
that hold it and the positions there. ``grams`` holds the words under each of their pieces of three
characters, a row for a piece and a block of words. Their files are sorted, so that a search reads
only the row groups of the pieces and the words that it asks for. A query of several words is a phrase: its first word ends a word of the text, its last one begins one, those
between are whole, and their positions follow each other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import text as X
from quire.plans.durable import owned, settled
from quire.plans.increments import Increments

GRAM = 3
#: values up to which a filter is written out, values of a range in it
WRITTEN, RANGE = 2000, 10
SPACES = " \t\n\f\r\x0b"
#: occurrences and words of a block; rows of a side that is sent to all tasks
OCCURRENCES, WORDS, SENT = 2_000_000, 100_000, 1_000_000


def _sent(rows: DataFrame) -> DataFrame:
    """Rows of a table that was written, with a hint to send them if they were counted and are few."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def one_of(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose value is among those of ``wanted`` (one column, distinct).

    Few values become a filter of short ranges, which the reader compares with the least and the
    largest value of its row groups; many are joined.
    """
    values = [r[0] for r in wanted.limit(WRITTEN + 1).collect()]
    if len(values) > WRITTEN:
        return rows.join(_sent(wanted.toDF(column)), column, "left_semi")
    values = sorted(values)
    parts = [F.col(column).isin(values[k:k + RANGE]) for k in range(0, len(values), RANGE)]
    return rows.where(reduce(or_, parts)) if parts else rows.limit(0)


def _pieces(rows: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """The rows once for each different piece of a word."""
    found = [F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in lengths]
    return rows.withColumn("gram", F.explode(F.array_distinct(F.concat(*found))))


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as word, first, doc_ids, positions: one row a word and block."""
    held: list[tuple[pa.Array, np.ndarray, pa.Array]] = []

    def block() -> pa.RecordBatch:
        parts = [*zip(*held)]
        ids, sizes = pa.concat_arrays(parts[0]), np.concatenate(parts[1])
        words = pa.concat_arrays(parts[2]).dictionary_encode()
        codes = words.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.concatenate([[0], np.bincount(codes, minlength=len(words.dictionary))]))
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = ids.take(pa.array(np.repeat(np.arange(len(ids)), sizes)[order]))
        offsets = pa.array(ends, pa.int32())
        return pa.record_batch(
            [words.dictionary, found.take(pa.array(ends[:-1])),
             pa.ListArray.from_arrays(offsets, found),
             pa.ListArray.from_arrays(offsets, pa.array(place[order], pa.int32()))],
            names=["word", "first", "doc_ids", "positions"])

    size = 0
    for batch in batches:
        bare = pc.utf8_trim(batch.column(1), characters=SPACES)
        words = pc.split_pattern_regex(pc.if_else(pc.equal(bare, ""), None, bare), f"[{SPACES}]+")
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        held.append((batch.column(0), sizes.astype(np.int64), words.flatten()))
        size += len(held[-1][2])
        if size >= OCCURRENCES:
            yield block()
            held, size = [], 0
    if size:
        yield block()


def _by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words as gram, first, n, words (a space between): one row a piece and block."""

    def block(words: list[str]) -> pa.RecordBatch:
        found = defaultdict(list)
        for w in words:
            for gram in {w[k:k + GRAM] for k in range(len(w) - GRAM + 1)}:
                found[gram].append(w)
        return pa.record_batch(
            [pa.array(found, pa.string()), pa.array([w[0] for w in found.values()], pa.string()),
             pa.array(map(len, found.values()), pa.int64()),
             pa.array(map(" ".join, found.values()), pa.string())],
            names=["gram", "first", "n", "words"])

    held: list[str] = []
    for batch in batches:
        held += batch.column(0).to_pylist()
        if len(held) >= WORDS:
            yield block(held)
            held = []
    if held:
        yield block(held)


class GramIndex:
    """The index below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.words = Increments(spark, f"{path}/words", order=["word", "first"])
        self.grams = Increments(spark, f"{path}/grams", order=["gram", "first"])

    def add(self, docs: DataFrame, batch: int) -> None:
        """Index documents (doc_id, text); a batch that was added before is not added again."""
        kind = docs.schema["doc_id"].dataType.simpleString()
        with owned(docs.sparkSession):  # what is written twice goes when the parts are there
            words = settled(docs.select("doc_id", F.lower("text")).mapInArrow(
                _by_word, f"word string, first {kind}, doc_ids array<{kind}>, positions array<int>"))
            self.words.add(words, batch)
            self.grams.add(words.select("word").distinct().mapInArrow(
                _by_gram, "gram string, first string, n long, words string"), batch)

    def occurrences(self, wanted: DataFrame) -> DataFrame:
        """word, doc_id, position of the words of ``wanted`` (one column, distinct)."""
        return one_of(self.words.read(), "word", wanted).select(
            "word", F.explode(F.arrays_zip("doc_ids", "positions")).alias("at")).select(
            "word", F.col("at.doc_ids").alias("doc_id"), F.col("at.positions").alias("position"))

    def _patterns(self, queries: DataFrame) -> DataFrame:
        """query_id, k, n, needle of the words of queries; blank queries have none."""
        words = F.filter(F.split(F.lower("query"), rf"[{X.WS}]+"), lambda w: w != "")
        return queries.select("query_id", words.alias("w")).select(
            "query_id", F.size("w").alias("n"), F.posexplode("w").alias("k", "needle"))

    def matched_words(self, patterns: DataFrame) -> DataFrame:
        """query_id, k, n, word: the words of the index that fit each word of each query.

        Inner words of a phrase are words themselves. For the others the words with their rarest
        piece are compared; needles shorter than a piece are met by both ends of all words.
        """
        inner = (F.col("k") > 0) & (F.col("k") < F.col("n") - 1)
        asked = settled(_pieces(patterns.where(~inner).select("needle").distinct(), "needle", [GRAM]))
        known = settled(one_of(self.grams.read(), "gram", asked.select("gram").distinct()))
        sizes = known.groupBy("gram").agg(F.sum("n").alias("size"))
        rarest = asked.join(sizes, "gram").groupBy("needle").agg(
            F.min_by("gram", F.struct("size", "gram")).alias("gram"))
        found = rarest.join(known, "gram").select("needle", F.explode(F.split("words", " ")).alias("word"))
        word, needle = F.col("word"), F.col("needle")
        fits: Column = F.when(F.col("n") == 1, F.lit(True)).when(
            F.col("k") == 0, F.endswith(word, needle)).otherwise(F.startswith(word, needle))
        outer = found.where(F.contains(word, needle)).join(
            _sent(settled(patterns.where(~inner))), "needle").where(fits)
        names = ["query_id", "k", "n", "word"]
        outer = outer.select(names)
        short = settled(patterns.where(~inner & (F.length("needle") < GRAM)).withColumn(
            "side", F.when(F.col("n") == 1, "any").when(F.col("k") == 0, "last").otherwise("first")))
        if not short.isEmpty():
            outer = outer.unionByName(self._short(short).select(names))
        return outer.distinct().unionByName(
            patterns.where(inner).withColumn("word", F.col("needle")).select(names))

    def _short(self, patterns: DataFrame) -> DataFrame:
        """Rows of ``patterns`` with the words that fit needles shorter than a piece."""
        words = self.words.read().select("word")
        edges = [F.struct(F.lit(side).alias("side"), F.substring("word", at, n).alias("needle"))
                 for n in range(1, GRAM) for side, at in (("first", 1), ("last", -n))]
        found = words.select("word", F.explode(F.array(*edges)).alias("edge")).select("word", "edge.*")
        alone = words.join(F.broadcast(patterns.where("side = 'any'")), F.contains("word", F.col("needle")))
        return found.join(_sent(patterns), ["side", "needle"]).unionByName(
            alone.select("side", "needle", "word", "query_id", "n", "k"))

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id, position of every match of queries (query_id, query).

        The position is that of the first word. A word of a query that the index lacks ends the
        query's search before any occurrence is read. Of a phrase the occurrences of its rarest word
        are the candidates; the other words are read for them alone, in their documents.
        """
        patterns = settled(self._patterns(queries))
        matched = settled(self.matched_words(patterns))
        whole = matched.groupBy("query_id", "n").agg(F.count_distinct("k").alias("found")).where(
            "found = n").select("query_id")
        matched = settled(matched.join(whole, "query_id", "left_semi"))
        sizes = one_of(self.words.read(), "word", settled(matched.select("word").distinct())).groupBy(
            "word").agg(F.sum(F.size("positions")).alias("size"))
        places = matched.join(sizes, "word").groupBy("query_id", "n", "k").agg(
            F.sum("size").alias("size"))
        first = places.groupBy("query_id", "n").agg(
            F.min_by("k", F.struct("size", "k")).alias("rarest"), F.count("*").alias("found")).where(
            "found = n").select("query_id", "rarest")
        matched = settled(matched.join(first, "query_id"))
        at = ["query_id", "doc_id", "position"]

        def starts(rows: DataFrame) -> DataFrame:
            """Where the queries would begin by the occurrences of one word each."""
            found = self.occurrences(settled(rows.select("word").distinct()))
            return found.join(_sent(settled(rows)), "word").select(
                "query_id", "n", "doc_id", (F.col("position") - F.col("k")).alias("position"))

        candidates = settled(starts(matched.where("n > 1 and k = rarest")))
        asked = settled(matched.where("k <> rarest").select("query_id", "k", "word").join(
            candidates.select("query_id").distinct(), "query_id", "left_semi"))
        near = _sent(settled(candidates.select("doc_id").distinct()))
        read = self.occurrences(settled(asked.select("word").distinct())).join(
            near, "doc_id", "left_semi").withColumnRenamed("position", "place")
        more = candidates.join(asked.select("query_id", "k").distinct(), "query_id").select(
            *at, "k", (F.col("position") + F.col("k")).alias("place")).join(
            read, ["doc_id", "place"]).join(asked, ["query_id", "k", "word"], "left_semi")
        followed = more.groupBy(at).agg(F.count_distinct("k").alias("others"))
        phrases = candidates.join(followed, at).where("others = n - 1").select(at)
        return starts(matched.where("n = 1")).select(at).unionByName(phrases)
