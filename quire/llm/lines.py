"""Repeated runs of lines by a suffix array, with DataFrame functions only.

The corpus is one sequence of line ids for each document. Prefix doubling ranks its suffixes by
their first 1, 2, 4, ... lines: the rank of a suffix is the number of suffixes that sort before its
group, and the ranks for twice as many lines come from the pairs (rank here, rank that many lines
further on). Suffixes alone in their group leave at once. Ranks are assigned by a distributed sort
of the distinct pairs and sums over its ranges, so that a group of any size is one row there.

A run counts from ``MIN_WORDS`` words on. Each line has a word, so a shortest such run has at most
MIN_WORDS lines, and ranks by that many lines suffice. Suffixes share a longest common prefix of d
lines if the ranks of both overlapping windows of the largest power of two within d are equal;
such an interval of the suffix array holds the copies of one run, and all but the first are
deleted. Runs that end as late, or begin as early, as they can are both looked at, which covers
every line of every longer repeated run.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.common import BROADCAST_ROWS, whole_text
from quire.plans.durable import settled

MIN_WORDS = 50


def filled_lines(text: Column) -> Column:
    """Lines with at least one word, in order."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def document_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], whole_text(docs))


def ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that occur more than once, and ``rank``: rows with smaller such keys."""
    groups = suffixes.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    ranges = settled(groups.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("range").agg(F.sum("n").alias("n")).select(  # one row a partition
        F.col("range").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (ranges.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(F.broadcast(offsets), F.col("range") == F.col("of"))
            .select(*keys, (F.col("offset") + F.col("below")).alias("rank")))


def suffix_ranks(docs: DataFrame, depth: int = MIN_WORDS) -> list[DataFrame]:
    """Ranks by 1, 2, 4, ... lines, up to the largest power of two within ``depth``.

    Every table has doc, line_no and rank of the suffixes whose group has more than one; the first
    also has position (the order of documents and lines) and words.
    """
    lines = docs.select("doc_id", document_key(docs).alias("doc"),
                        F.posexplode(filled_lines(whole_text(docs))).alias("line_no", "line"))
    lines = settled(lines.select(
        "doc_id", "doc", "line_no", F.xxhash64("line").alias("a"),
        F.xxhash64(F.lit(1), F.col("line")).alias("b"),
        F.least(F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(depth)).alias("words")))
    first = lines.join(ranked(lines, ["a", "b"]), ["a", "b"]).drop("a", "b")
    # rows equal in doc_id and text are one document
    first = first.dropDuplicates(["doc", "line_no"])
    first = first.repartitionByRange(F.col("doc_id").asc_nulls_last(), "doc", "line_no")
    first = first.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "doc", "line_no")
    levels = [settled(first.select("doc", "line_no", "rank", "words",
                                   F.monotonically_increasing_id().alias("position")))]
    reach = 1
    while 2 * reach <= depth:
        further = Window.partitionBy("doc").orderBy("line_no").rangeBetween(reach, reach)
        pairs = (levels[-1].select("doc", "line_no", F.col("rank").alias("here"),
                                   F.first("rank").over(further).alias("there"))
                 .filter("there is not null"))
        levels.append(settled(pairs.join(ranked(pairs, ["here", "there"]), ["here", "there"])
                              .select("doc", "line_no", "rank")))
        reach *= 2
    return levels


def _shortest(lines: Column, at: Column, step: int, words: int) -> Column:
    """Lines next to one another from ``at`` on until they have ``words`` words; null if fewer."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(-1).cast("long").alias("p"))

    def more(acc: Column, x: Column) -> Column:
        goes_on = (acc["sum"] < words) & (x["line_no"] == at + step * acc["n"])
        return F.when(goes_on, F.struct((acc["n"] + 1).alias("n"),
                                        (acc["sum"] + x["words"]).alias("sum"),
                                        x["position"].alias("p"))).otherwise(acc)

    return F.aggregate(lines, start, more, lambda acc: F.when(acc["sum"] >= words, acc))


def runs(first: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """Shortest runs of repeated lines with enough words, from and up to each line.

    doc, start, lines, position (of the first line).
    """
    of = Window.partitionBy("doc").orderBy("line_no")
    line = F.collect_list(F.struct("line_no", "words", "position"))
    ahead, behind = of.rangeBetween(0, words - 1), of.rangeBetween(1 - words, 0)
    both = first.select(
        "doc", "line_no", "position",
        _shortest(line.over(ahead), F.col("line_no"), 1, words).alias("on"),
        _shortest(F.reverse(line.over(behind)), F.col("line_no"), -1, words).alias("back"))
    forward = both.filter("on is not null").select(
        "doc", F.col("line_no").alias("start"), F.col("on.n").alias("lines"), "position")
    backward = both.filter("back is not null").select(
        "doc", (F.col("line_no") - F.col("back.n") + 1).alias("start"),
        F.col("back.n").alias("lines"), F.col("back.p").alias("position"))
    return settled(forward.unionAll(backward).dropDuplicates(["doc", "start", "lines"]))


def later_copies(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """doc, removed: numbers of the lines, among those with words, that repeat earlier runs."""
    levels = suffix_ranks(docs, words)
    found = runs(levels[0], words)
    ranks = functools.reduce(DataFrame.unionAll, [
        t.select(F.lit(k).alias("level"), F.col("doc").alias("d"), F.col("line_no").alias("l"),
                 "rank") for k, t in enumerate(levels)])
    level = F.floor(F.log2(F.col("lines") + F.lit(0.5))).cast("int")
    keyed = found.withColumn("level", level)
    for name, line in (("head", F.col("start")),
                       ("tail", F.col("start") + F.col("lines") -
                        F.pow(F.lit(2), F.col("level")).cast("int"))):
        at = ranks.select(F.col("level").alias("level_of"), "d", "l", F.col("rank").alias(name))
        keyed = keyed.join(at, (F.col("level") == F.col("level_of")) & (F.col("doc") == F.col("d"))
                           & (line == F.col("l"))).drop("level_of", "d", "l")
    keyed = settled(keyed)
    interval = ["lines", "head", "tail"]
    firsts = keyed.groupBy(*interval).agg(F.min("position").alias("first"),
                                          F.count("*").alias("n")).filter("n > 1")
    later = keyed.join(firsts, interval).filter("position <> first")
    spans = F.sequence(F.col("start"), F.col("start") + F.col("lines") - 1)
    # a document's own runs: at most two for each of its lines
    return later.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(
        F.collect_set(spans)))).alias("removed"))


def without_repeated_runs(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed, clean_text.

    A line with words goes if it lies in a run of neighbouring lines (blank ones do not count)
    that has at least ``words`` words and occurs earlier, in the order of doc_id (null last) and
    line. Copies may overlap: of a line that is repeated without end the beginning stays. Null and
    empty texts have no lines. Rows equal in doc_id and text are one document with one result. No
    rows give no rows; other columns, whatever their names, are not read. A removed line goes with
    its line feed.
    """
    gone = settled(later_copies(docs, words).withColumnRenamed("doc", "gone"))
    numbers = gone.agg(F.coalesce(F.sum(F.size("removed") + 2), F.lit(0))).first()[0]
    if numbers <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    rows = docs.select("doc_id", whole_text(docs).alias("text"), document_key(docs).alias("key"))
    rows = rows.join(gone, rows["key"] == gone["gone"], "left").select(
        "doc_id", "text", "removed", F.split("text", "\n", -1).alias("every"))
    # places of the lines with words, then of those that stay
    rows = rows.withColumn("filled", F.filter(
        F.transform("every", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)),
        lambda i: i.isNotNull()))
    places = F.array_except(F.sequence(F.lit(0), F.size("every") - 1),
                            F.transform("removed", lambda n: F.get("filled", n)))
    rest = F.array_join(F.transform(places, lambda i: F.get("every", i)), "\n")
    return rows.select(
        "doc_id", F.size("filled").cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("clean_text"))


SQL = rf"""
    WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    a AS (SELECT doc_id, i, lines[i] AS line,
                 len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS w
          FROM t, unnest(range(1, len(lines) + 1)) AS r(i)),
    f AS (SELECT doc_id, line, w, row_number() OVER d - 1 AS n, sum(w) OVER d AS upto
          FROM a WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    p AS (SELECT x.doc_id, x.n AS i, y.n AS j, y.upto - x.upto + x.w AS words
          FROM f x JOIN f y ON x.doc_id = y.doc_id AND y.n BETWEEN x.n AND x.n + {MIN_WORDS}
          WHERE y.upto - x.upto + x.w >= {MIN_WORDS}),
    runs AS (SELECT doc_id, i, min(j) AS j FROM p GROUP BY ALL
             UNION SELECT doc_id, max(i) AS i, j FROM p GROUP BY doc_id, j),
    texts AS (SELECT r.doc_id, r.i, r.j, string_agg(line, chr(10) ORDER BY n) AS run
              FROM runs r JOIN f ON f.doc_id = r.doc_id AND f.n BETWEEN r.i AND r.j
              GROUP BY ALL),
    firsts AS (SELECT run, min((doc_id, i)) AS first FROM texts GROUP BY run),
    gone AS (SELECT DISTINCT doc_id, n FROM texts JOIN firsts USING (run),
                    unnest(range(i, j + 1)) AS s(n) WHERE (doc_id, i) <> first),
    kept AS (SELECT a.doc_id, count(*) FILTER (a.w > 0 AND g.n IS NULL) AS stay,
                    string_agg(a.line, chr(10) ORDER BY a.i) FILTER (g.n IS NULL) AS text
             FROM a LEFT JOIN (SELECT doc_id, i, row_number() OVER (
                 PARTITION BY doc_id ORDER BY i) - 1 AS n FROM a WHERE w > 0) k
                 ON k.doc_id = a.doc_id AND k.i = a.i
             LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.n = k.n
             GROUP BY a.doc_id)
    SELECT t.doc_id, count(f.n) AS n_lines, count(g.n) AS n_removed,
           sha256(coalesce(any_value(k.text), '')) AS clean_sha256
    FROM t LEFT JOIN f ON f.doc_id = t.doc_id
    LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.n = f.n
    LEFT JOIN kept k ON k.doc_id = t.doc_id
    GROUP BY t.doc_id"""
