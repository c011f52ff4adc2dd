"""Search queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import search, textlayer
from quire.operators.gram_index import GramIndex
from quire.plans.durable import fresh_folder
from quire.queries.shared import LINES, words_of
from quire.queries.text import docs
from quire.sources.tables import spread, table

WORD = "the"
ORDER = ["line_no", "span_idx"]


def search_one(spark, sf):
    return search.search_text(docs(spark, sf).select("doc_id", "text"), "  ThE ").select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), "text", "x", "y",
        "width")


def search_page_counts(spark, sf):
    found = search.search_text(docs(spark, sf).select("doc_id", "text"), "tion")
    return search.counts(found, ["doc_id", "page_number"]).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), "total_matches")


def search_many_queries(spark, sf):
    """The first letters of every nation as queries over the words of all documents."""
    spans = textlayer.spans(textlayer.lines(docs(spark, sf).select("doc_id", "text")))
    queries = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.substring("n_name", 1, 3).alias("query"))
    return search.count_many(spans, queries, ["doc_id"]).select(
        F.col("query_id").cast("bigint").alias("query_id"), "doc_id", "total_matches")


def search_benchmark_words(spark, sf):
    """First word of every benchmark item as a query."""
    spans = textlayer.spans(textlayer.lines(docs(spark, sf).select("doc_id", "text")))
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.split("text", " ")[0].alias("query"))
    return search.count_many(spans, queries, [])


def search_phrases(spark, sf):
    """First two words of the benchmark items as queries over whole lines."""
    spans = textlayer.lines(docs(spark, sf).select("doc_id", "text")).select(
        "doc_id", "line_no", F.col("line").alias("text"))
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
        .alias("query"))
    return search.search_many(spans, queries).select(
        "query_id", "doc_id", F.col("line_no").cast("bigint").alias("line_no"))


def search_indexed(spark, sf):
    """Names of nations and parts' types as words, whole benchmark items as phrases, from an index
    that the documents were added to in two rounds."""
    # not spread: the fewer tasks, the longer the blocks of the index
    d = table(spark, sf, "documents").select("doc_id", "text")
    index = GramIndex(spark, fresh_folder(spark, "index"))
    for batch in (0, 1):
        index.add(d.where(F.col("doc_id") % 2 == batch), batch)
    queries = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item "), "item_id").alias("query_id"), F.col("text").alias("query")).unionByName(
        table(spark, sf, "nation").select(F.concat(F.lit("nation "), "n_nationkey"), F.col("n_name"))
        .toDF("query_id", "query")).unionByName(
        table(spark, sf, "documents").select("source", "lang").distinct().select(
            F.concat(F.lit("lang "), "lang", F.lit(" "), "source").alias("query_id"),
            F.concat("lang", F.lit("t")).alias("query")))
    return index.search(queries).groupBy("query_id", "doc_id").agg(
        F.count("*").alias("matches"), F.min("position").cast("bigint").alias("first"))


def search_ordinals(spark, sf):
    found = search.search_text(docs(spark, sf).select("doc_id", "text"), "ing")
    numbered = search.ordinals(found, ["doc_id"], ORDER)
    return numbered.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in
                    ("line_no", "span_idx", "match_no", "match_count", "next_line_no",
                     "next_span_idx", "prev_line_no", "prev_span_idx")])


QUERIES = {f.__name__: f for f in (
    search_one, search_page_counts, search_many_queries, search_benchmark_words, search_phrases,
    search_indexed, search_ordinals)}

_W = f"WITH {LINES}, {words_of('lines')}"

SQL = {
    "search_one": f"""{_W}
SELECT doc_id, line_no // 48 + 1 AS page_number, word AS text,
       CAST(50 + 6 * start_at AS DOUBLE) AS x, CAST(32 + 15 * (line_no % 48) AS DOUBLE) AS y,
       CAST(6 * length(word) AS DOUBLE) AS width
FROM words WHERE contains(lower(word), 'the')""",
    "search_page_counts": f"""{_W}
SELECT doc_id, line_no // 48 + 1 AS page_number, count(*) AS total_matches
FROM words WHERE contains(lower(word), 'tion') GROUP BY 1, 2""",
    "search_many_queries": f"""{_W},
q AS (SELECT n_nationkey AS query_id, lower(substr(n_name, 1, 3)) AS q FROM nation)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, count(*) AS total_matches
FROM words JOIN q ON contains(lower(word), q) GROUP BY 1, 2""",
    "search_benchmark_words": f"""{_W},
v AS (SELECT lower(word) AS word, count(*) AS n FROM words GROUP BY 1),
q AS (SELECT item_id AS query_id, lower(split_part(text, ' ', 1)) AS q FROM benchmark)
SELECT query_id, CAST(sum(n) AS BIGINT) AS total_matches
FROM v JOIN q ON contains(word, q) GROUP BY 1""",
    "search_phrases": f"""WITH {LINES},
q AS (SELECT item_id AS query_id, lower(trim(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2))) AS q
  FROM benchmark)
SELECT query_id, doc_id, line_no FROM lines JOIN q ON contains(lower(line), q)""",
    "search_indexed": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\f\r\x0B]+'), lambda x: x <> '') AS ws
  FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
v AS (SELECT DISTINCT word FROM p),
q AS (
  SELECT 'item ' || item_id AS query_id, text AS query FROM benchmark
  UNION ALL SELECT 'nation ' || n_nationkey, n_name FROM nation
  UNION ALL SELECT DISTINCT 'lang ' || lang || ' ' || source, lang || 't' FROM documents),
t AS (SELECT query_id, list_filter(string_split_regex(lower(query), '[ \t\n\f\r\x0B]+'), lambda x: x <> '') AS qs
      FROM q),
k AS (SELECT query_id, len(qs) AS n, unnest(qs) AS needle, unnest(range(len(qs))) AS k FROM t),
m AS (
  SELECT query_id, n, k, word FROM k JOIN v ON word = needle WHERE k > 0 AND k < n - 1
  UNION ALL SELECT query_id, n, k, word FROM (SELECT * FROM k WHERE k = 0 OR k = n - 1) k JOIN v
    ON CASE WHEN n = 1 THEN contains(word, needle) WHEN k = 0 THEN ends_with(word, needle)
            ELSE starts_with(word, needle) END),
h AS (SELECT query_id, doc_id, pos - k AS pos FROM m JOIN p USING (word)
      GROUP BY query_id, doc_id, pos - k, n HAVING count(DISTINCT k) = n)
SELECT query_id, doc_id, count(*) AS matches, min(pos) AS first FROM h GROUP BY ALL""",
    "search_ordinals": f"""{_W},
m AS (SELECT doc_id, line_no, idx FROM words WHERE contains(lower(word), 'ing'))
SELECT doc_id, line_no, idx AS span_idx, row_number() OVER o AS match_no,
  count(*) OVER (PARTITION BY doc_id) AS match_count,
  coalesce(lead(line_no) OVER o, first_value(line_no) OVER e) AS next_line_no,
  coalesce(lead(idx) OVER o, first_value(idx) OVER e) AS next_span_idx,
  coalesce(lag(line_no) OVER o, last_value(line_no) OVER e) AS prev_line_no,
  coalesce(lag(idx) OVER o, last_value(idx) OVER e) AS prev_span_idx
FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY line_no, idx),
  e AS (PARTITION BY doc_id ORDER BY line_no, idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
}
