"""Comparison queries over conversations, documents and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import compare as D, textlayer
from quire.queries.text import docs
from quire.sources.tables import spread, table


def token_counts(spark, sf):
    toks = X.diff_tokens(F.col("text"))
    return docs(spark, sf).select("doc_id", toks.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("t", "|")).alias("tokens_md5"))


def _versions(spark, sf):
    """Each document as version A and the next one as version B."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return (d.select(F.col("doc_id").alias("pair_id"), "text"),
            d.select((F.col("doc_id") - 1).alias("pair_id"), "text").where("pair_id >= 0"))


def _aligned(spark, sf):
    a, b = _versions(spark, sf)
    return D.align_pages(textlayer.page_texts(a, words_only=False),
                         textlayer.page_texts(b, words_only=False))


def aligned_pages(spark, sf):
    return _aligned(spark, sf).select(
        "pair_id", F.col("page_number").cast("bigint").alias("page_number"),
        F.md5("text_a").alias("md5_a"), F.md5("text_b").alias("md5_b"))


def changed_pages(spark, sf):
    a, b = _versions(spark, sf)
    return D.pages_with_differences(textlayer.page_texts(a, words_only=False),
                                    textlayer.page_texts(b, words_only=False))


def _turns(spark, sf):
    """Every turn of a conversation against the one before the last."""
    t = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    nxt = t.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("text_b"))
    return t.join(nxt, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("pair_id"), F.col("turn").alias("page_number"),
        F.col("text").alias("text_a"), "text_b")


def token_diff(spark, sf):
    return D.token_diff(_turns(spark, sf)).select(
        "pair_id", "page_number", F.col("run_no").cast("bigint").alias("run_no"), "op", "text")


def token_diff_summary(spark, sf):
    return D.diff_summary(D.token_diff(_turns(spark, sf)))


def document_diff_summary(spark, sf):
    return D.diff_summary(D.token_diff(_aligned(spark, sf)))


def diff_token_totals(spark, sf):
    """Tokens of either version as the diff accounts for them."""
    s = D.diff_summary(D.token_diff(_aligned(spark, sf)))
    return s.select("pair_id", F.col("page_number").cast("bigint").alias("page_number"),
                    (F.col("deletions") + F.col("unchanged")).alias("tokens_a"),
                    (F.col("additions") + F.col("unchanged")).alias("tokens_b"))


def line_diff(spark, sf):
    a, b = _versions(spark, sf)
    return D.line_diff(textlayer.lines(a), textlayer.lines(b))


def _grids(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_linestatus", "l_quantity")
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    lum = D.luminance(price % 256, F.floor(price / 256) % 256, F.col("l_quantity").cast("bigint"))
    cells = li.select(
        F.col("l_suppkey").alias("page_id"), F.col("l_linenumber").alias("x"),
        (F.col("l_partkey") % 40).cast("int").alias("y"), lum.alias("lum"), "l_linestatus")

    def side(status):
        return cells.where(F.col("l_linestatus") == status).select("page_id", "x", "y", "lum")

    return side("O"), side("F")


def grid_cells(spark, sf):
    return D.grid_cells(*_grids(spark, sf)).select(
        "page_id", "x", F.col("y").cast("bigint").alias("y"),
        F.col("lum_a").cast("bigint").alias("lum_a"),
        F.col("lum_b").cast("bigint").alias("lum_b"), "class")


def grid_diff(spark, sf):
    return D.grid_diff(D.grid_cells(*_grids(spark, sf)))


QUERIES = {f.__name__: f for f in (
    token_counts, aligned_pages, changed_pages, token_diff, token_diff_summary,
    document_diff_summary, diff_token_totals, line_diff, grid_cells, grid_diff)}

VERSIONS = r"""
cut AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS p FROM documents),
cut2 AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS p FROM cut),
l AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS line_no FROM cut2),
pg AS (SELECT doc_id, line_no // 48 + 1 AS page_number,
         string_agg(line, chr(10) ORDER BY line_no) AS t FROM l GROUP BY ALL
       UNION ALL SELECT doc_id, 1, '' FROM cut2 WHERE len(p) = 0),
a AS (SELECT doc_id AS pair_id, page_number, t FROM pg),
b AS (SELECT doc_id - 1 AS pair_id, page_number, t FROM pg WHERE doc_id > 0),
al AS (SELECT pair_id, page_number, coalesce(a.t, '') AS ta, coalesce(b.t, '') AS tb
       FROM a FULL JOIN b USING (pair_id, page_number))
"""

GRID = """
c AS (SELECT l_suppkey AS page_id, l_linenumber AS x, l_partkey % 40 AS y, l_linestatus,
  CAST(floor((p % 256 + CAST(floor(p / 256.0) AS BIGINT) % 256 + CAST(l_quantity AS BIGINT)) / 3.0)
       AS BIGINT) AS lum
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem)),
ga AS (SELECT page_id, x, y, max(lum) AS lum FROM c WHERE l_linestatus = 'O' GROUP BY 1, 2, 3),
gb AS (SELECT page_id, x, y, max(lum) AS lum FROM c WHERE l_linestatus = 'F' GROUP BY 1, 2, 3),
g AS (SELECT page_id, x, y, coalesce(ga.lum, 255) AS lum_a, coalesce(gb.lum, 255) AS lum_b
      FROM ga FULL JOIN gb USING (page_id, x, y)),
cells AS (SELECT *, CASE WHEN abs(lum_a - lum_b) <= 15 THEN 'same'
                         WHEN lum_a < lum_b THEN 'removed' ELSE 'added' END AS class FROM g)
"""

SQL = {
    "token_counts": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '\s+|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS t
           FROM documents)
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5 FROM t""",
    "aligned_pages": f"""WITH {VERSIONS}
SELECT pair_id, page_number, md5(ta) AS md5_a, md5(tb) AS md5_b FROM al""",
    "changed_pages": f"""WITH {VERSIONS}
SELECT pair_id, count(*) FILTER (ta <> tb) AS pages_changed, count(*) AS pages_total
FROM al GROUP BY 1""",
    "diff_token_totals": rf"""WITH {VERSIONS}
SELECT pair_id, page_number, len(regexp_extract_all(ta, '\s+|[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS tokens_a,
       len(regexp_extract_all(tb, '\s+|[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS tokens_b
FROM al WHERE ta <> '' OR tb <> ''""",
    "line_diff": f"""WITH {VERSIONS},
n AS (SELECT pair_id, line, sum(a) AS a, sum(b) AS b FROM (
  SELECT doc_id AS pair_id, line, 1 AS a, 0 AS b FROM l
  UNION ALL SELECT doc_id - 1, line, 0, 1 FROM l WHERE doc_id > 0) GROUP BY 1, 2)
SELECT pair_id, line, 'equal' AS op, CAST(least(a, b) AS BIGINT) AS n FROM n WHERE least(a, b) > 0
UNION ALL SELECT pair_id, line, 'delete', CAST(a - b AS BIGINT) FROM n WHERE a > b
UNION ALL SELECT pair_id, line, 'insert', CAST(b - a AS BIGINT) FROM n WHERE b > a""",
    "grid_cells": f"WITH {GRID} SELECT page_id, x, y, lum_a, lum_b, class FROM cells",
    "grid_diff": f"""WITH {GRID},
n AS (SELECT page_id, count(*) FILTER (class = 'removed') AS removed,
        count(*) FILTER (class = 'added') AS added,
        CAST(max(x) + 1 AS BIGINT) * CAST(max(y) + 1 AS BIGINT) AS total_cells FROM cells GROUP BY 1)
SELECT *, (removed + added) / total_cells AS diff_ratio, removed + added > 50 AS has_differences FROM n""",
}
