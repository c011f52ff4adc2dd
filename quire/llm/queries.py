"""Registered queries of the corpus operators and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import (alignment, exact, licences, lines, lm, ngram_join, packing, periodic, pieces,
                       quality, simhash, toxicity, warc)
from quire.llm.common import table
from quire.queries import tuned


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoded(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(table(spark, sf_dir, "documents"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated_runs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed",
                        F.sha2("clean_text", 256).alias("clean_sha256"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_notices(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("target_uri", "payload")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_documents(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("word_bpe_49k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned_tokens(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.planted(table(spark, sf_dir, "documents")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: tuned(f) for f in (op1_merge_dropout, op2_toxicity, op3_lm_scores, op4_line_quality, op5_line_runs,
                                   op6_licences, op7_exact_dedup, op8_warc, op9_simhash,
                                   op10_packing, op11_token_alignment, op12_periodic_runs,
                                   op13_ngram_join, pipeline)}

SQL = {
    "op5_line_runs": lines.SQL,
    "op8_warc": warc.SQL,
    "op4_line_quality": quality.SQL,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
               sha256(text) AS text_sha256
        FROM t JOIN g USING (text)""",
}
