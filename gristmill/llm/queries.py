"""The queries of this package: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import languages, licenses, lines, neardup, packing, periods, quality, retrieval, spans, substrings, toxicity, vectors
from gristmill.llm.common import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table(sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(spark.read.parquet(table(sf_dir, "embeddings")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.scored(docs, quality.learn(docs, spark.read.parquet(table(sf_dir, "labels"))))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"))


def op5_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest_documents(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.learn(docs, spark.read.parquet(table(sf_dir, "labels"))))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeated_substrings(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(spark.read.parquet(table(sf_dir, "embeddings")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return periods.collapsed(_documents(spark, sf_dir), plant=True).select(*columns)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return languages.predicted(docs, languages.learn(docs))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(spark.read.parquet(table(sf_dir, "benchmark")), _documents(spark, sf_dir))


QUERIES = (
    op1_minhash_near_dedup, op2_nearest_neighbours, op3_quality, op4_best_fit_packing, op5_sentencepiece_spans, op6_toxicity, op7_substring_dedup, op8_license_scan,
    op9_embedding_near_dedup, op10_line_dedup, op11_periodic_runs, op12_language, op13_ranked_search,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
