"""The thin queries ``opN_<name>``: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm import collocations, embedding_dedup, fingerprints, html_text, jaccard_join, line_dedup, mixing, nearest, substring_dedup, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelspark.llm import toxicity

    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _read(spark, sf_dir, "labels")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.mark_repeats(_read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from voxelspark.llm.sentencepieces import encode

    return encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_read(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takings(_read(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return line_dedup.dedup_lines(docs, counts=True).select("doc_id", "text", "n_lines", "n_removed")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from voxelspark.llm.token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(_read(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_read(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embedding_dedup, op3_substring_dedup, op4_sentencepiece, op5_nearest_neighbours, op6_source_mixing, op7_token_counts, op8_html_text, op9_line_dedup, op10_ngram_jaccard, op11_fingerprints, op12_phrase_collocations, op13_embedding_whitening)}
ORACLE: dict[str, str] = {"op6_source_mixing": mixing.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op12_phrase_collocations": collocations.ORACLE}
