"""Queries of the corpus operators, as (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(3, 1)))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeated

    out = remove_repeated(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=80)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    out = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "block_log_odds")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces
    from .shared import cut

    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=1)
    digests = cut(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return pack(digests, size=2048)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    from .langid import held_out

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label")))
    out = quality.score(docs.select("doc_id", "text"), model, threshold=0.3)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sizes

    return mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), limit=1024)


_ALL = (op1_language_id, op2_substring_dedup, op3_jaccard_join, op4_url_filter, op5_packing, op6_quality_classifier, op7_vector_dedup, op8_quality_rules, op9_mixing, op10_token_counts)
QUERIES = {f.__name__: f for f in _ALL}
