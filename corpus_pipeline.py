"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, folder of tables) and returns documents with the columns it was given (the last one
returns pieces of packed sequences). Each works on all rows that its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cowlens.llm import jaccard, langid, mixing, packing, substring
from cowlens.llm.entries import tokenizer_path
from cowlens.llm.shared import checkpoint_folder, cut

#: How far a text's best language must be above an even spread over all languages, of the distance to certainty.
LEAST_MARGIN = 0.1


def aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns renamed that an operator's own would replace, and a function that gives docs' columns back."""
    names = []
    for c in docs.columns:
        new = c
        while new in taken or (new != c and new in docs.columns):
            new = "_" + new
        names.append(new)
    return docs.toDF(*names), lambda out: out.select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and those whose best language is hardly above an even spread."""
    model = langid.fit(docs.where(~langid.held_out(3, 1)))
    even = 1 / len(model.langs)
    own, back = aside(docs, "lang_pred", "score")
    out = langid.identify(own, model, with_text=True)
    return back(out.where((F.col("lang_pred") != "und") & (F.col("score") >= even + LEAST_MARGIN * (1 - even))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, that of the least doc_id (of repeats, the first). docs is a written table, so that
    its rows have the same numbers whenever they are read."""
    own, back = aside(docs, "row")
    numbered = own.select("*", F.monotonically_increasing_id().alias("row"))
    found = jaccard.near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    found = found.select(F.col("doc_id").alias("row"), "component_id").join(numbered.select("row", "doc_id"), "row")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    return back(numbered.join(first, "row", "left_semi"))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; texts of which nothing is left go. Others stay as they were."""
    own, back = aside(docs, "n_words", "n_removed", "kept_text", "block")
    out = substring.remove_repeated(own, width=35, carry=own.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.where(F.col("n_removed") < F.greatest("n_words", F.lit(1))).withColumn("text", text)
    if "n_chars" in own.columns:
        out = out.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    return back(out)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies."""
    own, back = aside(docs, *mixing.NEW, "copy")
    return back(mixing.mix(own).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    pieces = packing.token_pieces(docs, tokenizer_path(), size=2048, end_id=1)
    return packing.pack(cut(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")), size=2048)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_passages),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: A trained network, connected components and bin packing are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder in spark.checkpoint.dir and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
