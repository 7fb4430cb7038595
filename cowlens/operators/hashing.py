"""Chunk hashes: assembly, verification, export, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(texts: DataFrame, size: int = 4096) -> DataFrame:
    """(object_id, chunk_idx, chunk): slices of the body; an empty body has none."""
    n = F.ceil(F.length("body") / size).cast("int")
    x = texts.where(F.length("body") > 0).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    return x.select("object_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.substring("body", F.col("chunk_idx") * size + 1, F.lit(size)).alias("chunk"))


def hashed(chunk: DataFrame) -> DataFrame:
    return chunk.select("object_id", "chunk_idx", F.sha2("chunk", 256).alias("hash"))


def verify(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """(object_id, chunk_idx) whose stored hash differs, or whose data is gone; null stored hashes are skipped."""
    c = computed.select("object_id", "chunk_idx", F.col("hash").alias("actual"))
    x = stored.where("hash is not null").join(c, ["object_id", "chunk_idx"], "left")
    return x.where("actual is null or actual <> hash").select("object_id", "chunk_idx")


def export(objects: DataFrame, computed: DataFrame, first: int, last: int) -> DataFrame:
    """Chunks first..last of each object, with the hash and whether there is one."""
    x = objects.select("object_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("chunk_idx"))
    return x.join(computed, ["object_id", "chunk_idx"], "left").select("object_id", "chunk_idx", "hash", F.col("hash").isNotNull().alias("allocated"))


def duplicates(computed: DataFrame) -> DataFrame:
    """Hashes that several chunks share."""
    x = computed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("object_id").alias("first_object"))
    return x.where("copies > 1")
