"""Dirty bitmaps: granules touched by writes, regions, totals, merge and clear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping import ranked


def touched(writes: DataFrame, granularity: int) -> DataFrame:
    """(image_id, bit_no) of every granule a write touches; a write of no length touches none."""
    bits = F.sequence(F.expr(f"offset_bytes div {granularity}"), F.expr(f"(offset_bytes + len - 1) div {granularity}"))
    return writes.where("len > 0").select("image_id", F.explode(bits).alias("bit_no"))


def dirty_bits(writes: DataFrame, granularity: int) -> DataFrame:
    return touched(writes, granularity).distinct()


def regions(bits: DataFrame, granularity: int, virtual_size: int | None = None) -> DataFrame:
    """Runs of dirty granules as byte ranges (image_id, start_offset, end_offset); the last is clipped to the image."""
    x = ranked(bits.select("image_id", "bit_no"), "image_id", "bit_no", width=65_536)
    x = x.groupBy("image_id", (F.col("bit_no") - F.col("rank")).alias("g")).agg(F.min("bit_no").alias("lo"), F.max("bit_no").alias("hi"))
    end = (F.col("hi") + 1) * granularity
    return x.select("image_id", (F.col("lo") * granularity).alias("start_offset"), (end if virtual_size is None else F.least(end, F.lit(virtual_size))).alias("end_offset"))


def totals(region: DataFrame) -> DataFrame:
    return region.groupBy("image_id").agg(F.count("*").alias("n_regions"), F.sum(F.col("end_offset") - F.col("start_offset")).alias("dirty_bytes"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bitwise OR of two bitmaps of one granularity."""
    return a.select("bit_no").union(b.select("bit_no")).distinct()


def clear(bits: DataFrame, cleared: DataFrame) -> DataFrame:
    """Bits that stay when those of another set are cleared."""
    return bits.join(cleared.select("bit_no").distinct(), "bit_no", "left_anti")


def packed_counts(writes: DataFrame, granularity: int) -> DataFrame:
    """Dirty bits by bucket of 32,768, by packed bitmaps: 4 KiB a bucket and image, whatever the number of writes."""
    bit = F.col("bit_no") + 1  # the packed functions number from 1
    x = touched(writes, granularity).groupBy("image_id", F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    return x.select("image_id", (F.col("b") - 1).alias("bucket"), F.bitmap_count("bitmap").alias("bits"))
