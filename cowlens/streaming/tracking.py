"""Incremental behaviour as Structured Streaming: dirty tracking, hash on write, append-only writer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import dirty


def stream_of(df_path: str, spark, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream of writes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(df_path)


def dirty_granules(writes: DataFrame, granularity: int, late: str | None = "1 hour") -> DataFrame:
    """(image_id, bit_no, ts) of granules when first touched. writes: image_id, offset_bytes, len, ts (a timestamp).

    With a lateness, granules are told once for each watermark's span, which bounds the state; without, once for all.
    """
    bits = F.sequence(F.expr(f"offset_bytes div {granularity}"), F.expr(f"(offset_bytes + len - 1) div {granularity}"))
    x = writes.where("len > 0")
    if late is None:
        return x.select("image_id", F.explode(bits).alias("bit_no")).dropDuplicates(["image_id", "bit_no"])
    x = x.withWatermark("ts", late).select("image_id", "ts", F.explode(bits).alias("bit_no"))
    return x.dropDuplicatesWithinWatermark(["image_id", "bit_no"])


def dirty_windows(writes: DataFrame, granularity: int, window: str, late: str) -> DataFrame:
    """Granules touched and bytes written in tumbling windows of event time; late writes beyond the watermark are left out."""
    bits = F.expr(f"(offset_bytes + len - 1) div {granularity} - offset_bytes div {granularity} + 1")
    w = writes.where("len > 0").withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "image_id")
    return w.agg(F.sum(bits).alias("granules"), F.sum("len").alias("bytes_written")).select(F.col("w.start").alias("start"), "image_id", "granules", "bytes_written")


def hash_on_write(writes: DataFrame, chunk: int, rehash: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch's distinct touched chunks to `rehash`; every batch is final once its checkpoint is written."""

    def batch(df: DataFrame, _: int) -> None:
        rehash(dirty.touched(df, chunk).withColumnRenamed("bit_no", "chunk_idx").distinct())

    return writes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_blocks(writes: DataFrame, folder: str, checkpoint: str, cluster: int) -> StreamingQuery:
    """Append-only writer: blocks (image_id, guest_cluster, bytes, and seq if there is one) land as Parquet; zero blocks are
    left out, but for a flag that they were written.

    A batch that is tried again overwrites its own folder, so results are exactly once; finalize() lays them out.
    """

    def batch(df: DataFrame, n: int) -> None:
        empty = F.rtrim(F.hex("bytes"), F.lit("0")) == ""
        seq = F.col("seq") if "seq" in df.columns else F.lit(0)
        rows = df.select("image_id", "guest_cluster", F.when(~empty, F.rpad("bytes", cluster, F.lit(b"\0"))).alias("bytes"), seq.cast("long").alias("seq"))
        rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/batch={n:08d}")

    return writes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_writes(blocks: DataFrame, rewrite: str = "last") -> DataFrame:
    """image_id, guest_cluster, bytes (null: zeros) of each cluster's last write, by batch and seq. rewrite="error": a cluster
    that is written twice is an error, as for a writer that can't go back."""
    x = blocks.groupBy("image_id", "guest_cluster").agg(F.max_by("bytes", F.struct("batch", "seq")).alias("bytes"), F.count("*").alias("writes"))
    if rewrite == "error" and (twice := x.where("writes > 1").first()) is not None:
        raise ValueError(f"cluster {twice.guest_cluster} of {twice.image_id} is written {twice.writes} times")
    return x.drop("writes")


def finalize(blocks: DataFrame, rewrite: str = "last") -> DataFrame:
    """Address table without bytes: image_id, guest_cluster, host_cluster in guest order. Zero clusters have none."""
    from ..operators.mapping import ranked

    own = last_writes(blocks, rewrite).where("bytes is not null").select("image_id", "guest_cluster")
    return ranked(own, "image_id", "guest_cluster", name="host_cluster")


def finalize_image(blocks: DataFrame, path: str, virtual_size: int, cluster_bits: int = 16, packed: bool = False, rewrite: str = "last") -> int:
    """Ends the append-only writer: all metadata follow from the blocks of one image. Clusters of the file."""
    from ..sources import sinks

    guest = last_writes(blocks, rewrite).where("bytes is not null").select("guest_cluster", "bytes")
    host, total = sinks.assemble(guest, virtual_size, cluster_bits, packed)
    sinks.write_clusters(host, path, 1 << cluster_bits, total)
    return total
