"""Writes as new versions of the guest map: overlay on what the layers below hold, last write wins.

Full-cluster writes need no read; only clusters that are written in part join the base's bytes (chosen by a filter before
the join). A cluster's pieces are applied in order in one Arrow batch; their number is that of the writes to it since
the last version, so merge them in batches where a cluster is rewritten without end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pieces(writes: DataFrame, cluster: int) -> DataFrame:
    """Writes (image_id, offset_bytes, seq, data) cut at clusters: image_id, guest_cluster, seq, intra, data."""
    n = F.octet_length("data")
    x = writes.where(n > 0).withColumn("guest_cluster", F.explode(F.sequence(F.expr(f"offset_bytes div {cluster}"), F.expr(f"(offset_bytes + octet_length(data) - 1) div {cluster}"))))
    begin = F.greatest(F.col("offset_bytes"), F.col("guest_cluster") * cluster)
    end = F.least(F.col("offset_bytes") + n, (F.col("guest_cluster") + 1) * cluster)
    part = F.substring("data", (begin - F.col("offset_bytes") + 1).cast("int"), (end - begin).cast("int"))
    return x.select("image_id", "guest_cluster", "seq", (begin - F.col("guest_cluster") * cluster).cast("int").alias("intra"), part.alias("data"))


@F.pandas_udf(T.BinaryType())
def _overlay(base: pd.Series, size: pd.Series, parts: pd.Series) -> pd.Series:
    out = []
    for b, n, ps in zip(base, size, parts, strict=True):
        raw = bytearray(b) if b is not None else bytearray(n)
        for p in ps:
            raw[p["intra"] : p["intra"] + len(p["data"])] = p["data"]
        out.append(bytes(raw))
    return pd.Series(out)


def apply_writes(base: DataFrame, writes: DataFrame, cluster: int) -> DataFrame:
    """Written clusters after the writes: image_id, guest_cluster, bytes. base: the layered read, same columns."""
    parts = pieces(writes, cluster).groupBy("image_id", "guest_cluster").agg(F.sort_array(F.collect_list(F.struct("seq", "intra", "data"))).alias("parts"))
    whole = F.exists("parts", lambda p: F.octet_length(p["data"]) == cluster)
    full, part = parts.where(whole), parts.where(~whole)
    own = base.select("image_id", "guest_cluster", F.col("bytes").alias("base"))
    joined = part.join(own, ["image_id", "guest_cluster"], "left").unionByName(full.withColumn("base", F.lit(None).cast("binary")))
    return joined.select("image_id", "guest_cluster", _overlay("base", F.lit(cluster), "parts").alias("bytes"))


def new_version(base: DataFrame, written: DataFrame) -> DataFrame:
    """The guest map after the writes; what was not written stays."""
    rest = base.join(written.select("image_id", "guest_cluster"), ["image_id", "guest_cluster"], "left_anti")
    return rest.select("image_id", "guest_cluster", "bytes").unionByName(written)


def read_through(layers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nearest layer's cluster. layers: depth, guest_cluster, kind, others; sizes: depth, clusters (of each layer). The others
    may be bytes, or better what tells where they lie (host_offset), for read_clusters to read what is left.

    Unallocated entries ask the next layer; a zero entry hides what lies below; what a layer holds beyond its own size
    does not count.
    """
    x = layers.where("kind <> 'unallocated'").join(sizes, "depth").where("guest_cluster < clusters")
    near = x.groupBy("guest_cluster").agg(F.min("depth").alias("depth"))
    return x.join(near, ["guest_cluster", "depth"]).select("guest_cluster", "depth", "kind", *(c for c in layers.columns if c not in ("guest_cluster", "depth", "kind")))


def read_range(guest: DataFrame, offset: int, length: int, cluster: int) -> DataFrame:
    """Pieces of one byte range in order: piece, bytes. Clusters without a row read as zeros."""
    first, last = offset // cluster, (offset + max(length, 1) - 1) // cluster
    want = guest.sparkSession.range(first, last + 1).withColumnRenamed("id", "guest_cluster")
    x = want.join(guest.where(F.col("guest_cluster").between(first, last)).select("guest_cluster", "bytes"), "guest_cluster", "left")
    raw = F.coalesce("bytes", F.lit(bytes(cluster)))
    begin = F.greatest(F.lit(offset) - F.col("guest_cluster") * cluster, F.lit(0))
    end = F.least(F.lit(offset + length) - F.col("guest_cluster") * cluster, F.lit(cluster))
    return x.select((F.col("guest_cluster") - first).alias("piece"), F.substring(raw, (begin + 1).cast("int"), (end - begin).cast("int")).alias("bytes"))


def snapshot(entries: DataFrame, image: str, table_id: str, known: DataFrame) -> DataFrame:
    """Rows of a new snapshot of the active table; an empty or known name is an error. No bytes are copied."""
    if not table_id or not known.where((F.col("image_id") == image) & (F.col("table_id") == table_id)).isEmpty():
        raise ValueError(f"no or known name: {table_id!r}")
    return entries.where((F.col("image_id") == image) & (F.col("table_id") == "active")).withColumn("table_id", F.lit(table_id)).withColumn("copied", F.lit(False))


def find_snapshot(snaps: DataFrame, key: str) -> DataFrame:
    """By name first, then by id."""
    rank = F.when(F.col("name") == key, 0).when(F.col("id") == key, 1)
    return snaps.withColumn("rank", rank).where("rank is not null").orderBy("image_id", "rank", "snap_idx").limit(1).drop("rank")
