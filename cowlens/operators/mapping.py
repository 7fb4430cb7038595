"""Address maps: one entry a guest cluster, resolution, layers, versions.

All lookups are equi-joins on (image, cluster) keys; keep-one rules are aggregations of structs, which combine before
the shuffle, rather than windows that sort every duplicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTER = 65_536


def unique_entries(entries: DataFrame) -> DataFrame:
    """One entry for each (image_id, table_id, guest_cluster): the greatest by (host_cluster, kind, copied, qty)."""
    best = F.max(F.struct("host_cluster", "kind", "copied", "qty")).alias("e")
    return entries.groupBy("image_id", "table_id", "guest_cluster").agg(best).select("image_id", "table_id", "guest_cluster", "e.*")


def keep_by(entries: DataFrame, strategy: str) -> DataFrame:
    """Conflict resolution of entries that claim one guest cluster: 'first', 'newer' or 'safer'.

    first: least host offset; newer: greatest; safer: entries of a table (copied) before guesses, then first.
    """
    order = {
        "first": F.min(F.struct("host_cluster", "kind", "copied", "qty")),
        "newer": F.max(F.struct("host_cluster", "kind", "copied", "qty")),
        "safer": F.min(F.struct((~F.col("copied")).alias("guess"), "host_cluster", "kind", "copied", "qty")),
    }[strategy]
    kept = entries.groupBy("image_id", "table_id", "guest_cluster").agg(order.alias("e"), F.count("*").alias("claims"))
    return kept.select("image_id", "table_id", "guest_cluster", F.col("e.host_cluster").alias("host_cluster"), F.col("e.kind").alias("kind"), "claims")


def state_of(kind: Column) -> Column:
    """What a read of the entry does; a missing entry is unallocated."""
    return F.coalesce(F.when(kind == "standard", "allocated").when(kind == "unallocated", "unallocated").otherwise(kind), F.lit("unallocated"))


def resolve(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests (with image_id, table_id, guest_cluster) with state and host_cluster (null unless bytes are stored)."""
    e = entries.select("image_id", "table_id", "guest_cluster", "kind", F.col("host_cluster").alias("h"))
    r = requests.join(e, ["image_id", "table_id", "guest_cluster"], "left")
    stored = F.col("kind").isin("standard", "compressed")
    return r.withColumn("state", state_of(F.col("kind"))).withColumn("host_cluster", F.when(stored, F.col("h"))).drop("kind", "h")


def split_ranges(ranges: DataFrame, cluster: int = CLUSTER) -> DataFrame:
    """Byte ranges (offset_bytes, len) as one row for each cluster touched: guest_cluster, intra, piece_len."""
    x = ranges.withColumn("guest_cluster", F.explode(F.sequence(F.expr(f"offset_bytes div {cluster}"), F.expr(f"(offset_bytes + len - 1) div {cluster}"))))
    begin = F.greatest(F.col("offset_bytes"), F.col("guest_cluster") * cluster)
    end = F.least(F.col("offset_bytes") + F.col("len"), (F.col("guest_cluster") + 1) * cluster)
    return x.withColumn("intra", begin - F.col("guest_cluster") * cluster).withColumn("piece_len", end - begin)


def inside(ranges: DataFrame, virtual_size: int) -> DataFrame:
    """Adds ok: whether a range lies inside the image; sums that overflow do not."""
    return ranges.withColumn("ok", F.coalesce(F.try_add("offset_bytes", "len") <= virtual_size, F.lit(False)))


def layered(layers: DataFrame) -> DataFrame:
    """Nearest layer that holds each guest cluster (least depth; of one layer the greatest host)."""
    best = F.min(F.struct("depth", (-F.col("host_cluster")).alias("neg")))
    return layers.groupBy("guest_cluster").agg(best.alias("e")).select("guest_cluster", F.col("e.depth").alias("depth"), (-F.col("e.neg")).alias("host_cluster"))


def layer_statistics(layers: DataFrame) -> DataFrame:
    """Mappings found in each layer, and those that survive the merge."""
    found = layers.groupBy("depth").agg(F.count("*").alias("found"))
    left = layered(layers).groupBy("depth").agg(F.count("*").alias("surviving"))
    return found.join(left, "depth", "left").select("depth", "found", F.coalesce("surviving", F.lit(0)).alias("surviving"))


def commit(layers: DataFrame, overlay: int, base: int) -> DataFrame:
    """The base layer after its overlay is written down: the overlay's cluster where it has one."""
    return layered(layers.where(F.col("depth").isin(overlay, base))).select("guest_cluster", "host_cluster", F.when(F.col("depth") == overlay, "overlay").otherwise("base").alias("origin"))


def snapshot_list(entries: DataFrame) -> DataFrame:
    """Tables other than the active one (1): entries, stored clusters and virtual size in clusters."""
    s = entries.where("table_id <> 1")
    stored = F.col("kind").isin("standard", "compressed").cast("long")
    return s.groupBy("image_id", "table_id").agg(F.count("*").alias("entries"), F.sum(stored).alias("stored"), (F.max("guest_cluster") + 1).alias("size_clusters"))


def diff(entries: DataFrame, before: int, after: int) -> DataFrame:
    """Guest clusters whose entries differ between two tables of an image: added, removed or changed.

    One shuffle: both tables' rows meet in one aggregation, instead of a full outer join of two exchanges.
    """
    pick = lambda t: F.max(F.when(F.col("table_id") == t, F.struct("host_cluster", "kind")))
    x = entries.where(F.col("table_id").isin(before, after)).groupBy("image_id", "guest_cluster").agg(pick(before).alias("a"), pick(after).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return x.withColumn("change", change).where("change is not null").select("image_id", "guest_cluster", "change")


def apply_snapshot(entries: DataFrame, table_id: int) -> DataFrame:
    """Entries after the active table (1) is replaced by a snapshot's; the snapshot stays."""
    rest = entries.where("table_id <> 1")
    copy = entries.where(F.col("table_id") == table_id).withColumn("table_id", F.lit(1).cast("long"))
    return rest.unionByName(copy)


def freed_by_delete(entries: DataFrame, table_id: int) -> DataFrame:
    """Host clusters that only this snapshot references."""
    stored = entries.where(F.col("kind").isin("standard", "compressed"))
    own = F.bool_and(F.col("table_id") == table_id)
    return stored.groupBy("image_id", F.col("host_cluster").alias("cluster_idx")).agg(own.alias("own")).where("own").select("image_id", "cluster_idx")


def resize_guard(entries: DataFrame, clusters: int) -> DataFrame:
    """Whether an image may shrink to so many clusters: no snapshots, nothing stored beyond."""
    beyond = (F.col("table_id") == 1) & F.col("kind").isin("standard", "compressed") & (F.col("guest_cluster") >= clusters)
    x = entries.groupBy("image_id").agg(F.max((F.col("table_id") != 1).cast("int")).alias("has_snapshots"), F.sum(beyond.cast("long")).alias("beyond"))
    return x.select("image_id", (F.col("has_snapshots") == 1).alias("has_snapshots"), "beyond", ((F.col("has_snapshots") == 0) & (F.col("beyond") == 0)).alias("allowed"))


def ranked(rows: DataFrame, part: str, key: str, width: int = 4096, name: str = "rank") -> DataFrame:
    """0-based rank of distinct integer keys within part, without sorting a whole part in one task.

    Keys are cut into ranges of `width`; ranges are counted and summed up (a small table), rows ranked inside theirs.
    """
    from pyspark.sql import Window

    x = rows.withColumn("__r", F.expr(f"{key} div {width}"))
    before = Window.partitionBy(part).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(part, "__r").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy(part, "__r").orderBy(key)) - 1
    return x.withColumn("__i", inner).join(counts, [part, "__r"]).withColumn(name, (F.col("__base") + F.col("__i")).cast("long")).drop("__r", "__i", "__base")


def compact(entries: DataFrame) -> DataFrame:
    """Active entries that store bytes, renumbered in guest order from host cluster 0."""
    stored = entries.where(F.col("kind").isin("standard", "compressed") & (F.col("table_id") == 1))
    return ranked(stored, "image_id", "guest_cluster", name="new_host").select("image_id", "guest_cluster", "host_cluster", "new_host")


def runs(rows: DataFrame, part: list[str], key: str) -> DataFrame:
    """Runs of consecutive distinct keys (gaps and islands): start, length. part should bound a window's rows."""
    from pyspark.sql import Window

    island = F.col(key) - F.row_number().over(Window.partitionBy(*part).orderBy(key))
    return rows.withColumn("__g", island).groupBy(*part, "__g").agg(F.min(key).alias("start"), F.count("*").alias("length")).drop("__g")


def write_runs(entries: DataFrame, batch: int = 64) -> DataFrame:
    """Runs of non-zero stored clusters inside batches of 64, as the converter writes them."""
    stored = entries.where(F.col("kind").isin("standard", "compressed") & (F.col("table_id") == 1)).select("image_id", "guest_cluster").distinct()
    return runs(stored.withColumn("batch", F.expr(f"guest_cluster div {batch}")), ["image_id", "batch"], "guest_cluster").select("image_id", "start", "length")


def inferred_size(entries: DataFrame, header_clusters: int, limit_clusters: int) -> DataFrame:
    """Virtual size in clusters: the header's if it covers all entries and is sane, else what the entries need."""
    x = entries.groupBy("image_id").agg((F.max("guest_cluster") + 1).alias("needed"))
    sane = (F.lit(header_clusters) <= limit_clusters) & (F.lit(header_clusters) >= F.col("needed"))
    return x.select("image_id", "needed", F.when(sane, F.lit(header_clusters)).otherwise(F.least("needed", F.lit(limit_clusters))).cast("long").alias("size_clusters"))
