"""Reference counts: what points where, comparison with stored counts, repair, overlaps, allocation, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLUSTER = 65_536


def extents(entries: DataFrame, cluster: int = CLUSTER) -> DataFrame:
    """A row for each host cluster that an entry's bytes touch; compressed ones may touch several."""
    stored = entries.where(F.col("kind").isin("standard", "compressed"))
    begin = F.expr(f"host_cluster * {cluster} + qty * 512")
    last = F.when(F.col("kind") == "standard", F.col("host_cluster")).otherwise(F.floor((begin + F.col("qty") * 2048 - 1) / cluster).cast("long"))
    return stored.withColumn("cluster_idx", F.explode(F.sequence("host_cluster", last)))


def references(entries: DataFrame) -> DataFrame:
    """(image_id, cluster_idx, refs): data, compressed extents and second-level tables. Counts combine before the shuffle."""
    data = extents(entries).select("image_id", "cluster_idx")
    tables = entries.select("image_id", (100_000 + F.col("table_id") * 1000 + F.expr("guest_cluster div 8192")).alias("cluster_idx"), "table_id").distinct().select("image_id", "cluster_idx")
    return data.unionByName(tables).groupBy("image_id", "cluster_idx").agg(F.count("*").alias("refs"))


def per_image(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Stored counts repeated for each image of the entries."""
    return stored.crossJoin(entries.select("image_id").distinct())


def _keys(table: DataFrame) -> list[str]:
    """Clusters are named within an image where the table carries images."""
    return [c for c in ("image_id", "cluster_idx") if c in table.columns]


def _expected(refs: DataFrame) -> DataFrame:
    return refs.select(*_keys(refs), F.col("refs").alias("expected"))


def compare(stored: DataFrame, refs: DataFrame, full: bool = False) -> DataFrame:
    """([image_id,] cluster_idx, stored, expected) where they differ. full: also clusters that have references but no stored count."""
    keys = _keys(refs)
    x = stored.join(_expected(refs), keys, "full" if full else "left")
    x = x.select(*keys, F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return x.where("stored <> expected")


def leaks(stored: DataFrame, refs: DataFrame) -> DataFrame:
    return compare(stored, refs).where("stored > expected")


def repair(stored: DataFrame, refs: DataFrame, leaks_only: bool = False) -> DataFrame:
    """New stored counts: all as expected, or only those lowered that are too high."""
    keys = _keys(refs)
    x = stored.join(_expected(refs), keys, "left" if leaks_only else "full")
    expected = F.coalesce("expected", F.lit(0))
    return x.select(*keys, (F.least("stored", expected) if leaks_only else expected).alias("refcount"))


def copied_flags(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """Entries whose COPIED flag is not what the reference count says (set if and only if it is 1)."""
    image = _keys(refs)[:-1]
    e = entries.where("kind = 'standard'").join(refs.select(*image, F.col("cluster_idx").alias("host_cluster"), "refs"), [*image, "host_cluster"], "left")
    e = e.withColumn("should", F.coalesce(F.col("refs") == 1, F.lit(False)))
    return e.where("copied <> should").select(*image, "table_id", "guest_cluster", "host_cluster", "copied", "should")


def crosscheck(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of each standard mapping against the stored count: correct, leaked, shared or unreadable."""
    x = entries.where("kind = 'standard'").join(stored.withColumnRenamed("cluster_idx", "host_cluster"), "host_cluster", "left")
    outcome = F.when(F.col("stored").isNull(), "unreadable").when(F.col("stored") == 0, "leaked").when(F.col("stored") == 1, "correct").otherwise("shared")
    return x.groupBy("image_id", outcome.alias("outcome")).agg(F.count("*").alias("mappings"))


def overlaps(regions: DataFrame) -> DataFrame:
    """(cluster_idx, region_a, region_b) for every cluster that two regions share.

    Regions become the clusters they cover, so the theta join turns into an equi-join that shuffles by cluster.
    """
    x = regions.select("name", "start_cluster", F.explode(F.sequence("start_cluster", F.col("end_cluster") - 1)).alias("cluster_idx"))
    a, b = (x.select("cluster_idx", F.col("name").alias(f"region_{k}"), F.col("start_cluster").alias(f"s_{k}")) for k in "ab")
    first = F.struct("s_a", "region_a") < F.struct("s_b", "region_b")
    return a.join(b, "cluster_idx").where(first).select("cluster_idx", "region_a", "region_b")


def free_tail(stored: DataFrame, cluster: int = CLUSTER) -> DataFrame:
    """Last cluster in use, clusters in all, and what truncating behind it saves."""
    x = stored.agg(F.max(F.when(F.col("stored") > 0, F.col("cluster_idx"))).alias("last_used"), (F.max("cluster_idx") + 1).alias("clusters"))
    return x.select("last_used", "clusters", ((F.col("clusters") - 1 - F.coalesce("last_used", F.lit(-1))) * cluster).alias("bytes_saved"))


def next_free(stored: DataFrame, hint: int = 0) -> DataFrame:
    return stored.where((F.col("stored") == 0) & (F.col("cluster_idx") >= hint)).agg(F.min("cluster_idx").alias("cluster_idx"))


def allocate(stored: DataFrame, n: int) -> DataFrame:
    """The first n free clusters with their ranks. The limit is a top-n of partial sorts; ranks need its n rows only."""
    free = stored.where("stored = 0").select("cluster_idx").orderBy("cluster_idx").limit(n)
    return free.withColumn("rank", F.row_number().over(Window.orderBy("cluster_idx")).cast("long"))


def orphans(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Clusters in use that no entry references; of each image if stored carries images."""
    keys = _keys(stored)
    used = extents(entries).select(*keys).distinct()
    return stored.where("stored > 0").select(*keys).join(used, keys, "left_anti")


def assign_orphans(orphan: DataFrame, entries: DataFrame, slots: int, grow: bool = True) -> DataFrame:
    """The k-th orphan takes the k-th free guest slot, of each image if the orphans carry images.

    There are `slots` slots, or as many as the entries and orphans of an image are if that is more, so no orphan is lost.
    grow=False: an image has `slots` slots and no more; orphans beyond the last free one get none.
    """
    from .mapping import ranked

    spark = orphan.sparkSession
    image = _keys(orphan)[:-1]
    taken = entries.select(*image, "guest_cluster").distinct()
    if grow:
        sizes = orphan.select(*image).unionByName(taken.select(*image)).groupBy(*image).agg(F.count("*").alias("n"))
        slots = max(slots, sizes.agg(F.max("n")).first()[0] or 0)
    every = spark.range(slots).select(F.col("id").alias("guest_cluster"))
    if image:
        every = every.crossJoin(orphan.select(*image).distinct())
    free = every.join(taken, [*image, "guest_cluster"], "left_anti")
    part = F.col("image_id") if image else F.lit(0)
    a = ranked(orphan.withColumn("all", part), "all", "cluster_idx")
    b = ranked(free.select("guest_cluster", part.alias("all")), "all", "guest_cluster")
    return a.join(b, ["all", "rank"]).select(*image, "cluster_idx", "guest_cluster")


def keep_best_tables(entries: DataFrame, known: DataFrame, per_table: int = 512) -> DataFrame:
    """Per image, the best candidate tables: score is how many entries hit known data; as many as the data needs."""
    t = entries.withColumn("l2", F.col("table_id") * 1_000_000 + F.expr(f"guest_cluster div {per_table}"))
    hit = known.where("stored > 0").select(F.col("cluster_idx").alias("host_cluster"), F.lit(1).alias("hit"))
    scored = t.join(hit, "host_cluster", "left").groupBy("image_id", "l2").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("score"), F.count("*").alias("entries"))
    need = scored.groupBy("image_id").agg(F.greatest(F.lit(1), F.ceil(F.sum("entries") / (2 * per_table))).cast("long").alias("k"))
    best = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "l2"))
    return scored.withColumn("rank", best).join(need, "image_id").where("rank <= k").select("image_id", "l2", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def plausibility(entries: DataFrame, stored: DataFrame, guest_limit: int) -> DataFrame:
    """Score of each table as a hypothesis. Per entry: +2 for a host cluster in range or -3, +3 for a count or -4, -5 for
    each further use of a host cluster, +1 for a guest cluster below the limit or -2; -1 for each range of consecutive
    guest and host clusters beyond the first."""
    image = [c for c in ("image_id",) if c in stored.columns]
    own = entries.where(F.col("kind").isin("standard", "compressed"))
    hosts = own.groupBy("image_id", "table_id", "host_cluster").agg(F.count("*").alias("uses"), F.sum(F.when(F.col("guest_cluster") < guest_limit, 1).otherwise(-2)).alias("guests"))
    x = hosts.join(stored.withColumnRenamed("cluster_idx", "host_cluster"), [*image, "host_cluster"], "left")
    points = F.when(F.col("stored").isNull(), -3).otherwise(2) + F.when(F.coalesce("stored", F.lit(0)) > 0, 3).otherwise(-4)
    score = x.groupBy("image_id", "table_id").agg(F.sum(points * F.col("uses") - 5 * (F.col("uses") - 1) + F.col("guests")).alias("score"))
    # an entry goes on with a range if the one before it has the host before; both meet in one key, without a sort
    at = own.select("image_id", "table_id", "guest_cluster", "host_cluster").distinct()
    met = at.withColumn("next", F.lit(0)).unionByName(at.select("image_id", "table_id", (F.col("guest_cluster") + 1).alias("guest_cluster"), (F.col("host_cluster") + 1).alias("host_cluster"), F.lit(1).alias("next")))
    begins = met.groupBy("image_id", "table_id", "guest_cluster", "host_cluster").agg((F.max("next") == 0).alias("begins"))
    ranges = begins.groupBy("image_id", "table_id").agg(F.count_if("begins").alias("ranges"))
    return score.join(ranges, ["image_id", "table_id"]).select("image_id", "table_id", (F.col("score") - F.greatest(F.col("ranges") - 1, F.lit(0))).cast("long").alias("score"))


def best_hypothesis(scores: DataFrame) -> DataFrame:
    """The best table of each image; the first of equals wins."""
    best = F.max(F.struct("score", (-F.col("table_id")).alias("neg")))
    return scores.groupBy("image_id").agg(best.alias("e")).select("image_id", (-F.col("e.neg")).alias("table_id"), F.col("e.score").alias("score"))


def header_violations(headers: DataFrame) -> DataFrame:
    """(image_id, rule) for each structural rule that a header breaks."""
    rules = {
        "version": ~F.col("version").isin(2, 3),
        "cluster_bits": ~F.col("cluster_bits").between(9, 21),
        "refcount_order": F.col("refcount_order") > 6,
        "l1_alignment": F.expr("l1_offset % shiftleft(1L, cast(least(cluster_bits, 40) as int)) <> 0"),
    }
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return headers.select("image_id", F.explode(broken).alias("rule"))
