"""Connected components of an edge table: forests within partitions, then alternating large and small stars between them.

Edges lie in as many partitions as their number asks for. Each partition reduces its own to stars of a forest, in one
pass and in bounded memory. One partition is then done; several go on with star rounds, which are a few joins and
aggregations of edges only: each node learns its least neighbour (a minimum, combined before the shuffle, so a hub
costs one value a task) and hands it to its neighbours. Rounds are cut with reliable checkpoints and end when one
changes nothing, after about the logarithm of the largest component's size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Edges of a partition; a bound of a task's memory (about 100 bytes an edge) that results don't depend on.
EDGES_PER_TASK = 500_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def local_stars(batches):
    """Edges of one partition as stars: every node but the least of its local component points at that."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top and p != x:
            parent[x] = top
            x = p
        return top

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            p, q = root(u), root(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    for at in range(0, len(nodes), 65_536):
        part = nodes[at : at + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) for every node of the undirected edges (long); component is the least node that can be reached.

    Loops and repeated edges are harmless; edges with a null end are left out; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e)
    parts = max(1, -(-e.count() // per_task))
    stars = lambda x: x.coalesce(parts).mapInArrow(local_stars, "u long, v long")
    e = cut(stars(e))
    seen = _digest(e) if parts > 1 else None
    while seen and seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = cut(e.coalesce(parts))
        now = _digest(e)
        if now == seen:
            break
        seen = now
    out = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").coalesce(parts)
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct().coalesce(parts))
