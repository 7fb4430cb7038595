"""Backing chains: depth, paths and cycles, by recursive common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_DEPTH = 64


def depths(links: DataFrame) -> DataFrame:
    """(node, root, depth) by walking from the roots; links: node, parent (null for a root)."""
    sql = f"""
    with recursive walk(node, root, depth) as (
      select node, node, 0 from {{links}} where parent is null
      union all select l.node, w.root, w.depth + 1 from walk w join {{links}} l on l.parent = w.node where w.depth < {MAX_DEPTH})
    select node, root, cast(depth as bigint) as depth from walk"""
    return links.sparkSession.sql(sql, links=links)


def leaf_paths(links: DataFrame) -> DataFrame:
    """(leaf, path): nodes from each leaf to its root."""
    sql = f"""
    with recursive up(leaf, node, parent, path, depth) as (
      select l.node, l.node, l.parent, cast(l.node as string), 0 from {{links}} l left anti join {{links}} c on c.parent = l.node
      union all select u.leaf, l.node, l.parent, concat(u.path, '>', cast(l.node as string)), u.depth + 1
        from up u join {{links}} l on u.parent = l.node where u.depth < {MAX_DEPTH})
    select leaf, path from up where parent is null"""
    return links.sparkSession.sql(sql, links=links)


def cyclic(links: DataFrame) -> DataFrame:
    """Nodes that no root reaches within the depth limit: parts of cycles, behind cycles, or behind a missing parent."""
    return links.select("node").join(depths(links).select("node"), "node", "left_anti")
