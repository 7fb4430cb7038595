"""Lenses: projections that give the relational test tables the shape of the domain tables.

Each lens exists twice, as a DataFrame and as SQL text of the same columns, so that the operators can be compared with an
independent engine. Metadata columns only; none carries bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLUSTER = 65_536

MAP = """
select l_suppkey % 4 as image_id, cast(l_linenumber as bigint) as table_id, l_orderkey as guest_cluster, l_partkey as host_cluster,
  case when l_returnflag = 'A' then 'standard' when l_returnflag = 'R' then 'compressed' when l_linestatus = 'O' then 'zero' else 'unallocated' end as kind,
  l_linestatus = 'O' as copied, cast(l_quantity as bigint) as qty
from lineitem"""
REF = "select p_partkey as cluster_idx, cast(p_size % 8 as bigint) as stored from part"
LAYER = "select cast(substr(o_orderpriority, 1, 1) as int) as depth, o_custkey as guest_cluster, o_orderkey as host_cluster from orders"
WRITE = "select event_id, user_id % 4 as image_id, event_id * 4096 + user_id * 16 as offset_bytes, 1 + cast(floor(abs(value) * 100) as bigint) as len, ts from events"
REGION = "select s_name as name, s_suppkey * 2 as start_cluster, s_suppkey * 2 + 1 + s_nationkey % 4 as end_cluster from supplier"
LINK = "select conv_id * 1000 + turn as node, case when turn > 0 then conv_id * 1000 + turn - 1 end as parent from conversations"
TEXT = "select doc_id as object_id, text as body from documents"
HEADER = "select o_orderkey as image_id, 7 + o_custkey % 16 as cluster_bits, o_orderkey % 9 as refcount_order, o_orderkey * 256 as l1_offset, o_custkey % 5 as version from orders"

SQL = {"l_map": MAP, "l_ref": REF, "l_layer": LAYER, "l_write": WRITE, "l_region": REGION, "l_link": LINK, "l_text": TEXT, "l_header": HEADER}
TABLE = {"l_map": "lineitem", "l_ref": "part", "l_layer": "orders", "l_write": "events", "l_region": "supplier", "l_link": "conversations", "l_text": "documents", "l_header": "orders"}


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lens over the Parquet table in sf_dir. Column pruning reaches the scan, since it is a projection only."""
    table = TABLE[name]
    return spark.sql(SQL[name].replace(f"from {table}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_lenses(query: str) -> str:
    """SQL whose leading CTEs are the lenses it names."""
    used = [k for k in SQL if k in query or (k == "l_map" and "u_map" in query)]
    ctes = [f"{k} as ({SQL[k].strip()})" for k in used]
    if "u_map" in query:
        ctes.append(
            "u_map as (select image_id, table_id, guest_cluster, host_cluster, kind, copied, qty from (select *, row_number() over "
            "(partition by image_id, table_id, guest_cluster order by host_cluster desc, kind desc, copied desc, qty desc) as rn from l_map) where rn = 1)"
        )
    query = query.strip()
    recursive = query.lower().startswith("with recursive")
    if query.lower().startswith("with"):
        return ("with recursive " if recursive else "with ") + ", ".join([*ctes, query[len("with recursive" if recursive else "with") :].strip()])
    return (f"with {', '.join(ctes)} " if ctes else "") + query
