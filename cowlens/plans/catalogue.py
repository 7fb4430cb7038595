"""Catalogue of the registered queries over the lenses, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import chains, dirty, hashing, integrity, mapping
from .lens import lens, with_lenses

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Lenses:
    """Lenses of one folder, by name; `u_map` has one entry for each guest cluster."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return mapping.unique_entries(self.l_map) if name == "u_map" else lens(self.spark, self.sf_dir, name)

    def image(self, n: int = 0) -> DataFrame:
        return self.u_map.where(F.col("image_id") == n)

    def refs(self, n: int = 0) -> DataFrame:
        return integrity.references(self.image(n)).select("cluster_idx", "refs")

    def all_refs(self) -> DataFrame:
        return integrity.references(self.u_map)

    def every_ref(self) -> DataFrame:
        return integrity.per_image(self.l_ref, self.u_map)


def query(sql: str | None = None):
    """Registers a function of Lenses as q_<name>, with its SQL."""

    def add(f):
        name = f"q_{f.__name__}"
        QUERIES[name] = lambda spark, sf_dir: f(Lenses(spark, sf_dir))
        if sql:
            ORACLES[name] = with_lenses(sql)
        return f

    return add


#: The reference counts of image 0, as further CTEs of an SQL text.
REFS = """
ext as (select image_id, table_id, guest_cluster, unnest(range(host_cluster, case when kind = 'standard' then host_cluster + 1
    else (host_cluster * 65536 + qty * 512 + qty * 2048 - 1) // 65536 + 1 end)) as cluster_idx from u_map where kind in ('standard', 'compressed')),
allrefs as (select image_id, cluster_idx, count(*) as refs from (select image_id, cluster_idx from ext union all
    select image_id, cluster_idx from (select distinct image_id, table_id, 100000 + table_id * 1000 + guest_cluster // 8192 as cluster_idx from u_map)) group by all),
refs as (select cluster_idx, refs from allrefs where image_id = 0)"""


@query("""select image_id, table_id, count(*) filter (where kind = 'standard') as n_standard, count(*) filter (where kind = 'compressed') as n_compressed,
  count(*) filter (where kind = 'zero') as n_zero, count(*) filter (where kind = 'unallocated') as n_unallocated from u_map group by image_id, table_id""")
def cluster_stats(x: Lenses) -> DataFrame:
    kinds = ("standard", "compressed", "zero", "unallocated")
    return x.u_map.groupBy("image_id", "table_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))


@query(f"with {REFS} select image_id, cluster_idx, refs from allrefs")
def reference_map(x: Lenses) -> DataFrame:
    return integrity.references(x.u_map)


@query(f"with {REFS} select s.cluster_idx, s.stored, coalesce(r.refs, 0) as expected from l_ref s left join refs r using (cluster_idx) where s.stored <> coalesce(r.refs, 0)")
def integrity_mismatch(x: Lenses) -> DataFrame:
    return integrity.compare(x.l_ref, x.refs())


@query(f"with {REFS} select cluster_idx, coalesce(s.stored, 0) as stored, coalesce(r.refs, 0) as expected from l_ref s full join refs r using (cluster_idx) where coalesce(s.stored, 0) <> coalesce(r.refs, 0)")
def integrity_full(x: Lenses) -> DataFrame:
    return integrity.compare(x.l_ref, x.refs(), full=True)


@query(f"with {REFS} select s.cluster_idx, s.stored, coalesce(r.refs, 0) as expected from l_ref s left join refs r using (cluster_idx) where s.stored > coalesce(r.refs, 0)")
def integrity_leaks(x: Lenses) -> DataFrame:
    return integrity.leaks(x.l_ref, x.refs())


@query(f"""with {REFS} select case when s.stored > coalesce(r.refs, 0) then 'leak' else 'mismatch' end as kind, count(*) as issues
  from l_ref s left join refs r using (cluster_idx) where s.stored <> coalesce(r.refs, 0) group by 1""")
def integrity_report(x: Lenses) -> DataFrame:
    kind = F.when(F.col("stored") > F.col("expected"), "leak").otherwise("mismatch")
    return integrity.compare(x.l_ref, x.refs()).groupBy(kind.alias("kind")).agg(F.count("*").alias("issues"))


@query(f"with {REFS} select cluster_idx, coalesce(r.refs, 0) as refcount from l_ref s full join refs r using (cluster_idx)")
def repair_refcounts(x: Lenses) -> DataFrame:
    return integrity.repair(x.l_ref, x.refs())


@query(f"with {REFS} select s.cluster_idx, least(s.stored, coalesce(r.refs, 0)) as refcount from l_ref s left join refs r using (cluster_idx)")
def repair_leaks_only(x: Lenses) -> DataFrame:
    return integrity.repair(x.l_ref, x.refs(), leaks_only=True)


@query(f"""with {REFS} select table_id, guest_cluster, host_cluster, copied, coalesce(r.refs = 1, false) as should from u_map u left join refs r on r.cluster_idx = u.host_cluster
  where image_id = 0 and kind = 'standard' and copied <> coalesce(r.refs = 1, false)""")
def copied_flags(x: Lenses) -> DataFrame:
    return integrity.copied_flags(x.image(), x.refs())


@query("""select image_id, case when stored is null then 'unreadable' when stored = 0 then 'leaked' when stored = 1 then 'correct' else 'shared' end as outcome, count(*) as mappings
  from u_map left join l_ref on cluster_idx = host_cluster where kind = 'standard' group by 1, 2""")
def refcount_crosscheck(x: Lenses) -> DataFrame:
    return integrity.crosscheck(x.u_map, x.l_ref)


@query("""select unnest(range(b.start_cluster, least(a.end_cluster, b.end_cluster))) as cluster_idx, a.name as region_a, b.name as region_b from l_region a join l_region b
  on (a.start_cluster < b.start_cluster or (a.start_cluster = b.start_cluster and a.name < b.name)) and b.start_cluster < a.end_cluster""")
def overlaps(x: Lenses) -> DataFrame:
    return integrity.overlaps(x.l_region)


@query("""select event_id, w.image_id, w.guest_cluster, case when kind in ('standard', 'compressed') then host_cluster else -1 end as host_cluster,
  coalesce(case when kind = 'standard' then 'allocated' else kind end, 'unallocated') as state
  from (select event_id, image_id, event_id * 7 % 20000 as guest_cluster from l_write) w left join u_map u on u.image_id = w.image_id and u.table_id = 1 and u.guest_cluster = w.guest_cluster""")
def resolve_point(x: Lenses) -> DataFrame:
    r = x.l_write.select("event_id", "image_id", F.lit(1).cast("long").alias("table_id"), (F.col("event_id") * 7 % 20_000).alias("guest_cluster"))
    return mapping.resolve(r, x.u_map).drop("table_id").withColumn("host_cluster", F.coalesce("host_cluster", F.lit(-1).cast("long")))


@query("""select event_id, w.guest_cluster, greatest(offset_bytes, w.guest_cluster * 65536) - w.guest_cluster * 65536 as intra,
  least(offset_bytes + len, (w.guest_cluster + 1) * 65536) - greatest(offset_bytes, w.guest_cluster * 65536) as piece_len,
  coalesce(case when kind = 'standard' then 'allocated' else kind end, 'unallocated') as state
  from (select *, unnest(range(offset_bytes // 65536, (offset_bytes + len - 1) // 65536 + 1)) as guest_cluster from l_write) w
  left join u_map u on u.image_id = w.image_id and u.table_id = 1 and u.guest_cluster = w.guest_cluster""")
def resolve_range(x: Lenses) -> DataFrame:
    pieces = mapping.split_ranges(x.l_write.withColumn("table_id", F.lit(1).cast("long")))
    return mapping.resolve(pieces, x.u_map).select("event_id", "guest_cluster", "intra", "piece_len", "state")


@query("select event_id, offset_bytes + len <= 33554432 as ok from l_write")
def bounds(x: Lenses) -> DataFrame:
    return mapping.inside(x.l_write, 33_554_432).select("event_id", "ok")


_LAYERED = "layered as (select guest_cluster, depth, host_cluster from (select *, row_number() over (partition by guest_cluster order by depth, host_cluster desc) as rn from l_layer) where rn = 1)"


@query(f"with {_LAYERED} select * from layered")
def layered_read(x: Lenses) -> DataFrame:
    return mapping.layered(x.l_layer)


@query(f"""with {_LAYERED} select depth, found, coalesce(surviving, 0) as surviving from (select depth, count(*) as found from l_layer group by depth)
  left join (select depth, count(*) as surviving from layered group by depth) using (depth)""")
def layer_stats(x: Lenses) -> DataFrame:
    return mapping.layer_statistics(x.l_layer)


@query("""select guest_cluster, host_cluster, case when depth = 1 then 'overlay' else 'base' end as origin from (select *, row_number() over
  (partition by guest_cluster order by depth, host_cluster desc) as rn from l_layer where depth in (1, 2)) where rn = 1""")
def commit(x: Lenses) -> DataFrame:
    return mapping.commit(x.l_layer, 1, 2)


@query("""select guest_cluster, depth, host_cluster from (select *, row_number() over (partition by guest_cluster order by depth, host_cluster desc) as rn
  from (select case when depth > 3 then depth - 1 else depth end as depth, guest_cluster, host_cluster from l_layer where depth <> 3)) where rn = 1""")
def rebase_depth(x: Lenses) -> DataFrame:
    moved = x.l_layer.where("depth <> 3").withColumn("depth", F.when(F.col("depth") > 3, F.col("depth") - 1).otherwise(F.col("depth")))
    return mapping.layered(moved)


_WALK = """with recursive walk(node, root, depth) as (select node, node, 0 from {links} where parent is null
  union all select l.node, w.root, w.depth + 1 from walk w join {links} l on l.parent = w.node where w.depth < 64)"""


@query(_WALK.format(links="l_link") + " select node, root, cast(depth as bigint) as depth from walk")
def chain_depth(x: Lenses) -> DataFrame:
    return chains.depths(x.l_link)


@query("""with recursive up(leaf, node, parent, path, depth) as (select l.node, l.node, l.parent, cast(l.node as varchar), 0 from l_link l where not exists (select 1 from l_link c where c.parent = l.node)
  union all select u.leaf, l.node, l.parent, u.path || '>' || cast(l.node as varchar), u.depth + 1 from up u join l_link l on u.parent = l.node where u.depth < 64)
  select leaf, path from up where parent is null""")
def chain_paths(x: Lenses) -> DataFrame:
    return chains.leaf_paths(x.l_link)


@query("""with recursive looped as (select node, case when node % 1000 = 0 and (node // 1000) % 5 = 0 then node + 1 else parent end as parent from l_link),
  walk(node, depth) as (select node, 0 from looped where parent is null union all select l.node, w.depth + 1 from walk w join looped l on l.parent = w.node where w.depth < 64)
  select node from looped where node not in (select node from walk)""")
def chain_cycle_guard(x: Lenses) -> DataFrame:
    first = (F.col("node") % 1000 == 0) & (F.expr("node div 1000") % 5 == 0)
    return chains.cyclic(x.l_link.withColumn("parent", F.when(first, F.col("node") + 1).otherwise(F.col("parent"))))


@query("""select image_id, table_id, count(*) as entries, cast(sum(case when kind in ('standard', 'compressed') then 1 else 0 end) as bigint) as stored,
  max(guest_cluster) + 1 as size_clusters from u_map where table_id <> 1 group by image_id, table_id""")
def snapshot_list(x: Lenses) -> DataFrame:
    return mapping.snapshot_list(x.u_map)


@query("""select image_id, guest_cluster, case when a.kind is null then 'added' when b.kind is null then 'removed' else 'changed' end as change
  from (select * from u_map where table_id = 1) a full join (select * from u_map where table_id = 2) b using (image_id, guest_cluster)
  where a.kind is null or b.kind is null or a.kind <> b.kind or a.host_cluster <> b.host_cluster""")
def snapshot_diff(x: Lenses) -> DataFrame:
    return mapping.diff(x.u_map, 1, 2)


@query("""select image_id, table_id, count(*) as entries, cast(sum(host_cluster) as bigint) as hosts from (select image_id, table_id, host_cluster from u_map where table_id <> 1
  union all select image_id, 1, host_cluster from u_map where table_id = 3) group by image_id, table_id""")
def snapshot_apply(x: Lenses) -> DataFrame:
    return mapping.apply_snapshot(x.u_map, 3).groupBy("image_id", "table_id").agg(F.count("*").alias("entries"), F.sum("host_cluster").alias("hosts"))


@query("""select image_id, host_cluster as cluster_idx from u_map where kind in ('standard', 'compressed') group by image_id, host_cluster having bool_and(table_id = 7)""")
def snapshot_delete_freed(x: Lenses) -> DataFrame:
    return mapping.freed_by_delete(x.u_map, 7)


@query("""select image_id, bool_or(table_id <> 1) as has_snapshots, cast(sum(case when table_id = 1 and kind in ('standard', 'compressed') and guest_cluster >= 5000 then 1 else 0 end) as bigint) as beyond,
  not bool_or(table_id <> 1) and sum(case when table_id = 1 and kind in ('standard', 'compressed') and guest_cluster >= 5000 then 1 else 0 end) = 0 as allowed from u_map group by image_id""")
def resize_guard(x: Lenses) -> DataFrame:
    return mapping.resize_guard(x.u_map, 5000)


@query("""select max(case when stored > 0 then cluster_idx end) as last_used, max(cluster_idx) + 1 as clusters,
  (max(cluster_idx) - coalesce(max(case when stored > 0 then cluster_idx end), -1)) * 65536 as bytes_saved from l_ref""")
def free_tail(x: Lenses) -> DataFrame:
    return integrity.free_tail(x.l_ref)


@query("select min(cluster_idx) as cluster_idx from l_ref where stored = 0 and cluster_idx >= 100")
def next_free_cluster(x: Lenses) -> DataFrame:
    return integrity.next_free(x.l_ref, 100)


@query("select cluster_idx, row_number() over (order by cluster_idx) as rank from (select cluster_idx from l_ref where stored = 0 order by cluster_idx limit 50)")
def alloc_rank(x: Lenses) -> DataFrame:
    return integrity.allocate(x.l_ref, 50)


_BITS = "bits as (select distinct image_id, unnest(range(offset_bytes // 65536, (offset_bytes + len - 1) // 65536 + 1)) as bit_no from l_write)"
_REGIONS = "regions as (select image_id, min(bit_no) * 65536 as start_offset, (max(bit_no) + 1) * 65536 as end_offset from (select *, bit_no - row_number() over (partition by image_id order by bit_no) as g from bits) group by image_id, g)"


@query(f"with {_BITS} select * from bits")
def dirty_bits(x: Lenses) -> DataFrame:
    return dirty.dirty_bits(x.l_write, 65_536)


@query(f"with {_BITS}, {_REGIONS} select * from regions")
def dirty_regions(x: Lenses) -> DataFrame:
    return dirty.regions(dirty.dirty_bits(x.l_write, 65_536), 65_536)


@query(f"with {_BITS}, {_REGIONS} select image_id, count(*) as n_regions, cast(sum(end_offset - start_offset) as bigint) as dirty_bytes from regions group by image_id")
def dirty_totals(x: Lenses) -> DataFrame:
    return dirty.totals(dirty.regions(dirty.dirty_bits(x.l_write, 65_536), 65_536))


@query(f"with {_BITS} select distinct bit_no from bits where image_id in (0, 1)")
def dirty_merge(x: Lenses) -> DataFrame:
    b = dirty.dirty_bits(x.l_write, 65_536)
    return dirty.merge(b.where("image_id = 0"), b.where("image_id = 1"))


@query(f"with {_BITS} select image_id, bit_no from bits where image_id = 0 and bit_no not in (select bit_no from bits where image_id = 1)")
def dirty_clear(x: Lenses) -> DataFrame:
    b = dirty.dirty_bits(x.l_write, 65_536)
    return dirty.clear(b.where("image_id = 0"), b.where("image_id = 1")).select("image_id", "bit_no")


@query(f"with {_BITS.replace('65536', '512')} select image_id, bit_no // 32768 as bucket, count(*) as bits from bits group by 1, 2")
def dirty_packed(x: Lenses) -> DataFrame:
    return dirty.packed_counts(x.l_write, 512)


_CHUNKS = "chunks as (select object_id, chunk_idx, substr(body, cast(chunk_idx * 4096 + 1 as int), 4096) as chunk from (select *, unnest(range(0, (length(body) + 4095) // 4096)) as chunk_idx from l_text))"


@query(f"with {_CHUNKS} select object_id, chunk_idx, sha256(chunk) as hash from chunks")
def hash_chunks(x: Lenses) -> DataFrame:
    return hashing.hashed(hashing.chunks(x.l_text))


@query(f"with {_CHUNKS} select object_id, chunk_idx from chunks where object_id % 7 = 0 and chunk_idx % 2 = 0 and object_id % 11 <> 10")
def hash_verify(x: Lenses) -> DataFrame:
    """Stored hashes are wrong for some chunks, and null for some objects, which are skipped."""
    c = hashing.chunks(x.l_text)
    bad = (F.col("object_id") % 7 == 0) & (F.col("chunk_idx") % 2 == 0)
    stored = F.sha2(F.when(bad, F.concat("chunk", F.lit("x"))).otherwise(F.col("chunk")), 256)
    return hashing.verify(c.select("object_id", "chunk_idx", F.when(F.col("object_id") % 11 != 10, stored).alias("hash")), hashing.hashed(c))


@query(f"with {_CHUNKS} select object_id, k as chunk_idx, sha256(chunk) as hash, chunk is not null as allocated from (select object_id, unnest(range(0, 3)) as k from l_text) o left join (select object_id, chunk_idx as k, chunk from chunks) using (object_id, k)")
def hash_export_range(x: Lenses) -> DataFrame:
    return hashing.export(x.l_text, hashing.hashed(hashing.chunks(x.l_text)), 0, 2)


@query(f"with {_CHUNKS} select sha256(chunk) as hash, count(*) as copies, min(object_id) as first_object from chunks group by 1 having count(*) > 1")
def hash_duplicates(x: Lenses) -> DataFrame:
    return hashing.duplicates(hashing.hashed(hashing.chunks(x.l_text)))


@query("""select image_id, min(guest_cluster) as start, count(*) as length from (select *, guest_cluster - row_number() over (partition by image_id, guest_cluster // 64 order by guest_cluster) as g
  from u_map where table_id = 1 and kind in ('standard', 'compressed')) group by image_id, guest_cluster // 64, g""")
def zero_skip_runs(x: Lenses) -> DataFrame:
    return mapping.write_runs(x.u_map)


@query("select image_id, guest_cluster, host_cluster, row_number() over (partition by image_id order by guest_cluster) - 1 as new_host from u_map where table_id = 1 and kind in ('standard', 'compressed')")
def compact(x: Lenses) -> DataFrame:
    return mapping.compact(x.u_map)


_MASKS = "masks as (select image_id, guest_cluster, host_cluster, (qty * 2654435761 + host_cluster * 97) % 4294967296 as alloc, (host_cluster * 40503 + guest_cluster * 7919) % 4294967296 as zero from u_map where table_id = 1)"
_STATES = "states as (select image_id, guest_cluster, i, case when (alloc >> i) & 1 = 1 and (zero >> i) & 1 = 1 then '!' when (alloc >> i) & 1 = 1 then 'A' when (zero >> i) & 1 = 1 then 'Z' else 'U' end as s from masks, (select unnest(range(0, 32)) as i))"


def _masks(x: Lenses) -> DataFrame:
    m = x.u_map.where("table_id = 1")
    return m.select("image_id", "guest_cluster", ((F.col("qty") * 2_654_435_761 + F.col("host_cluster") * 97) % (1 << 32)).alias("alloc"), ((F.col("host_cluster") * 40_503 + F.col("guest_cluster") * 7_919) % (1 << 32)).alias("zero"))


@query(f"with {_MASKS}, {_STATES} select image_id, guest_cluster, string_agg(s, '' order by i) as states, count(*) filter (where s = 'A') as n_alloc, count(*) filter (where s = '!') as n_invalid from states group by image_id, guest_cluster")
def subcluster_states(x: Lenses) -> DataFrame:
    a, z = F.col("alloc"), F.col("zero")
    return _masks(x).select("image_id", "guest_cluster", bits.state_map(a, z).alias("states"), F.bit_count(a.bitwiseAND(F.bitwise_not(z))).cast("long").alias("n_alloc"), F.bit_count(a.bitwiseAND(z)).cast("long").alias("n_invalid"))


_RANGES = """select image_id, table_id, guest_cluster, host_cluster * 2654435761 % 4294967296 as alloc, guest_cluster * 40503 % 4294967296 as zero, qty % 32 as first,
  least(32 - qty % 32, 1 + host_cluster % 8) as n from u_map"""


@query(f"""with m as ({_RANGES}), r as (select *, ((cast(1 as bigint) << n::int) - 1) << first::int as mask from m)
  select image_id, table_id, guest_cluster, alloc | mask as alloc_a, zero & ~mask as zero_a, alloc & ~mask as alloc_z, zero | mask as zero_z, alloc & ~mask as alloc_u, zero & ~mask as zero_u, (alloc & zero) = 0 as valid from r""")
def subcluster_set(x: Lenses) -> DataFrame:
    """A range of subclusters set to each state, and whether the word was valid before."""
    m = x.spark.sql(_RANGES.replace("from u_map", "from {u_map}"), u_map=x.u_map)
    out = [F.col("image_id"), F.col("table_id"), F.col("guest_cluster")]
    for state in "AZU":
        alloc, zero = bits.subcluster_range(F.col("alloc"), F.col("zero"), F.col("first"), F.col("n"), state)
        out += [alloc.alias(f"alloc_{state.lower()}"), zero.alias(f"zero_{state.lower()}")]
    return m.select(*out, bits.subclusters_valid(F.col("alloc"), F.col("zero")).alias("valid"))


@query(f"""with {_MASKS}, {_STATES} select image_id, guest_cluster, s as state, min(i) as first, max(i) as last from
  (select *, i - row_number() over (partition by image_id, guest_cluster, s order by i) as g from states) group by image_id, guest_cluster, s, g""")
def subcluster_ranges(x: Lenses) -> DataFrame:
    e = _masks(x).select("image_id", "guest_cluster", F.posexplode(F.split(bits.state_map(F.col("alloc"), F.col("zero")), "")).alias("i", "state")).where("i < 32")
    return mapping.runs(e.withColumn("i", F.col("i").cast("long")), ["image_id", "guest_cluster", "state"], "i").select("image_id", "guest_cluster", "state", F.col("start").alias("first"), (F.col("start") + F.col("length") - 1).alias("last"))


@query("select l1_offset, word & 18014398509481983 as host_offset, (((word >> 54) & 255) + 1) * 512 - (word & 511) as bytes from (select l1_offset, l1_offset * 1234567890123 % 4611686018427387904 as word from (select image_id * 256 as l1_offset from l_header))")
def descriptor_decode(x: Lenses) -> DataFrame:
    product = F.col("l1_offset").cast("decimal(19,0)") * F.lit(1_234_567_890_123).cast("decimal(13,0)")  # beyond 64 bits
    h = x.l_header.select("l1_offset", (product % F.lit(1 << 62).cast("decimal(19,0)")).cast("long").alias("word"))
    offset, size = bits.compressed_descriptor(F.col("word"), 16)
    return h.select("l1_offset", offset.alias("host_offset"), size.alias("bytes"))


@query(" union all ".join(f"select cluster_idx, {o} as refcount_order, ((cluster_idx * 2654435761 + stored) % 4294967296 >> {32 - (1 << o)}) & {(1 << (1 << o)) - 1} as first_count from l_ref" for o in range(6)))
def refcount_widths(x: Lenses) -> DataFrame:
    word = (F.col("cluster_idx") * 2_654_435_761 + F.col("stored")) % (1 << 32)
    counts = F.array(*(F.struct(F.lit(o).alias("refcount_order"), bits.refcount_in_word(word, o, 0).alias("first_count")) for o in range(6)))
    return x.l_ref.select("cluster_idx", F.inline(counts))


@query("""select object_id, case when length(body) = 0 then 'empty' when starts_with(body, 'QFI') then 'header' when length(body) < 100 then 'tail'
  when (length(body) - length(replace(body, ' ', ''))) * 100 > length(body) * 20 then 'sparse' else 'data' end as kind from l_text""")
def classify(x: Lenses) -> DataFrame:
    n, spaces = F.length("body"), F.length("body") - F.length(F.translate("body", " ", ""))
    kind = F.when(n == 0, "empty").when(F.startswith("body", F.lit("QFI")), "header").when(n < 100, "tail").when(spaces * 100 > n * 20, "sparse").otherwise("data")
    return x.l_text.select("object_id", kind.alias("kind"))


@query("""with scored as (select image_id, table_id * 1000000 + guest_cluster // 512 as l2, count(s.cluster_idx) as score, count(*) as entries from u_map
    left join (select cluster_idx from l_ref where stored > 0) s on s.cluster_idx = host_cluster group by 1, 2),
  need as (select image_id, greatest(1, cast(ceil(sum(entries) / 1024.0) as bigint)) as k from scored group by image_id)
  select image_id, l2, score, rank from (select *, row_number() over (partition by image_id order by score desc, l2) as rank from scored) join need using (image_id) where rank <= k""")
def l2_keep_best(x: Lenses) -> DataFrame:
    return integrity.keep_best_tables(x.u_map, x.l_ref)


_KEEP = """select image_id, table_id, guest_cluster, host_cluster, kind, claims from (select *, row_number() over (partition by image_id, table_id, guest_cluster order by {order}) as rn,
  count(*) over (partition by image_id, table_id, guest_cluster) as claims from l_map) where rn = 1"""


@query(_KEEP.format(order="host_cluster, kind, copied, qty"))
def conflicts_first(x: Lenses) -> DataFrame:
    return mapping.keep_by(x.l_map, "first")


@query(_KEEP.format(order="host_cluster desc, kind desc, copied desc, qty desc"))
def conflicts_newer(x: Lenses) -> DataFrame:
    return mapping.keep_by(x.l_map, "newer")


@query(_KEEP.format(order="copied desc, host_cluster, kind, qty"))
def conflicts_safer(x: Lenses) -> DataFrame:
    return mapping.keep_by(x.l_map, "safer")


_ORPHANS = f"{REFS}, orphans as (select cluster_idx from l_ref where stored > 0 and cluster_idx not in (select cluster_idx from ext where image_id = 0 and table_id = 1))"


@query(f"with {_ORPHANS} select * from orphans")
def orphans(x: Lenses) -> DataFrame:
    return integrity.orphans(x.l_ref, x.image().where("table_id = 1"))


@query(f"""with {_ORPHANS} select cluster_idx, guest_cluster from (select cluster_idx, row_number() over (order by cluster_idx) as rn from orphans) join
  (select g as guest_cluster, row_number() over (order by g) as rn from (select unnest(range(0, 20000)) as g) where g not in (select guest_cluster from u_map where image_id = 0 and table_id = 1)) using (rn)""")
def orphan_assign(x: Lenses) -> DataFrame:
    image = x.image().where("table_id = 1")
    return integrity.assign_orphans(integrity.orphans(x.l_ref, image), image, 20_000, grow=False)


#: Guest clusters of an image's virtual size, for the plausibility of an entry's place.
GUEST_LIMIT = 12_000
_SCORES = f"""own as (select * from u_map where kind in ('standard', 'compressed')),
  hosts as (select image_id, table_id, sum(((case when stored is null then -3 else 2 end) + (case when coalesce(stored, 0) > 0 then 3 else -4 end)) * uses - 5 * (uses - 1)) as points
    from (select image_id, table_id, host_cluster, count(*) as uses from own group by all) left join l_ref on cluster_idx = host_cluster group by image_id, table_id),
  guests as (select image_id, table_id, sum(case when guest_cluster < {GUEST_LIMIT} then 1 else -2 end) as points from own group by all),
  begun as (select o.image_id, o.table_id, count(*) as ranges from own o where not exists (select 1 from own p where p.image_id = o.image_id and p.table_id = o.table_id
    and p.guest_cluster = o.guest_cluster - 1 and p.host_cluster = o.host_cluster - 1) group by all),
  scores as (select image_id, table_id, cast(h.points + g.points - greatest(ranges - 1, 0) as bigint) as score from hosts h join guests g using (image_id, table_id) join begun using (image_id, table_id))"""


@query(f"with {_SCORES} select * from scores")
def plausibility(x: Lenses) -> DataFrame:
    return integrity.plausibility(x.u_map, x.l_ref, GUEST_LIMIT)


@query(f"with {_SCORES} select image_id, table_id, score from (select *, row_number() over (partition by image_id order by score desc, table_id) as rn from scores) where rn = 1")
def best_hypothesis(x: Lenses) -> DataFrame:
    return integrity.best_hypothesis(integrity.plausibility(x.u_map, x.l_ref, GUEST_LIMIT))


@query("select cluster_idx, stored from l_ref where cluster_idx % greatest(1, (select (count(*) + 255) // 256 from l_ref)) = 0")
def sample_systematic(x: Lenses) -> DataFrame:
    """The operator is a sample: every ceil(n / 256)-th cluster."""
    step = x.l_ref.agg(F.greatest(F.lit(1), F.expr("(count(*) + 255) div 256")).alias("step"))
    return x.l_ref.crossJoin(F.broadcast(step)).where("cluster_idx % step = 0").drop("step")


@query("select image_id, needed, case when 16000 <= 1048576 and 16000 >= needed then 16000 else least(needed, 1048576) end as size_clusters from (select image_id, max(guest_cluster) + 1 as needed from u_map group by image_id)")
def inferred_size(x: Lenses) -> DataFrame:
    return mapping.inferred_size(x.u_map, 16_000, 1_048_576)


@query("""select image_id, 'version' as rule from l_header where version not in (2, 3) union all select image_id, 'cluster_bits' from l_header where cluster_bits not between 9 and 21
  union all select image_id, 'refcount_order' from l_header where refcount_order > 6 union all select image_id, 'l1_alignment' from l_header where l1_offset % (cast(1 as bigint) << cast(least(cluster_bits, 40) as int)) <> 0""")
def header_violations(x: Lenses) -> DataFrame:
    return integrity.header_violations(x.l_header)


@query("select coalesce(max(try_cast(c_name as bigint)), 0) + 1 as next_id, count(*) as snapshots from (select cast(table_id as varchar) as c_name from u_map where table_id <> 1 and image_id = 0 group by table_id)")
def next_snapshot_id(x: Lenses) -> DataFrame:
    ids = x.image().where("table_id <> 1").select(F.col("table_id").cast("string").alias("id")).distinct()
    return ids.agg((F.coalesce(F.max(F.expr("try_cast(id as bigint)")), F.lit(0)) + 1).alias("next_id"), F.count("*").alias("snapshots"))


#: Stored counts for every image; the queries q_*_images check all images, those without the suffix image 0 as their SQL does.
_EVERY = f"{REFS}, every as (select * from l_ref cross join (select distinct image_id from u_map))"
_CHECKED = f"{_EVERY}, checked as (select image_id, cluster_idx, coalesce(s.stored, 0) as stored, coalesce(r.refs, 0) as expected, s.cluster_idx is not null as known from every s full join allrefs r using (image_id, cluster_idx))"
_LOST = f"{_EVERY}, lost as (select image_id, cluster_idx from every e where stored > 0 and not exists (select 1 from ext x where x.table_id = 1 and x.image_id = e.image_id and x.cluster_idx = e.cluster_idx))"


@query(f"with {_CHECKED} select image_id, cluster_idx, stored, expected from checked where known and stored <> expected")
def integrity_mismatch_images(x: Lenses) -> DataFrame:
    return integrity.compare(x.every_ref(), x.all_refs())


@query(f"with {_CHECKED} select image_id, cluster_idx, stored, expected from checked where stored <> expected")
def integrity_full_images(x: Lenses) -> DataFrame:
    return integrity.compare(x.every_ref(), x.all_refs(), full=True)


@query(f"with {_CHECKED} select image_id, cluster_idx, stored, expected from checked where known and stored > expected")
def integrity_leaks_images(x: Lenses) -> DataFrame:
    return integrity.leaks(x.every_ref(), x.all_refs())


@query(f"with {_CHECKED} select image_id, case when stored > expected then 'leak' else 'mismatch' end as kind, count(*) as issues from checked where known and stored <> expected group by 1, 2")
def integrity_report_images(x: Lenses) -> DataFrame:
    kind = F.when(F.col("stored") > F.col("expected"), "leak").otherwise("mismatch")
    return integrity.compare(x.every_ref(), x.all_refs()).groupBy("image_id", kind.alias("kind")).agg(F.count("*").alias("issues"))


@query(f"with {_CHECKED} select image_id, cluster_idx, expected as refcount from checked")
def repair_refcounts_images(x: Lenses) -> DataFrame:
    return integrity.repair(x.every_ref(), x.all_refs())


@query(f"with {_CHECKED} select image_id, cluster_idx, least(stored, expected) as refcount from checked where known")
def repair_leaks_only_images(x: Lenses) -> DataFrame:
    return integrity.repair(x.every_ref(), x.all_refs(), leaks_only=True)


@query(f"""with {_EVERY} select u.image_id, table_id, guest_cluster, host_cluster, copied, coalesce(r.refs = 1, false) as should from u_map u left join allrefs r
  on r.image_id = u.image_id and r.cluster_idx = u.host_cluster where kind = 'standard' and copied <> coalesce(r.refs = 1, false)""")
def copied_flags_images(x: Lenses) -> DataFrame:
    return integrity.copied_flags(x.u_map, x.all_refs())


@query(f"with {_LOST} select * from lost")
def orphans_images(x: Lenses) -> DataFrame:
    return integrity.orphans(x.every_ref(), x.u_map.where("table_id = 1"))


@query(f"""with {_LOST}, slots as (select unnest(range(0, greatest(20000, (select count(*) from lost) + (select count(*) from u_map)))) as g) select image_id, cluster_idx, guest_cluster
  from (select *, row_number() over (partition by image_id order by cluster_idx) as rn from lost) join (select image_id, g as guest_cluster, row_number() over (partition by image_id order by g) as rn
  from slots cross join (select distinct image_id from u_map) i where not exists (select 1 from u_map u where u.table_id = 1 and u.image_id = i.image_id and u.guest_cluster = g)) using (image_id, rn)""")
def orphan_assign_images(x: Lenses) -> DataFrame:
    active = x.u_map.where("table_id = 1")
    return integrity.assign_orphans(integrity.orphans(x.every_ref(), active), active, 20_000)


@query("""select i.image_id, coalesce(max(try_cast(c_name as bigint)), 0) + 1 as next_id, count(c_name) as snapshots from (select distinct image_id from u_map) i left join
  (select image_id, cast(table_id as varchar) as c_name from u_map where table_id <> 1 group by image_id, table_id) s on s.image_id = i.image_id group by i.image_id""")
def next_snapshot_id_images(x: Lenses) -> DataFrame:
    ids = x.u_map.select("image_id", F.when(F.col("table_id") != 1, F.col("table_id").cast("string")).alias("id")).distinct()
    return ids.groupBy("image_id").agg((F.coalesce(F.max(F.expr("try_cast(id as bigint)")), F.lit(0)) + 1).alias("next_id"), F.count("id").alias("snapshots"))


@query(f"with {_BITS} select * from bits")
def stream_dirty(x: Lenses) -> DataFrame:
    """The dirty granules of the writes read as a stream to its end; the result is the batch query's."""
    from ..shipping import shared_folder
    from ..streaming import tracking
    from .lens import SQL

    spark, path = x.spark, f"{x.sf_dir}/events.parquet"
    files = spark.read.parquet(path)
    folder = shared_folder(spark, "stream")
    # a stream reads folders: of the table's own folder, or of its parent with the file's name as filter
    single = len(files.inputFiles()) == 1 and files.inputFiles()[0].rstrip("/").endswith("events.parquet")
    reader = spark.readStream.schema(files.schema)
    raw = reader.option("pathGlobFilter", "events.parquet").parquet(x.sf_dir) if single else reader.parquet(path)
    writes = spark.sql(SQL["l_write"].replace("from events", "from {source}"), source=raw)
    granules = tracking.dirty_granules(writes, 65_536, late=None)
    out = granules.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/granules")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(granules.schema).parquet(f"{folder}/granules")
