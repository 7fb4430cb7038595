"""Laws that hold whatever the data: repair is clean, coalesce then expand is identity, and so on."""

import pytest
from pyspark.sql import functions as F

from cowlens.operators import chains, dirty, integrity, mapping
from cowlens.plans.catalogue import Lenses

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def x(spark):
    return Lenses(spark, SF)


def same(a, b):
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.select(a.columns).exceptAll(a).count() == 0


def test_check_is_clean_after_repair(x):
    fixed = integrity.repair(x.l_ref, x.refs()).withColumnRenamed("refcount", "stored")
    assert integrity.compare(fixed, x.refs(), full=True).count() == 0
    only = integrity.repair(x.l_ref, x.refs(), leaks_only=True).withColumnRenamed("refcount", "stored")
    assert integrity.leaks(only, x.refs()).count() == 0


def test_regions_expand_to_their_bits(x):
    bits = dirty.dirty_bits(x.l_write, 4096)
    again = dirty.regions(bits, 4096).select("image_id", F.explode(F.sequence(F.expr("start_offset div 4096"), F.expr("end_offset div 4096 - 1"))).alias("bit_no"))
    same(bits, again)


def test_merge_is_a_union(x):
    b = dirty.dirty_bits(x.l_write, 4096)
    p, q = b.where("image_id = 0").select("bit_no"), b.where("image_id = 1").select("bit_no")
    same(dirty.merge(p, q), dirty.merge(q, p))
    same(dirty.merge(p, p), p)


def test_commit_then_read_is_the_layered_read(x):
    two = x.l_layer.where("depth in (1, 2)")
    same(mapping.layered(two).select("guest_cluster", "host_cluster"), mapping.commit(x.l_layer, 1, 2).select("guest_cluster", "host_cluster"))


def test_snapshot_apply_brings_back(x):
    u = x.u_map
    applied = mapping.apply_snapshot(u, 3)
    assert mapping.diff(applied, 1, 3).count() == 0


def test_ranks_are_gapless(spark):
    d = spark.range(0, 5000, 3).select((F.col("id") % 2).alias("p"), F.col("id").alias("k"))
    r = mapping.ranked(d, "p", "k", width=64).orderBy("p", "k").collect()
    want, seen = {}, {}
    for row in r:
        want[row.p, row.k] = seen.get(row.p, 0)
        seen[row.p] = seen.get(row.p, 0) + 1
    assert all(row["rank"] == want[row.p, row.k] for row in r)


def test_cycles_are_found(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 5), (7, 99)], "node long, parent long")
    assert {r.node for r in chains.cyclic(links).collect()} == {4, 5, 6, 7}


def test_write_of_no_length_touches_nothing(spark):
    w = spark.createDataFrame([(0, 100, 0), (0, 4095, 2)], "image_id int, offset_bytes long, len long")
    assert sorted(r.bit_no for r in dirty.dirty_bits(w, 4096).collect()) == [0, 1]


def test_integrity_checks_every_image(x):
    found = integrity.compare(x.every_ref(), x.all_refs(), full=True)
    assert {r.image_id for r in found.select("image_id").distinct().collect()} == {0, 1, 2, 3}
    same(found.where("image_id = 0").drop("image_id"), integrity.compare(x.l_ref, x.refs(), full=True))
    same(found.where("image_id = 2").drop("image_id"), integrity.compare(x.l_ref, x.refs(2), full=True))
    fixed = integrity.repair(x.every_ref(), x.all_refs()).withColumnRenamed("refcount", "stored")
    assert integrity.compare(fixed, x.all_refs(), full=True).count() == 0


def test_no_orphan_is_lost_for_want_of_slots(spark):
    entries = spark.createDataFrame([(0, 0), (0, 2), (0, 90), (1, 1)], "image_id long, guest_cluster long")
    orphan = spark.createDataFrame([(i, 100 + k) for i, n in ((0, 12), (1, 3)) for k in range(n)], "image_id long, cluster_idx long")
    got = {(r.image_id, r.cluster_idx): r.guest_cluster for r in integrity.assign_orphans(orphan, entries, 4).collect()}
    assert got == {**{(0, 100 + k): g for k, g in enumerate([1, 3, *range(4, 14)])}, (1, 100): 0, (1, 101): 2, (1, 102): 3}
    one = orphan.where("image_id = 0").select("cluster_idx")
    assert integrity.assign_orphans(one, entries.where("image_id = 0"), 4).count() == 12
    assert integrity.assign_orphans(one.limit(0), entries.limit(0), 0).count() == 0
