"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

A document of z (its size over its source's mean) gets the rate r = min(2, exp(t z)): of all rates in [0, 2] that meet
the source's token target, these are nearest to one copy each, in relative entropy (sum of r log r - r + 1). The dual is
one convex function of t for each source; Newton steps, kept inside a bracket, solve all sources at once by
aggregations over the histogram (source, size, documents), a few steps a job. Rates become copies by a hash of the
document: floor(r + u + shift), with the source's shift searched so that the copies' words, not only their
expectation, come to the target; then one document of each source gets a copy more or less, if that comes nearer.

Rows that repeat (doc_id and size) are numbered, and their u's are spread evenly from the first, so a document that
fills a source is split over its copies. Numbers are those of the row within its partition, plus a prefix sum over the
partitions, so no task sorts all repeats of a row.

Defined results: null texts have size 0; size 0 takes nothing. Null sources come last in the order of weights.
Sources at their cap of 2 take all documents twice. Empty tables give no rows. Extra columns, of any name, are carried by
`mix` (those that it gives are replaced) and not by `mix_sizes`. Reruns agree, since nothing depends on order or on
chance: repeated rows may swap their copies, which no column shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, cut_table as cut

WEIGHTS = (3.0, 1.0, 2.0)
CAP = 2.0
#: Repeated (doc_id, size) up to this number are sent to all executors (some 50 bytes each); beyond, they are shuffled.
BROADCAST_REPEATS = 200_000
GOLDEN = 0.6180339887498949


def sized(docs: DataFrame, *columns) -> DataFrame:
    """doc_id, source, size (words of the text), the row's place, and other columns."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), *columns,
    )


def repeats_of(rows: DataFrame) -> DataFrame | None:
    """(doc_id, size) of more than one row; None if there are none."""
    found = cut(rows.groupBy("doc_id", "size").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("r_id"), F.col("size").alias("r_size")))
    many = found.count()
    return None if not many else F.broadcast(found) if many <= BROADCAST_REPEATS else found


def with_u(rows: DataFrame, repeats: DataFrame | None, seed: int) -> DataFrame:
    """rows without their places, and u: a number in [0, 1) from doc_id, size and the rank among rows that repeat."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 11).cast("double") / float(1 << 53)
    if repeats is None:
        return rows.withColumn("u", u).drop("part", "row")
    key = ("doc_id", "size", "part")
    x = rows.join(repeats, rows["doc_id"].eqNullSafe(F.col("r_id")) & (rows["size"] == F.col("r_size")), "left").withColumn("again", F.col("r_size").isNotNull()).drop("r_id", "r_size")
    again = x.where("again").withColumn("local", F.row_number().over(Window.partitionBy(*key).orderBy("row")))
    before = F.sum("n").over(Window.partitionBy("doc_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = x.where("again").groupBy(*key).agg(F.count("*").alias("n")).select(F.col("doc_id").alias("p_id"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), F.coalesce(before, F.lit(0)).alias("before"))
    again = again.join(parts, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part"))).drop("p_id", "p_size", "p_part")
    again = again.withColumn("rank", F.col("before") + F.col("local") - 1).drop("before", "local")
    every = x.where(~F.col("again")).withColumn("rank", F.lit(0).cast("long")).unionByName(again)
    spread = u + F.col("rank") * F.lit(GOLDEN)
    return every.withColumn("u", spread - F.floor(spread)).drop("part", "row", "again", "rank")


def targets(sizes: DataFrame, total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: shares of total by weight, none above cap times its size.

    Sharing the excess again until none is above is the same as one level for all: target = min(cap, weight * level).
    """
    by = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = by.withColumn("weight", w).withColumn("most", cap * F.col("source_size"))
    all_rows = Window.partitionBy()
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(rising), F.lit(0.0))
    t = t.withColumn("level", (total * F.sum("source_size").over(all_rows) - before("most")) / (F.sum("weight").over(all_rows) - before("weight")))
    t = t.withColumn("level", F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(all_rows)["level"])
    return t.select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def tilts(hist: DataFrame, goals: DataFrame, tolerance: float = 1e-6, rounds: int = 12, steps: int = 4) -> DataFrame:
    """source, mean, tilt (null: at the cap, every rate is CAP) by Newton's method on each source's dual, `steps` a job."""
    many = hist.groupBy("source").agg(F.sum("docs").alias("n"))
    state = cut(_by_source(goals, many).select(
        "source",
        F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9)).alias("mean"),
        F.col("target"),
        (F.col("target") >= (CAP - 1e-9) * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("t"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(0.0).alias("off"),
    ))
    for _ in range(rounds):
        for _ in range(steps):
            state = _newton(hist, state, tolerance)
        state = cut(state)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return state.select("source", "mean", F.when(~F.col("full"), F.col("t")).alias("tilt"))


def _newton(hist: DataFrame, state: DataFrame, tolerance: float) -> DataFrame:
    """One step of every source: to the tangent's zero, or to the bracket's middle where that lies outside."""
    x = _by_source(hist, state.where("not full").select("source", "mean", "t"))
    x = x.selectExpr("source", "docs * size as words", "size / mean as z", "exp(least(t * size / mean, 1D)) as raw")  # beyond log 2 the rate is at the cap
    sums = x.groupBy("source").agg(F.expr(f"sum(words * least(raw, {CAP}D)) as f"), F.expr(f"sum(if(raw < {CAP}D, words * z * raw, 0D)) as slope"))
    s = _by_source(state, sums, "left").selectExpr(
        "*", "if(f > target, lo, t) as new_lo", "if(f > target, t, hi) as new_hi", "t - (f - target) / greatest(slope, 1e-300D) as newton",
        "coalesce(abs(f - target) / greatest(target, 1D), 0D) as new_off",
    )
    s = s.withColumn("done", F.expr(f"full or f is null or new_off <= {tolerance!r}D"))
    step = "if(newton > new_lo and newton < new_hi, newton, (new_lo + new_hi) / 2)"
    return s.selectExpr("source", "mean", "target", "full", f"if(done, t, {step}) as t", "if(done, lo, new_lo) as lo", "if(done, hi, new_hi) as hi", "new_off as off")


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, where null equals null."""
    r = right.withColumnRenamed("source", "__source")
    return left.join(r, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def shifts(docs: DataFrame, goals: DataFrame, passes: int = 5, grid: int = 16) -> DataFrame:
    """source, shift: the least difference of the copies' words from the target, by a grid refined pass by pass."""
    state = goals.selectExpr("source", "target", "-1D as lo", "1D as hi")
    at = [f"(lo + (hi - lo) * {k / grid!r}D)" for k in range(grid + 1)]
    words = [F.expr(f"sum(size * {_COPIES.format(shift=x)}) as w{k}") for k, x in enumerate(at)]
    points = ", ".join(f"struct(abs(coalesce(w{k}, 0) - target) as off, {x} as at)" for k, x in enumerate(at))
    low = ", ".join(f"if(coalesce(w{k}, 0) <= target, {k}, 0)" for k in range(grid))
    for last in range(passes):
        s = _by_source(state, _by_source(docs, state.select("source", "lo", "hi")).groupBy("source").agg(*words), "left")
        if last == passes - 1:
            return _last_flip(docs, cut(s.selectExpr("source", "target", f"array_min(array({points})).at as shift")))
        state = cut(s.selectExpr("source", "target", "lo", "(hi - lo) / {0} as step".format(grid), f"greatest({low}) as k").selectExpr("source", "target", "lo + step * k as lo", "lo + step * (k + 1) as hi"))
    raise ValueError("passes must be positive")


def _last_flip(docs: DataFrame, found: DataFrame) -> DataFrame:
    """source, shift and flip columns: the one document whose copy more or less comes nearest to what still lacks, if any does."""
    x = _by_source(docs, found).withColumn("__n", copies(F.col("rate"), F.col("u"), F.col("shift")))
    like = cut(x.groupBy("source", "size", "u").agg(F.count("*").alias("rows"), F.max("__n").alias("n"), F.max("target").alias("target")))
    lack = cut(like.groupBy("source").agg((F.max("target") - F.sum(F.col("rows") * F.col("n") * F.col("size"))).alias("lack")))
    by = F.when((F.col("lack") > 0) & (F.col("n") < 2), F.lit(1)).when((F.col("lack") < 0) & (F.col("n") > 0), F.lit(-1)).otherwise(0)
    y = cut(_by_source(like, lack).withColumn("by", by)).where("by <> 0").withColumn("left", F.abs(F.col("lack") - F.col("by") * F.col("rows") * F.col("size")))
    key = F.col("left") + F.col("u") * 1e-6  # __u settles ties
    best = cut(y.where("left < abs(lack)").groupBy("source").agg(*(F.min_by(c, key).alias(f"flip_{c}") for c in ("size", "u", "by"))))
    return _by_source(found.select("source", "shift"), best, "left")


#: Copies of a row with rate and u.
_COPIES = f"cast(greatest(0D, least({CAP}D, floor(rate + u + {{shift}}))) as bigint)"


def copies(rate, u, shift):
    return F.greatest(F.lit(0), F.least(F.lit(2), F.floor(rate + u + shift))).cast("long")


SOLVED = ("source_size", "target", "mean", "tilt", "shift", "flip_size", "flip_u", "flip_by")


def _rate(tilt, mean, size):
    return F.when(tilt.isNull(), F.lit(CAP)).otherwise(F.least(F.exp(F.least(tilt * size / mean, F.lit(1.0))), F.lit(CAP)))


def solve(base: DataFrame, total: float = 1.5) -> DataFrame:
    """source, and `mix`, a struct of SOLVED. base: source, size, u of every document, written or cut."""
    hist = cut(base.groupBy("source", "size").agg(F.count("*").alias("docs")))
    goals = cut(targets(hist.select("source", (F.col("size") * F.col("docs")).alias("source_size")), total))
    solved = cut(_by_source(goals, tilts(hist, goals)))
    rated = cut(_by_source(base, solved).select("source", "size", "u", _rate(F.col("tilt"), F.col("mean"), F.col("size")).alias("rate")))
    return cut(_by_source(solved, shifts(rated, goals)).select("source", F.struct(*SOLVED).alias("mix")))


def apply(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """rows (source, size, u, others) with source_size, target, rate, copies and taken."""
    m = lambda c: F.col(f"mix.{c}")
    own = (m("flip_size") == F.col("size")) & (m("flip_u") == F.col("u"))
    x = _by_source(rows, solved).withColumn("rate", _rate(m("tilt"), m("mean"), F.col("size")))
    x = x.withColumn("copies", (copies(F.col("rate"), F.col("u"), m("shift")) + F.when(own, m("flip_by")).otherwise(0)).cast("long"))
    return x.withColumn("taken", F.col("size") * F.col("copies")).withColumn("source_size", m("source_size")).withColumn("target", m("target")).drop("mix", "u")


NEW = ("size", "source_size", "target", "rate", "copies", "taken")


def _base(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame | None]:
    rows = cut(sized(docs.select("doc_id", "source", "text")))
    repeats = repeats_of(rows)
    base = with_u(rows, repeats, seed)
    return (base if repeats is None else cut(base)), repeats


def mix(docs: DataFrame, total: float = 1.5, seed: int = 29) -> DataFrame:
    """All columns of docs, and size, source_size, target, rate, copies, taken (these names are replaced).

    docs needs doc_id, source and text, and should be a table whose rows keep their order when they are read again. The
    sizes are counted once and written; texts take no part in the rounds.
    """
    keep = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c not in NEW)).alias("doc")
    base, repeats = _base(docs, seed)
    out = apply(with_u(sized(docs, keep), repeats, seed), solve(base, total))
    return out.select("doc.*", *NEW)


def mix_sizes(docs: DataFrame, total: float = 1.5, seed: int = 29) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: as mix, but the texts are read once."""
    base, _ = _base(docs, seed)
    return apply(base, solve(base, total)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
