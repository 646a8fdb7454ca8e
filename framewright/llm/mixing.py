"""Mixing sources to target weights by entropy balancing, DataFrame functions only.

A document of source s gets the rate exp(l_s * x), x its size over its source's mean size, capped: the tilt of the
unit rates that is closest to them in relative entropy while the source's tokens meet the target. l_s solves a convex
dual in one unknown per source; each Newton iteration is a distributed aggregation over the histogram of sizes (rows of
source, size and count, made once). Rates are then rounded into whole copies, passing on the rounding error from each
document to the next, in groups of about GROUP documents, so no source lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, materialize, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources beyond this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000
#: Documents that are rounded together.
GROUP = 1024


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """From (source, source_size): the same with target.

    Sources in code-point order, null last, get the weights in turn; targets in proportion to them sum to share * all
    sizes, no target exceeds limit * its source's size, and the excess goes to the rest by weight until none does.
    That fixed point is level * weight below the limits: sources saturate in the order of limit / weight, so prefix
    sums in this order give the level. The table has a row per source.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int"))
    s = sources.withColumn("_w", w).withColumn("_cap", limit * F.col("source_size")).withColumn("_at", F.col("_cap") / F.col("_w"))
    every, by_at = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_at", F.col("source").asc_nulls_last())
    before = by_at.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # what the level would be if exactly the sources before this one were at their limits; no such guess exceeds the true level, which is one of them
    s = s.withColumn("_level", left / rest).withColumn("_level", F.max("_level").over(every))
    return s.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _rate(x: Column, tilt: Column, limit: float) -> Column:
    return F.least(F.exp(F.least(F.greatest(tilt * x, F.lit(-600.0)), F.lit(600.0))), F.lit(limit))


def balance(hist: DataFrame, targets: DataFrame, n_sources: int, limit: float, iterations: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """(source, mean, target, tilt): Newton's method, kept inside a shrinking bracket, on the dual of all sources at once.

    hist: (source, size, n), size > 0. Each iteration aggregates hist by source into a row per source; iterations stop
    when the largest relative gap is below tolerance. A source whose target is all its words times the limit needs no
    tilt: its rates are the limit.
    """
    state = targets.join(hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean")), targets.source.eqNullSafe(hist.source), "inner").select(targets.source, "mean", "target")
    full = F.col("target") >= limit * F.col("total") * (1 - 1e-12)
    total = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"))
    state = state.join(total, state.source.eqNullSafe(total.source)).select(state.source, "mean", "target", "total")
    state = state.select("source", "mean", "target", "total", F.when(full, F.lit(600.0)).otherwise(F.lit(0.0)).alias("tilt"), F.lit(-600.0).alias("lo"), F.lit(600.0).alias("hi"), full.alias("done"))
    before = state = materialize(state, "mix-tilt")
    for _ in range(iterations):
        s, h = state.withColumnRenamed("source", "_s"), hist
        x = F.col("size") / F.col("mean")
        r = _rate(x, F.col("tilt"), limit)
        free = F.col("tilt") * x < F.log(F.lit(limit))
        sums = h.join(_small(s.filter("not done"), n_sources), h.source.eqNullSafe(F.col("_s"))).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.when(free, F.col("n") * F.col("size") * x * r).otherwise(0.0)).alias("slope"))
        s = s.join(_small(sums, n_sources), F.col("_s").eqNullSafe(F.col("source")), "left").drop("source")
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        s = s.withColumns({"_lo": lo, "_hi": hi, "_step": step, "_near": F.col("done") | (F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)))})
        within = F.coalesce((F.col("_step") > F.col("_lo")) & (F.col("_step") < F.col("_hi")), F.lit(False))
        moved = F.when(F.col("_near"), F.col("tilt")).when(within, F.col("_step")).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        state = s.select(F.col("_s").alias("source"), "mean", "target", "total", moved.alias("tilt"), F.when(F.col("_near"), F.col("lo")).otherwise(F.col("_lo")).alias("lo"), F.when(F.col("_near"), F.col("hi")).otherwise(F.col("_hi")).alias("hi"), F.coalesce(F.col("_near"), F.lit(True)).alias("done"))
        old, state = before, materialize(state, "mix-tilt")
        discard(old)
        before = state
        if state.filter("not done").isEmpty():
            break
    return state


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, copies, rate, taken.

    Null text has size 0; documents of size 0 are never taken. Null is a source of its own. The same input gives the
    same copies each time: ties are ordered by id and a hash of the text. Other columns play no part. An empty table
    gives an empty result.
    """
    dealt = _mixed(_sizes(docs, id_col, text_col, source_col), weights, share, limit)
    each = dealt.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m")))).withColumn("copies", F.expr(SHARE))
    return each.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", "rate", (F.col("copies") * F.col("size")).alias("taken"))


#: Copies of the _j-th of _m equal rows that are taken _c times in all.
SHARE = "cast(_c div _m + if(_j <= _c % _m, 1, 0) as bigint)"


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
    return materialize(docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "mix-sizes")


def _mixed(sizes: DataFrame, weights, share: float, limit: float) -> DataFrame:
    """A row for each source, id and text: how many such rows there are (_m) and how often they are taken in all (_c). Equal rows are counted first, so however many they are they never meet in one group."""
    hist = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    per = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("_docs"))
    per = materialize(per, "mix-sources")
    n_sources = per.count()
    targets = materialize(source_targets(per.select("source", "source_size"), weights, share, limit), "mix-targets")
    tilts = balance(hist.filter("size > 0"), targets.select("source", "target"), n_sources, limit)
    facts = per.select(F.col("source").alias("_s"), "_docs").join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t")))
    facts = facts.join(tilts.select(F.col("source").alias("_u"), "mean", "tilt"), F.col("_s").eqNullSafe(F.col("_u")), "left")
    facts = materialize(facts.select("_s", "_docs", "source_size", "target", "mean", "tilt"), "mix-facts")
    rows = sizes.groupBy("_id", "_h", "source", "size").agg(F.count("*").alias("_m"))
    rated = rows.join(_small(facts, n_sources), F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("size") > 0, _rate(F.col("size") / F.col("mean"), F.col("tilt"), limit)).otherwise(0.0)
    rated = rated.withColumn("rate", rate).withColumn("_g", F.pmod(F.xxhash64("_id", "_h"), F.ceil(F.col("_docs") / F.lit(GROUP))))
    # copies are dealt from the longest document to the shortest so that the words taken follow the sum of rates times sizes
    doc = F.struct((-F.col("size")).alias("s"), F.col("_id").alias("i"), F.col("_h").alias("h"), F.col("rate").alias("r"), F.col("_m").alias("m"), "source_size", "target")
    groups = rated.groupBy("source", "_g").agg(F.array_sort(F.collect_list(doc)).alias("_docs"))
    nothing = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<bigint>").alias("copies"))

    def deal(state: Column, doc: Column) -> Column:
        due = doc["r"] * doc["m"]
        part = due - F.floor(due)
        more = (part > 0) & (state["owed"] - part * doc["s"] >= -doc["s"] / 2)  # s is negative
        copies = F.least(F.floor(due) + F.when(more, 1).otherwise(0), F.lit(int(limit)) * doc["m"]).cast("long")
        return F.struct((state["owed"] - (due - copies) * doc["s"]).alias("owed"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    dealt = groups.select("source", "_docs", F.aggregate("_docs", nothing, deal, lambda state: state["copies"]).alias("_copies"))
    dealt = dealt.select("source", F.explode(F.arrays_zip("_docs", "_copies")).alias("z"))
    d = "z._docs."
    return dealt.select("source", F.col(d + "i").alias("_id"), F.col(d + "h").alias("_h"), (-F.col(d + "s")).alias("size"), F.col(d + "source_size").alias("source_size"), F.col(d + "target").alias("target"), F.col(d + "r").alias("rate"), F.col(d + "m").alias("_m"), F.col("z._copies").alias("_c"))


def repeat_by_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """docs with each row as often as mix() takes it (0, 1 or 2 times under the default limit); all columns stay.

    Rows that agree in id, text and source share their copies as evenly as can be. Null texts and those without a word
    are never taken; null is an id and a source like any other. An empty table gives an empty result; columns other than
    the three named play no part, whatever their names.
    """
    mixed = _mixed(_sizes(docs, id_col, text_col, source_col), params.get("weights", WEIGHTS), params.get("share", 1.5), params.get("limit", 2.0))
    taken = materialize(mixed.filter("_c > 0").select(F.col("_id").alias("_i"), F.col("_h").alias("_x"), F.col("source").alias("_s"), "_c", "_m"), "mix-taken")
    own = docs.select(whole_row(docs).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(source_col).cast("string").alias("_source"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_x")) & F.col("_source").eqNullSafe(F.col("_s"))
    share = F.expr(f"cast({SHARE} as int)")
    kept = own.join(taken.filter("_m = 1"), same).select("_row", "_c", "_m", F.lit(1).cast("long").alias("_j"))
    again = taken.filter("_m > 1")
    if n_again := again.count():
        kept = kept.unionByName(_numbered(own.join(_small(again, n_again), same)))
    return kept.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), share))).select("_row.*")


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows with their number _j among all that are equal, found in parts, so that no task has to see all of them."""
    more = rows.withColumn("_part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("_i", "_x", "_s", "_part").orderBy(F.lit(0)))
    more = materialize(more.withColumn("_n", number), "mix-equal")
    ends = more.groupBy("_i", "_x", "_s", "_part").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy("_i", "_x", "_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col("_i").alias("_i2"), F.col("_x").alias("_x2"), F.col("_s").alias("_s2"), F.col("_part").alias("_p2"), before.alias("_before"))
    more = more.join(ends, F.col("_i").eqNullSafe(F.col("_i2")) & (F.col("_x") == F.col("_x2")) & F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_part") == F.col("_p2")))
    return more.select("_row", "_c", "_m", (F.col("_n") + F.col("_before")).alias("_j"))
