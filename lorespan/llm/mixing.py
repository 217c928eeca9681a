"""Mixing sources to target weights by entropy balancing.

Sources get word targets: shares of a total by weight, none above `most` times the source's size.
Documents get rates as near to 1 as the targets allow, in relative entropy, and at most `most`: the
dual has one multiplier a source, and its solution tilts rates exponentially, min(most, exp(lambda *
size / mean size)). The dual is solved by Newton steps, kept inside a bracket that each step narrows.
A step is one aggregation over (source, size) counts, in which a hot source is no larger than others.

Rates become whole copies by a hashed dither: floor(rate + u + shift). The shift of a source is
chosen from a grid so that the copies' words come as near to the target as the grid allows.
Everything is made of DataFrame operations; only one row a source is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import Scratch, cut, plain

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Newton steps at most; relative error at which they end; cells of the grid of shifts.
STEPS, ERROR, GRID = 120, 1e-10, 4096
#: Rows, one a source, that are broadcast to documents; if there are more sources, rows are shuffled by source.
BROADCAST_SOURCES = 100_000
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds rank, weight and target to (source, source_size): one row a source, ordered by code point, null last.

    Sources are filled in the order of limit / weight: a source that reaches its limit at the level
    of those not yet filled keeps the limit, all others get weight times the common level.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(every))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(whole)["level"]
    return ranked.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * rest)).select("source", "source_size", "rank", "weight", "target")


def tilts(counts: DataFrame, goals: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """rank, tilt: lambda of each source. counts: rank, size, n; goals: rank, mean, source_size, target. A step either meets the target or halves the bracket at the least every other time; an error if STEPS don't end it."""
    full = F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-12)
    state = scratch.cut(goals.where(~full & (F.col("target") > 0)).select("rank", "mean", "target", (F.log(F.col("target") / F.col("source_size")) / 2).alias("tilt"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.lit(False).alias("done")))
    for _ in range(STEPS):
        c = F.col("size") / F.col("mean")
        # beyond the limit a rate no longer answers to lambda
        free = F.col("tilt") * c < F.log(F.lit(float(most)))
        rate = F.when(free, F.exp(F.col("tilt") * c)).otherwise(float(most))
        mass = F.col("n") * F.col("size")
        sums = counts.where("size > 0").join(state, "rank").groupBy("rank").agg(F.sum(mass * rate).alias("f"), F.sum(F.when(free, mass * c * rate).otherwise(0.0)).alias("g"))
        over = F.col("f") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("f") - F.col("target")) / F.nullif(F.col("g"), F.lit(0.0))
        inside = (newton > low) & (newton < high)
        narrow = high - low <= F.greatest(F.abs(high), F.lit(1.0)) * 1e-14
        step = F.when((F.abs(F.col("f") - F.col("target")) <= F.col("target") * ERROR) | narrow, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2)
        before, state = state, scratch.cut(state.join(sums, "rank").select("rank", "mean", "target", step.alias("tilt"), low.alias("low"), high.alias("high"), (step == F.col("tilt")).alias("done")))
        scratch.drop(before)
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise ArithmeticError(f"the dual isn't solved after {STEPS} steps for {state.where(~F.col('done')).count()} sources")
    solved = state.select("rank", F.round("tilt", 9).alias("tilt"))
    return goals.select("rank", "source_size", "target").join(solved, "rank", "left").select("rank", F.coalesce("tilt", F.when(F.col("target") > 0, 1e9).otherwise(-1e9)).alias("tilt"))


def _copies(value: Column, most: int) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(most)).cast("long")


def _dithered(most: int) -> Column:
    """rate + u, u in [0, 1) from the hash of the document's id."""
    size = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * size, F.lit(50.0)))))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 11) / F.lit(float(1 << 53))
    return rate + u


def beside(sources: DataFrame) -> DataFrame:
    """Rows of sources as the small side of a join with documents."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, source, size): those rows, kept in the shared folder, and one row a source with all that makes copies of them."""
    with Scratch(docs.sparkSession) as scratch:
        sizes = cut(docs)
        return sizes, cut(_goals(sizes, weights, share, most, scratch))


def _goals(sizes: DataFrame, weights, share: float, most: int, scratch: Scratch) -> DataFrame:
    sources = scratch.cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean")).select("source", "source_size", "mean").drop("mean"), weights, share, most))
    ranked = sizes.join(beside(sources), sizes["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "rank")
    counts = scratch.cut(ranked.groupBy("rank", "size").agg(F.count("*").alias("n")))
    means = counts.where("size > 0").groupBy("rank").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    goals = scratch.cut(sources.join(means, "rank", "left").withColumn("mean", F.coalesce("mean", F.lit(1.0))))
    goals = scratch.cut(goals.join(tilts(counts, goals, scratch, most), "rank"))
    value = ranked.join(beside(goals.select("rank", "mean", "tilt")), "rank").withColumn("value", _dithered(most))
    # words at shift -1, and where along the grid of shifts each document gains a copy
    gain = F.filter(F.transform(F.array(*(F.lit(float(m)) for m in range(1, most + 1))), lambda m: F.ceil((m - F.col("value") + 1) * (GRID / 2)).cast("int")), lambda b: (b > 0) & (b <= GRID))
    steps = value.select("rank", F.col("size"), F.explode(F.concat(F.transform(gain, lambda b: F.struct(b.alias("bin"), F.col("size").alias("mass"))), F.array(F.struct(F.lit(0).alias("bin"), (_copies(F.col("value") - 1, most) * F.col("size")).alias("mass"))))).alias("x"))
    curve = steps.groupBy("rank", "x.bin").agg(F.sum("x.mass").alias("mass"))
    curve = curve.withColumn("taken", F.sum("mass").over(Window.partitionBy("rank").orderBy("bin"))).join(goals.select("rank", "target"), "rank")
    shift = curve.groupBy("rank").agg(F.min_by("bin", F.struct(F.abs(F.col("taken") - F.col("target")), F.abs(F.col("bin") - GRID // 2))).alias("bin"))
    return goals.join(shift, "rank", "left").withColumn("shift", F.coalesce(F.col("bin"), F.lit(GRID // 2)) * (2 / GRID) - 1).drop("bin")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of each row of docs (doc_id, source, text).

    A null or blank text has no words and takes none; a null source is a source of its own, the last
    in order. Repeated rows are rows like others. A source without words has target 0. An empty table
    gives an empty one. The same rows get the same copies in any order and partitioning. What is left of
    a rate after whole copies is settled by the hash of doc_id, so rows that share a doc_id, those
    without any among them, are copied together: a source of few doc_ids may miss its target.
    """
    sizes, goals = plan(plain(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size")), weights, share, most)
    out = sizes.join(beside(goals.withColumnRenamed("source", "source_")), F.col("source").eqNullSafe(F.col("source_")))
    out = out.withColumn("value", _dithered(most)).withColumn("copies", _copies(F.col("value") + F.col("shift"), most))
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))
    return out.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs in all their columns, each as often as it is taken, with size, source_size, target, taken and copy (from 1) beside them; columns of these names in docs give way."""
    added = ("size", "source_size", "target", "taken", "copy")
    docs = docs.drop(*added)
    text = docs.withColumn("size", n_words(F.col("text")))
    _, goals = plan(text.select("doc_id", "source", "size"), weights, share, most)
    goals = goals.select(F.struct("source", "source_size", "target", "mean", "tilt", "shift").alias("_goal"))
    out = text.join(beside(goals), F.col("source").eqNullSafe(F.col("_goal.source")))
    size = F.col("size") / F.col("_goal.mean")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("_goal.tilt") * size, F.lit(50.0)))))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 11) / F.lit(float(1 << 53))
    copies = _copies(rate + u + F.col("_goal.shift"), most)
    out = out.select(*docs.columns, "size", F.col("_goal.source_size").alias("source_size"), F.col("_goal.target").alias("target"), (copies * F.col("size")).alias("taken"), F.sequence(F.lit(0), copies.cast("int")).alias("copy"))
    return out.withColumn("copy", F.explode("copy")).where("copy > 0")
