"""Mixing sources to target weights along a time-varying curriculum, in JVM expressions only.

Targets: sources, sorted, take turns at the given weights and share a multiple of
all words; no source is asked for more than `most_passes` times its words, and
what that leaves is shared again by weight.  The fixed point has a closed form
(one level, weight * level or the limit, whichever is less), found with running
sums over the sources.

Positions: within a source, documents stand in a fixed shuffled order (md5 of the
id).  A source's weight follows a piecewise linear schedule over training time;
its integral, scaled to the target, is the source's cumulative demand for words.
A document is due when the demand reaches the words before it: inverting the
integral gives its position in [0, 1].  A second pass goes through the same order
again, due a whole source later, so `schedule` has a position for each pass of a
document and the words that pass takes; `position` is the first of them.  The last
document is cut at the target, so a source's taken words are its target rounded
down.  The result is range-sorted by position; by_pass() sorts all passes.

Running sums over a source go by hash bucket: sums of buckets first, then within
buckets, so a hot source is spread over many tasks.

Nulls and ties: a null text has size 0; the null source is one source and sorts
last; a null doc_id hashes like an empty one.  Repeated rows have places of their
own, after one another.  Documents of size 0 or past the target take nothing and
have no position; they come last.  Equal positions are ordered by doc_id.  Columns
besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellumix.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: For each weight in turn: (time, relative weight) knots from time 0 to 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 1.5), (1.0, 0.5)))
BUCKET_ROWS, MOST_BUCKETS = 500, 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: Sequence[int], share: float, most_passes: int) -> DataFrame:
    """source, source_size, turn and target from source and source_size; one row a source, so small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    ranked = sources.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most_passes)))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn("place", F.row_number().over(filling))
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("place", "level"))
    level = F.min(fits).over(whole)["level"]
    return ranked.select("source", "source_size", "turn", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches a share of the whole."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
    y = share * F.lit(areas[-1])
    out = None
    for ((t0, w0), (t1, w1)), a0, a1 in reversed(list(zip(zip(knots, knots[1:]), areas, areas[1:]))):
        slope, rest = (w1 - w0) / (t1 - t0), y - F.lit(a0)
        if slope:
            here = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * slope), F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        else:
            here = F.lit(t0) + rest / F.lit(w0)
        out = here if out is None else F.when(y <= a1, here).otherwise(out)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = 1.5, most_passes: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, schedule and passes, a row for each row of docs, sorted by position.

    schedule: array of struct(position, taken), one for each pass that takes words of the document, in order.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = sizes(docs).select("doc_id", "size", F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), order.alias("order"))
    named = scratch.put(named, "sizes")
    buckets = min(MOST_BUCKETS, named.count() // BUCKET_ROWS + 1)
    named = named.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int"))
    keys = ["name", "unnamed", "bucket"]
    parts = scratch.put(named.groupBy(*keys).agg(F.sum("size").alias("words")), "buckets")
    sources = parts.groupBy("name", "unnamed").agg(F.sum("words").alias("source_size")).select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size")
    wanted = targets(sources, weights, share, most_passes).select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "source_size", "turn", "target")
    wanted = scratch.put(wanted, "targets")
    running = Window.partitionBy("name", "unnamed").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).drop("words").join(wanted, ["name", "unnamed"])
    parts = scratch.put(parts, "before")
    inner = Window.partitionBy(*keys).orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(parts, keys)
    start = F.col("before") + F.col("within")
    whole = F.floor("target").cast("long")
    each = [F.least(F.col("size"), F.greatest(F.lit(0), whole - F.col("source_size") * k - start)) for k in range(most_passes)]
    taken = sum(each[1:], each[0])

    def time_at(due: Column) -> Column:
        position = None
        for turn, knots in reversed(list(enumerate(schedules))):
            here = time_of(due, knots)
            position = here if position is None else F.when(F.col("turn") % len(schedules) == turn, here).otherwise(position)
        return F.round(position, 9)

    due = [F.when(F.col("target") > 0, (start + F.col("source_size") * k) / F.col("target")) for k in range(most_passes)]
    passes = F.array(*[F.struct(time_at(d).alias("position"), words.alias("taken")) for d, words in zip(due, each)])
    placed = placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.filter(passes, lambda p: p["taken"] > 0).alias("schedule"))
    placed = placed.select("doc_id", "size", "source_size", "target", "taken", F.get("schedule", F.lit(0))["position"].alias("position"), "schedule")
    placed = placed.withColumn("passes", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0))
    return placed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def by_pass(mixed: DataFrame) -> DataFrame:
    """doc_id, pass (from 0), taken and position: a row for each pass of each document of mix(), sorted by position."""
    each = mixed.select("doc_id", F.posexplode("schedule").alias("pass", "p")).select("doc_id", "pass", F.col("p.taken").alias("taken"), F.col("p.position").alias("position"))
    return each.orderBy("position", "doc_id", "pass")
