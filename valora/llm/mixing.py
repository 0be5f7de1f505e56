"""Mixing sources to target weights by entropy balancing (DataFrame work only).

Each document gets a rate: how often the mix takes it.  The rates stay as
close as possible to one, in relative entropy, while the words taken from each
source meet its target and no rate exceeds ``MAX_COPIES``.  The solution is an
exponential tilt, ``rate = min(MAX_COPIES, exp(tilt_s * x))`` with ``x`` the
document's size over the mean size of its source, and ``tilt_s`` is the
minimiser of a convex function of one variable per source.  Newton steps find
all of them at once: each step is one aggregation (partial sums before the
shuffle, so a source with a third of all rows is no hot task) and keeps a
bracket; a step that leaves the bracket is replaced by bisection.  As a rate
depends on source and size only, the steps run over counts per (source, size).

Rates become copies by systematic rounding: along the documents of a source,
largest first, the copies follow the running sum of the rates, which leaves
the source within about one large document of its target.  The running sums
come from the counts per (source, size) and each document's place among those
of its source and size, found by blocks, so no source is sorted in one task.
A few repair steps then change, per source, the copy of the one document whose
size is nearest to what is missing or too much.

Targets.  Sources ordered by code point, null last, weigh 1, 2, 3, repeating;
they share all words by weight, but none exceeds ``MAX_COPIES`` times its own
words; the excess goes to the others by weight.  The limit of that resharing
is ``min(cap, level * weight)`` for one common level, found by running sums
over the sources (one row each) in the order in which they reach their caps.

Defined cases: a null text, or one without words, has size 0 and nothing is
taken of it; a source without words has target 0; the null source is a source
of its own and differs from the empty string; repeated rows are documents of
their own, told apart by a running number, so reruns agree; columns besides
the three that are named take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.session import cut_lineage

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
NEWTON_STEPS = 40
REPAIRS = 3
ROWS_PER_BLOCK = 20_000
TOLERANCE = 1e-7

_LOG_CAP = math.log(MAX_COPIES)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to a table with ``source, source_size``, one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    x = sizes.withColumn("weight", F.element_at(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1))
    x = x.withColumn("cap", F.lit(float(MAX_COPIES)) * F.col("source_size"))
    # sources reach their caps in the order of cap / weight
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    x = x.withColumn("level", left / F.sum("weight").over(after))
    # the first source whose cap lies above the level that is left for it and all after it
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    x = x.withColumn("level", F.first(F.when(fits, F.col("level")), ignorenulls=True).over(every))
    share = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap"))
    return x.withColumn("target", share).drop("weight", "cap", "level")


def _same(left: str, right: str, *cols: str) -> Column:
    return F.expr(" AND ".join(f"{left}.{c} <=> {right}.{c}" for c in cols))


def tilts(hist: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, mean, tilt``: Newton on the convex dual, all sources at once.

    ``hist`` has ``source, size, k``; ``goals`` has ``source, source_size, n,
    least, target`` with ``least`` the smallest size above 0.
    """
    mean = F.col("source_size") / F.col("n")
    full = F.col("target") >= F.col("source_size") * MAX_COPIES * (1 - TOLERANCE)
    top = F.lit(_LOG_CAP) * mean / F.col("least") * (1 + 1e-9)  # all documents at the cap
    g = goals.where("source_size > 0").select(
        "source", "target", mean.alias("mean"), F.when(full, top).otherwise(F.lit(0.0)).alias("tilt"),
        (F.lit(-60.0) * mean / F.col("least")).alias("lo"), top.alias("hi"), full.alias("done"))
    for _ in range(NEWTON_STEPS):
        power = F.col("g.tilt") * F.col("h.size") / F.col("g.mean")
        free = power < _LOG_CAP
        rate = F.when(free, F.exp(power)).otherwise(F.lit(float(MAX_COPIES)))
        words = (F.col("h.k") * F.col("h.size")).cast("double")
        sums = (hist.alias("h").join(g.where(~F.col("done")).alias("g"), _same("h", "g", "source"))
                .groupBy(F.col("g.source").alias("source"))
                .agg(F.sum(words * rate).alias("got"),
                     F.sum(F.when(free, words * rate * F.col("h.size") / F.col("g.mean"))
                           .otherwise(F.lit(0.0))).alias("slope")))
        s = g.alias("g").join(sums.alias("s"), _same("g", "s", "source"), "left").select("g.*", "s.got", "s.slope")
        gap = F.col("target") - F.col("got")
        met = F.col("done") | (F.abs(gap) <= F.col("target") * TOLERANCE)
        s = s.select("source", "target", "mean", "tilt", "slope", gap.alias("gap"),
                     F.when(gap > 0, F.col("tilt")).otherwise(F.col("lo")).alias("lo"),
                     F.when(gap < 0, F.col("tilt")).otherwise(F.col("hi")).alias("hi"), met.alias("done"))
        step = F.col("tilt") + F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        move = (F.when(F.col("done"), F.col("tilt")).when(inside, step)
                .otherwise((F.col("lo") + F.col("hi")) / 2))
        g = cut_lineage(s.select("source", "target", "mean", move.alias("tilt"), "lo", "hi", "done"))
        if g.where(~F.col("done")).isEmpty():
            break
    return g.select("source", "mean", "tilt")


def _places(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``place``: 0, 1, ... among the rows of the same source and size."""
    blocks = max(1, n // ROWS_PER_BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)).cast("int"))
    key = ["source", "size"]
    rank = F.row_number().over(Window.partitionBy(*key, "block").orderBy("id", "mark")) - 1
    if blocks == 1:
        return rows.withColumn("place", rank).drop("block")
    counts = rows.groupBy(*key, "block").count()
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return (rows.withColumn("rank", rank).alias("r")
            .join(counts.alias("c"), _same("r", "c", *key, "block"))
            .select("r.id", "r.mark", "r.source", "r.size", (F.col("offset") + F.col("rank")).alias("place")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, mark, source, size, source_size, target, rate, copies`` for every row.

    ``mark`` is a hash of the text, which tells rows with one id apart.
    """
    text = F.col(f"`{text_col}`")
    rows = cut_lineage(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"),
                                   F.col(f"`{source_col}`").cast("string").alias("source"),
                                   n_words(text).alias("size")))
    hist = cut_lineage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("k")))
    sizes = hist.groupBy("source").agg(
        F.sum(F.col("size") * F.col("k")).cast("long").alias("source_size"), F.sum("k").alias("n"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    goals = cut_lineage(targets(sizes))
    tilt = tilts(hist, goals)

    power = F.col("tilt") * F.col("size") / F.col("mean")
    rate = F.when(power < _LOG_CAP, F.exp(power)).otherwise(F.lit(float(MAX_COPIES)))
    rates = (hist.alias("h").join(tilt.alias("t"), _same("h", "t", "source"), "left")
             .select("h.source", "size", "k", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(rate).alias("rate")))
    larger = (Window.partitionBy("source").orderBy(F.col("size").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    rates = rates.withColumn("before", F.coalesce(F.sum(F.col("rate") * F.col("k")).over(larger), F.lit(0.0)))
    rates = (rates.alias("r").join(goals.alias("g"), _same("r", "g", "source"))
             .select("r.*", "g.source_size", "g.target"))

    placed = _places(rows, rows.count())
    out = (placed.alias("p").join(rates.alias("r"), _same("p", "r", "source", "size"))
           .select("p.id", "p.mark", "p.source", "p.size", "p.place", "rate", "before", "source_size", "target"))
    at = F.col("before") + F.col("place") * F.col("rate") + 0.5
    copies = F.least(F.floor(at + F.col("rate")) - F.floor(at), F.lit(MAX_COPIES)).cast("long")
    out = cut_lineage(out.select("id", "mark", "source", "size", "place", "rate", "source_size", "target",
                                 copies.alias("copies")))
    moves = _repairs(out, goals)
    return (out.alias("o").join(moves.alias("m"), _same("o", "m", "source", "size", "place"), "left")
            .select("o.id", "o.mark", "o.source", "o.size", "o.source_size", "o.target", "o.rate",
                    (F.col("o.copies") + F.coalesce("m.by", F.lit(0))).alias("copies")))


def _repairs(out: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, size, place, by``: per source a few documents of which one copy
    more or less closes most of the gap.  They are chosen from one candidate
    either way per (source, size), so no step gathers a source's documents."""
    groups = cut_lineage(out.where("size > 0").groupBy("source", "size").agg(
        F.min(F.when(F.col("copies") < MAX_COPIES, F.col("place"))).alias("up"),
        F.min(F.when(F.col("copies") > 0, F.col("place"))).alias("down"),
        (F.sum("copies") * F.col("size")).alias("taken")))
    taken = groups.groupBy("source").agg(F.sum("taken").alias("taken"))
    gaps = (goals.alias("g").join(taken.alias("t"), _same("g", "t", "source"))
            .select("g.source", (F.col("target") - F.col("taken")).alias("gap")))
    gap, size = F.col("gap"), F.col("c.size")
    place = F.when(gap > 0, F.col("up")).when(gap < 0, F.col("down"))
    moves = None
    for _ in range(REPAIRS):
        best = cut_lineage(
            groups.alias("c").join(gaps.alias("g"), _same("c", "g", "source"))
            .where(place.isNotNull() & (size < 2 * F.abs(gap)))
            .groupBy(F.col("c.source").alias("source"))
            .agg(F.min(F.struct(F.abs(size - F.abs(gap)).alias("off"), size.alias("size"), place.alias("place"),
                                F.signum(gap).cast("long").alias("by"))).alias("b"))
            .select("source", "b.size", "b.place", "b.by"))
        moves = best if moves is None else moves.union(best)
        gaps = (gaps.alias("g").join(best.alias("b"), _same("g", "b", "source"), "left")
                .select("g.source", (gap - F.coalesce(F.col("b.by") * F.col("b.size"), F.lit(0))).alias("gap")))
        groups = groups.alias("c").join(best.alias("b"), _same("c", "b", "source", "size"), "left_anti")
    return moves


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: every row as often as it is taken, with all columns as they are."""
    chosen = mix(docs, id_col, text_col, source_col)
    key = ["id", "mark", "source"]
    again = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    chosen = chosen.where("copies > 0").withColumn("again", again)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
                       F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"),
                       F.col(f"`{source_col}`").cast("string").alias("source")).withColumn("again", again)
    taken = (rows.alias("r").join(chosen.alias("c"), _same("r", "c", *key, "again"))
             .select("r.d", F.explode(F.sequence(F.lit(1), F.col("c.copies").cast("int"))).alias("copy")))
    return taken.select(*[F.col(f"d.`{c}`") for c in docs.columns])
