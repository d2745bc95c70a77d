"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by source and exact length in words. A source's target is filled with whole passes over the source
as far as they fit, then with whole documents of the next pass: of every length the share that the remaining budget asks
for, the longest that still fit after that, and last a bounded-knapsack programme over the counts that are left finds
how many documents of each length come closest to what remains. Which documents of a length are taken is settled by a
seeded hash, so reruns agree.

Targets: sources in code-point order (null last) have the weights 5, 2, 1, repeating. They share 150 percent of all
words; no target exceeds twice its source, and what is above goes to the others by weight until none is.

Rows: a null or empty text has size 0 and takes 0; a null source is a source; repeated rows are documents of their own
(equal ones are interchangeable); an empty table gives an empty result; further columns are ignored.

The tables that single tasks see: sources (one row each, ordered once for the targets) and one source's lengths (their
number is at most the square root of twice the source's words, since distinct lengths add up).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
BUDGET = 1 << 17  # words that the programme fills; what the steps before it leave is less wherever lengths allow
_GROUP = 2000  # documents of one length that are ranked together


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Capped targets are those whose cap per weight is lowest: ordered by it, the level at which the rest share evenly
    follows from running sums.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("weight", F.element_at(pattern, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # the level if this source and all after it were below their caps; true from the first one on that is
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - below) / open_weight
    rows = rows.withColumn("own_level", level)
    found = F.max(F.when(F.col("own_level") * F.col("weight") <= F.col("cap"), F.col("own_level"))).over(everything)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(found * F.col("weight"), F.col("cap"))).alias("target"))


def fill(sizes: list[int], counts: list[int], budget: int, room: int = BUDGET) -> list[int]:
    """How many documents of each size (ascending, above 0) to take, so that their words come nearest under ``budget``."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(sizes)
    taken = [c * budget // total for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, taken))
    for k in range(len(sizes) - 1, -1, -1):  # the programme is to fill the rest: leave it room, and small lengths
        if left <= room // 2:
            break
        more = min(counts[k] - taken[k], (left - room // 2) // sizes[k])
        taken[k] += more
        left -= more * sizes[k]
    # Bounded knapsack: bit b of ``reach`` says that b words can be made; counts are split into powers of two.
    limit = min(left, max(room, 2 * sizes[-1]))
    mask = (1 << (limit + 1)) - 1
    reach, steps = 1, []
    for k, s in enumerate(sizes):
        spare, part = min(counts[k] - taken[k], limit // s), 1
        while spare > 0 and not reach >> limit & 1:
            part = min(part, spare)
            before = reach
            reach |= (reach << (s * part)) & mask
            if reach != before:
                steps.append((k, part, before))
            spare -= part
            part *= 2
        if reach >> limit & 1 or len(steps) > 4000:
            break
    goal = reach.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> goal & 1:
            taken[k] += part
            goal -= part * sizes[k]
    return taken


def mix(spark: SparkSession, documents: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = store(documents.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    lengths = store(rows.groupBy("source", "size").count(), "lengths")
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")))

    def plan(pdf):
        pdf = pdf.sort_values("size").reset_index(drop=True)
        size, target = int(pdf["source_size"].iloc[0]), int(round(pdf["target"].iloc[0]))
        passes = min(int(MOST), target // size) if size else 0
        pdf["passes"], pdf["picked"] = passes, 0
        some = pdf.index[pdf["size"] > 0]
        if len(some) and passes < MOST:
            pdf.loc[some, "picked"] = fill(pdf["size"][some].tolist(), pdf["count"][some].tolist(), target - passes * size)
        return pdf[["source", "size", "count", "source_size", "target", "passes", "picked"]]

    schema = "source string, size long, count long, source_size long, target double, passes long, picked long"
    # a null key must reach its group as well, so the join is null-safe
    both = lengths.alias("l").join(goal.alias("g"), F.col("l.source").eqNullSafe(F.col("g.source"))).select("l.*", "source_size", "target")
    quota = store(both.groupBy("source").applyInPandas(plan, schema), "quota")

    q = quota.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), "count", "source_size", "target", "passes", "picked")
    told = rows.join(q, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size"))).drop("q_source", "q_size")
    # Documents of one length are ranked by hash in groups of bounded size: whole groups first, one group in part.
    draw = F.xxhash64("doc_id", F.lit(seed))
    told = told.withColumn("draw", draw).withColumn("slice", F.floor(F.pmod(draw, F.lit(1 << 40)) / float(1 << 40) * F.ceil(F.col("count") / _GROUP)))
    told = store(told, "told")
    slices = told.groupBy("source", "size", "slice").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), F.col("slice").alias("s_slice"), F.coalesce(before, F.lit(0)).alias("before"))
    told = told.join(slices, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("slice") == F.col("s_slice")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "doc_id"))
    taken = F.col("size") * (F.col("passes") + F.when(place <= F.col("picked"), 1).otherwise(0))
    return told.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture(spark: SparkSession, documents: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix, all their columns, each as often as it is taken.

    Rows are found again by id; an id that stands in several rows is taken for each of them as often as for the first.
    """
    picked = mix(spark, documents, seed).where("taken > 0").select("doc_id", F.expr("cast(taken / size as int)").alias("__mix_times"))
    picked = picked.groupBy(F.col("doc_id").alias("__mix_id")).agg(F.max("__mix_times").alias("__mix_times"))
    rows = documents.join(picked, F.col("doc_id").eqNullSafe(F.col("__mix_id")))
    return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), "__mix_times"))).select(*documents.columns)
