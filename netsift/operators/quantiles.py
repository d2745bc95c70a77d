"""Exact quantiles by position: counts per value and running sums along the sorted values of a group.

Equal values are one row with a count, so a group is as long as it has distinct values. Its rows are sorted, which
spills, instead of kept in a hash map per group, which does not. Between two positions values are interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, keys: list[str], value: Column, name: str = "value") -> DataFrame:
    """(keys, value, n) of the values that are not null, summed before the shuffle."""
    return rows.select(*keys, value.alias(name)).where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("n"))


def with_quantiles(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float], n: str = "n") -> DataFrame:
    """``counts`` with a column for each share: the quantile of its group, each row weighing ``n``.

    All steps need the rows of a group together and sorted, so they share one shuffle.
    """
    group = Window.partitionBy(*keys)
    upto = F.sum(n).over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = counts.withColumn("_upto", upto).withColumn("_all", F.sum(n).over(group))
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col(n) <= rank) & (rank < F.col("_upto")), F.col(value))).over(group)
    places = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in shares.items()}
    out = out.withColumns({f"_{name}_{side}": at(f(place)) for name, place in places.items() for side, f in (("lo", F.floor), ("hi", F.ceil))})
    for name, place in places.items():
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        between = (F.ceil(place) - place) * lo + (place - F.floor(place)) * hi
        out = out.withColumn(name, F.when(lo == hi, lo).otherwise(between)).drop(f"_{name}_lo", f"_{name}_hi")
    return out.drop("_upto", "_all")


def quantiles(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float], n: str = "n") -> DataFrame:
    """One row per group: its quantiles."""
    return with_quantiles(counts, keys, value, shares, n).groupBy(*keys).agg(*[F.max(name).alias(name) for name in shares])
