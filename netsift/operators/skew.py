"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

SALTS = 16
CHUNK = 4096


def salted_semi(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """``left_semi`` on ``keys`` with every key of ``left`` spread over ``salts`` tasks.

    ``spread`` is any column that varies within a key; the key list on the right is repeated per
    salt, which is cheap because it holds keys only.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    keys_only = right.select(*keys).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(keys_only, [*keys, "_salt"], "left_semi").drop("_salt")


def left_lookup(df: DataFrame, value: Column, found: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """``df`` left joined with ``found`` (a row per ``key``) where ``value`` equals ``key``; ``key`` goes.

    ``found`` is written down, so its size is known: a small one is broadcast and the rows stay where they are. For a large
    one rows without a value, which match nothing, are spread over the tasks instead of meeting in one.
    """
    found = checkpoint(found.withColumnRenamed(key, "_key").withColumn("_place", F.lit(0)))
    place = F.when(value.isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int") + 1).otherwise(0)
    return df.join(found, (value == F.col("_key")) & (place == F.col("_place")), "left").drop("_key", "_place")


def in_chunks(rows: DataFrame, key: str, order: list[str], coarse: Column, overlap: int, chunk: int = CHUNK) -> DataFrame:
    """Number each key's rows along ``order`` and cut them into chunks that overlap, so that a window
    of up to ``overlap`` earlier rows can be taken per (key, chunk) instead of per key.

    Adds ``no`` (1-based), ``chunk`` and ``home``; a row counts where ``chunk = home``, its other copy
    only serves the next chunk. ``coarse`` is a bucket that grows with ``order`` (an hour): numbers
    come from bucket counts plus the place inside the bucket, so no step sorts a whole key.
    """
    if overlap > chunk:
        raise ValueError("a window reaches back over more than one chunk: raise chunk")
    rows = rows.withColumn("_coarse", coarse)
    counts = rows.groupBy(key, "_coarse").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_coarse", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(key, "_coarse").orderBy(*order))
    starts = starts.withColumnsRenamed({key: "_key", "_coarse": "_bucket"})
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_coarse").eqNullSafe(F.col("_bucket"))  # a null key is a key
    numbered = rows.join(starts, same).withColumn("no", F.col("_start") + inside).drop("_coarse", "_start", "_key", "_bucket")
    home = F.floor((F.col("no") - 1) / chunk)
    serves_next = (F.col("no") - 1) % chunk >= chunk - overlap
    copies = F.when(serves_next, F.array(home, home + 1)).otherwise(F.array(home))
    return numbered.withColumn("home", home).withColumn("chunk", F.explode(copies))
