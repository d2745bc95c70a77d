"""Writers: day tables, versioned state, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replace exactly the days present in ``df``; other days of the table stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("v-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def read_state(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The newest complete version of a state table; None before the first run."""
    versions = _versions(spark, path)
    if not versions:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/v-{versions[-1]:012d}")


def write_state(df: DataFrame, path: str) -> int:
    """Write the next version beside the old ones; readers switch when it is complete.

    The new state may be computed from the old one, which is never overwritten.
    """
    spark = df.sparkSession
    fs, _ = _fs(spark, path)
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.tmp-{uuid.uuid4().hex}")
    df.write.parquet(made.toString())
    versions = _versions(spark, path)
    number = versions[-1] + 1 if versions else 0
    while True:  # another writer may take the number first: then the next one
        final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v-{number:012d}")
        if not fs.exists(final) and fs.rename(made, final):
            return number
        if not fs.exists(final):
            raise OSError(f"cannot rename {made} to {final}")
        number += 1


def append_stats(stats: DataFrame, path: str, component: str, ts) -> None:
    """Add one run's gate counts ``(reason, n)`` of a component."""
    stats.withColumn("component", F.lit(component)).withColumn("ts", F.lit(ts).cast("timestamp")).write.mode("append").parquet(path)


def latest_stats(stats: DataFrame) -> DataFrame:
    """Counts of each component's last run."""
    last = stats.groupBy("component").agg(F.max("ts").alias("ts"))
    return stats.join(last, ["component", "ts"])


def prune_days(spark: SparkSession, path: str, today, keep_days: int = 30, day: str = "day") -> list[str]:
    """Drop the day partitions older than the retention; returns what was dropped."""
    fs, root = _fs(spark, path)
    cutoff = spark.range(1).select(F.date_sub(F.lit(today).cast("date"), keep_days).cast("string")).first()[0]
    dropped = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{day}=") and name[len(day) + 1 :] < cutoff:
            fs.delete(status.getPath(), True)
            dropped.append(name)
    return sorted(dropped)
