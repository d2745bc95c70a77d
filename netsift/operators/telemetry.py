"""Host telemetry: roll-ups, state changes, sustained load, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogues as C
from .quantiles import quantiles, value_counts
from .skew import CHUNK, in_chunks


def hourly(t: DataFrame) -> DataFrame:
    """Gauges roll up by maximum, flags by OR, consumers from the record at the hour's peak (the later one on ties)."""
    peak = lambda gauge, top: F.max(F.when(F.col(top).isNotNull() & F.col(gauge).isNotNull(), F.struct(gauge, "time", "event_id", top)))[top]
    return t.groupBy("host", F.date_trunc("hour", "time").alias("hour")).agg(
        F.max("temp_c").alias("temp_c"), F.max("cpu_pct").alias("cpu_pct"), F.max("mem_pct").alias("mem_pct"),
        peak("cpu_pct", "top_cpu").alias("top_cpu"), peak("mem_pct", "top_mem").alias("top_mem"),
        F.coalesce(F.max("fan_1"), F.lit(False)).alias("fan_1"), F.coalesce(F.max("fan_2"), F.lit(False)).alias("fan_2"))


def transitions(t: DataFrame, flag: str) -> DataFrame:
    """Changes of a flag per host.

    Counted inside each (host, hour) and across hour borders from the first and last value of each
    hour, so a host's history is never one sort.
    """
    order = ["time", "event_id"]
    before = F.lag(flag).over(Window.partitionBy("host", "hour").orderBy(*order))
    inside = t.select("host", *order, F.coalesce(F.col(flag), F.lit(False)).alias(flag), F.date_trunc("hour", "time").alias("hour"))
    per_hour = inside.withColumn("_b", before).groupBy("host", "hour").agg(
        F.count_if(F.col("_b") != F.col(flag)).alias("n"), F.min(F.struct(*order, flag))[flag].alias("first"),
        F.max(F.struct(*order, flag))[flag].alias("last"))
    border = F.lag("last").over(Window.partitionBy("host").orderBy("hour"))
    return per_hour.withColumn("_l", border).groupBy("host").agg(
        (F.sum("n") + F.count_if(F.col("_l") != F.col("first"))).alias("transitions"))


def duty(t: DataFrame, flag: str, other: str) -> DataFrame:
    """Share of samples with the flag on, changes per hour (60 samples), peak, median temperature with both off."""
    idle = ~F.coalesce(F.col(flag), F.lit(False)) & ~F.coalesce(F.col(other), F.lit(False))
    stats = t.groupBy("host").agg(
        F.count("*").alias("samples"), (F.count_if(flag) * 100.0 / F.count("*")).alias("duty_pct"),
        F.max("temp_c").alias("peak_c"))
    median = quantiles(value_counts(t, ["host"], F.when(idle, F.col("temp_c"))), ["host"], "value", {"idle_median_c": 0.5})
    j = stats.join(median, "host", "left").join(transitions(t, flag), "host")
    return j.withColumn("transitions_per_hour", F.col("transitions") / (F.col("samples") / 60.0))


def rolling_mean(t: DataFrame, gauge: str = "cpu_pct", window: int = C.GAUGE_WINDOW, reset: int = C.GAUGE_RESET_WINDOW,
                 chunk: int = CHUNK) -> DataFrame:
    """Mean of the last 60 (and 30) samples per host, once 60 exist.

    Computed per chunk of a host's samples, so a host with most of the samples is spread over many tasks.
    """
    order = ["time", "event_id"]
    rows = t.where(F.col(gauge).isNotNull()).select("host", *order, gauge)
    spread = in_chunks(rows, "host", order, F.date_trunc("hour", "time"), window - 1, chunk)
    w = Window.partitionBy("host", "chunk").orderBy("no")
    means = spread.withColumn("mean", F.avg(gauge).over(w.rowsBetween(1 - window, 0))).withColumn(
        "short_mean", F.avg(gauge).over(w.rowsBetween(1 - reset, 0)))
    return means.where((F.col("chunk") == F.col("home")) & (F.col("no") >= window)).select("host", *order, "no", "mean", "short_mean")


def hot_alerts(means: DataFrame, threshold: float = C.GAUGE_THRESHOLD) -> DataFrame:
    """Samples whose long mean is over the line, as alert events; ``gate.dedup_alerts`` style windows decide which are sent."""
    return means.where(F.col("mean") >= threshold).select(
        F.lit("sustained_high_cpu").alias("type"), F.lit("medium").alias("severity"), F.col("host").alias("device"),
        F.lit("mean over the window at or above the threshold").alias("detail"), F.col("time").alias("ts"))


def capture_rate(conn: DataFrame, now, sensor: str = "proto") -> DataFrame:
    """Rows of the last five minutes per sensor: ok above ten, warn above zero, else fail."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts")
    recent = (age >= 0) & (age < C.CAPTURE_SECONDS)
    n = conn.groupBy(F.col(sensor).alias("sensor")).agg(F.count_if(recent).alias("rows"))
    return n.withColumn("status", F.when(F.col("rows") > C.CAPTURE_OK_ROWS, "ok").when(F.col("rows") > 0, "warn").otherwise("fail"))


def freshness(imports: DataFrame, now, ts: str = "ts", source: str = "source") -> DataFrame:
    """Age of the last successful import per source: warn from 90 minutes, fail from six hours."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(ts))
    return imports.groupBy(F.col(source).alias("source")).agg(age.alias("age_seconds")).withColumn(
        "status", F.when(F.col("age_seconds") >= C.FRESH_FAIL_SECONDS, "fail").when(F.col("age_seconds") >= C.FRESH_WARN_SECONDS, "warn").otherwise("ok"))


def chart_bounds(t: DataFrame, gauge: str) -> DataFrame:
    """2nd and 98th percentile per host, the chart's axis."""
    hosts = t.select("host").distinct()
    return hosts.join(quantiles(value_counts(t, ["host"], F.col(gauge)), ["host"], "value", {"p2": 0.02, "p98": 0.98}), "host", "left")
