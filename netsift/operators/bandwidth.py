"""Bytes per device, hour and destination, on IP-layer counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import with_ranges

OTHER = "__other__"


def wan_flows(conn: DataFrame) -> DataFrame:
    """Flows from inside to outside. IP byte counters are used: payload estimates can wrap."""
    return conn.where(F.col("src_local") & ~F.col("dst_local")).withColumn(
        "bytes", F.col("orig_ip_bytes") + F.col("resp_ip_bytes")
    )


def _sums():
    return [
        F.sum("orig_ip_bytes").alias("up_bytes"), F.sum("resp_ip_bytes").alias("down_bytes"),
        F.sum("bytes").alias("total_bytes"), F.count("*").alias("flows"),
    ]


def talkers(conn: DataFrame) -> DataFrame:
    """Per device: bytes up, down and total, flows, distinct destinations, last activity.

    Folded per (src, dst) first: the distinct count then needs no set and a busy device is spread
    over its destinations.
    """
    pairs = wan_flows(conn).groupBy("src", "dst").agg(*_sums(), F.max("ts").alias("last_active"))
    return pairs.groupBy("src").agg(
        *[F.sum(c).alias(c) for c in ("up_bytes", "down_bytes", "total_bytes", "flows")],
        F.count("*").alias("external_dests"), F.max("last_active").alias("last_active"),
    )


def top_talkers(conn: DataFrame, n: int = 8) -> DataFrame:
    return talkers(conn).orderBy(F.desc("total_bytes"), "src").limit(n)


def hourly(conn: DataFrame, top_n: int = 8) -> DataFrame:
    """Bytes per hour for the biggest devices and ``__other__``, in long form; absent hours are 0."""
    by_hour = wan_flows(conn).groupBy("src", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("bytes").alias("bytes"))
    top = by_hour.groupBy("src").agg(F.sum("bytes").alias("b")).orderBy(F.desc("b"), "src").limit(top_n)
    top = top.select("src", F.col("src").alias("series"))
    cells = (
        by_hour.join(top, "src", "left").withColumn("series", F.coalesce("series", F.lit(OTHER)))
        .groupBy("hour", "series").agg(F.sum("bytes").alias("bytes"))
    )
    # Zero cells: the hours present times at most top_n + 1 series, as one array per hour.
    per_hour = cells.groupBy("hour").agg(F.map_from_entries(F.collect_list(F.struct("series", "bytes"))).alias("m"))
    names = cells.agg(F.sort_array(F.collect_set("series"))).scalar()
    return per_hour.withColumn("series", F.explode(names)).select(
        "hour", "series", F.coalesce(F.try_element_at("m", F.col("series")), F.lit(0)).alias("bytes")
    )


def hourly_wide(conn: DataFrame, series: list[str]) -> DataFrame:
    """The chart form: one column per named device plus ``__other__``."""
    named = F.when(F.col("src").isin(series), F.col("src")).otherwise(OTHER)
    return (
        wan_flows(conn).withColumn("series", named).groupBy(F.date_trunc("hour", "ts").alias("hour"))
        .pivot("series", [*series, OTHER]).agg(F.sum("bytes")).fillna(0)
    )


def summary(conn: DataFrame) -> DataFrame:
    """Totals, device count, top device and peak hour (earliest on ties), as one row."""
    by_hour = wan_flows(conn).groupBy("src", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum("orig_ip_bytes").alias("up"), F.sum("resp_ip_bytes").alias("down"), F.sum("bytes").alias("bytes")
    )
    hours = by_hour.groupBy("hour").agg(F.sum("bytes").alias("bytes"))
    peak = hours.agg(F.max(F.struct("bytes", (-F.unix_timestamp("hour")).alias("neg"))).alias("_p"))
    devices = by_hour.groupBy("src").agg(*[F.sum(c).alias(c) for c in ("up", "down", "bytes")])
    total = devices.agg(
        F.sum("bytes").alias("total_bytes"), F.sum("up").alias("up_bytes"), F.sum("down").alias("down_bytes"),
        F.count("*").alias("device_count"), F.max(F.struct("bytes", "src")).alias("_top"),
    )
    return total.withColumn("_peak", peak.scalar()).select(
        "total_bytes", "up_bytes", "down_bytes", "device_count",
        F.col("_top.src").alias("top_device"), F.col("_top.bytes").alias("top_device_bytes"),
        F.timestamp_seconds(-F.col("_peak.neg")).alias("peak_hour"), F.col("_peak.bytes").alias("peak_hour_bytes"),
    )


def destinations(conn: DataFrame, geo: DataFrame, limit: int = 20) -> DataFrame:
    """Biggest destinations with their distinct sources and owner."""
    pairs = wan_flows(conn).groupBy("dst", "src").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("flows"))
    top = (
        pairs.groupBy("dst").agg(
            F.sum("bytes").alias("total_bytes"), F.sum("flows").alias("flows"), F.count("*").alias("distinct_sources"),
        ).orderBy(F.desc("total_bytes"), "dst").limit(limit)
    )
    return with_ranges(top, "dst", geo, ["cc", "city", "org"])


def device_destinations(conn: DataFrame, geo: DataFrame, src: str, direction: str = "down", limit: int = 10) -> DataFrame:
    """One device's destinations by bytes sent (``up``) or received (``down``)."""
    order = "up_bytes" if direction == "up" else "down_bytes"
    top = (
        wan_flows(conn).where(F.col("src") == src).groupBy("dst").agg(*_sums())
        .orderBy(F.desc(order), "dst").limit(limit)
    )
    return with_ranges(top, "dst", geo, ["cc", "city", "org"])
