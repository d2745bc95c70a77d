"""Ordered folds: rules whose next step depends on the last one (windows that open at an event).

A fold sees one key's rows in time order in small batches, with a few numbers as state; nothing is collected
per key. ``streaming.ordered`` has the same rules for streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions.flags import alert_fingerprint, alert_ttl_seconds
from .skew import in_chunks

# (state or None, rows of one key in time order) -> (new state, output rows)
Fold = Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def walk_sorted(df: DataFrame, key: str, order: list[str], fold: Fold, schema: str) -> DataFrame:
    """Run a fold over a table: rows meet their key by one shuffle and are read in sorted order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            for k, rows in batch.groupby(key, sort=False, dropna=False):
                k = None if pd.isna(k) else k  # a null key is a key
                state, out = fold(state if k == last and state is not None else None, rows)
                last = k
                if len(out):
                    yield out

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


# -- alerts: fixed window from the first sent one ---------------------------------------------------
TTL_SCHEMA = "fingerprint string, type string, severity string, device string, detail string, sec bigint"


def alert_seconds(alerts: DataFrame, *more: str) -> DataFrame:
    """Alerts with their key and window length, and further columns."""
    return alerts.select(
        *more,
        alert_fingerprint("type", "severity", "device", "detail").alias("fingerprint"), "type", "severity", "device", "detail",
        F.unix_timestamp("ts").alias("sec"), alert_ttl_seconds("severity").alias("ttl"),
    )


def ttl_fold(state, rows):
    until = state[0] if state else -1
    keep = []
    for sec, ttl in zip(rows["sec"].tolist(), rows["ttl"].tolist()):
        send = sec >= until
        if send:
            until = sec + ttl
        keep.append(send)
    return (until,), rows.loc[keep, ["fingerprint", "type", "severity", "device", "detail", "sec"]]


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts that are sent: the first opens a fixed window (6 h high, 1 h others); repeats inside it
    are dropped and do not extend it. Input ``(type, severity, device, detail, ts)``."""
    return walk_sorted(alert_seconds(alerts).distinct(), "fingerprint", ["sec"], ttl_fold, TTL_SCHEMA)


# -- rate threshold: once per window when enough hits fall into it ----------------------------------
RATE_SCHEMA = "src string, sec bigint"


def rate_fold(state, rows, count=C.RATE_COUNT, seconds=C.RATE_SECONDS):
    """Window opens at a hit; the hit that reaches ``count`` fires, the rest of the window is silent."""
    start, hits = state if state else (None, 0)
    out = []
    for src, sec, n in zip(rows["src"].tolist(), rows["sec"].tolist(), rows["n"].tolist()):
        if start is None or sec >= start + seconds:
            start, hits = sec, 0
        if hits < count <= hits + n:
            out.append((src, sec))
        hits += n
    return (start, hits), pd.DataFrame(out, columns=["src", "sec"])


def rate_hits(events: DataFrame) -> DataFrame:
    return events.groupBy("src", F.unix_timestamp("ts").alias("sec")).agg(F.count("*").alias("n"))


def rate_alerts(events: DataFrame, count: int = C.RATE_COUNT, seconds: int = C.RATE_SECONDS) -> DataFrame:
    """``events(src, ts)`` -> one row per source and window that reached the threshold."""
    fold = lambda state, rows: rate_fold(state, rows, count, seconds)
    return walk_sorted(rate_hits(events), "src", ["sec"], fold, RATE_SCHEMA)


# -- consecutive failures ---------------------------------------------------------------------------
def failure_alerts(probes: DataFrame) -> DataFrame:
    """``probes(probe, sec, seq, ok)``; ``seq`` orders results of the same second.

    "The third failure in a row" only looks three rows back, so over a table it is a window on
    overlapping chunks and a busy probe is spread over many tasks.
    """
    n = C.FAILURE_THRESHOLD
    rows = probes.select("probe", "sec", "seq", "ok")
    spread = in_chunks(rows, "probe", ["sec", "seq"], F.floor(F.col("sec") / 3600), n)
    w = Window.partitionBy("probe", "chunk").orderBy("no")
    streak = ~F.col("ok")
    for back in range(1, n):
        streak = streak & ~F.coalesce(F.lag("ok", back).over(w), F.lit(True))
    fresh = F.coalesce(F.lag("ok", n).over(w), F.lit(True))
    fired = spread.withColumn("_fire", streak & fresh)
    return fired.where((F.col("chunk") == F.col("home")) & F.col("_fire")).select("probe", "sec")


# -- sustained load ---------------------------------------------------------------------------------
GAUGE_SCHEMA = "host string, sec bigint, mean double, elevated boolean"


def gauge_fold(state, rows, threshold=C.GAUGE_THRESHOLD, reset=C.GAUGE_RESET_BELOW, realert=C.GAUGE_REALERT_HOURS * 3600):
    """Alert when the long mean is high and the last alert is four hours old; the elevated mark clears
    when the short mean falls below the reset line."""
    last, elevated = state if state else (None, False)
    out = []
    for host, sec, mean, short in zip(rows["host"].tolist(), rows["sec"].tolist(), rows["mean"].tolist(), rows["short_mean"].tolist()):
        if elevated and short < reset:
            elevated = False
        if mean >= threshold and (last is None or last < 0 or sec - last >= realert):
            last, elevated = sec, True
            out.append((host, sec, mean, elevated))
    return (-1 if last is None else last, elevated), pd.DataFrame(out, columns=["host", "sec", "mean", "elevated"])


def load_changes(means: DataFrame, threshold: float = C.GAUGE_THRESHOLD, reset_below: float = C.GAUGE_RESET_BELOW,
                 realert: int = C.GAUGE_REALERT_HOURS * 3600) -> DataFrame:
    """Alerts and clears ``(host, sec, mean, elevated)`` from ``means(host, time, event_id, mean, short_mean)``: an alert sets
    the elevated mark, the first sample after it whose short mean is low clears it.

    Alerts come from the ordered fold; whether a low sample clears one is a window over alerts and low samples alone.
    """
    rows = means.select("host", F.unix_timestamp("time").alias("sec"), "event_id", "mean", "short_mean")
    fold = lambda state, part: _alert_fold(state, part, threshold, realert)
    high = walk_sorted(rows.where(F.col("mean") >= threshold), "host", ["sec", "event_id"], fold, "host string, sec bigint, event_id bigint, mean double")
    low = rows.where(F.col("short_mean") < reset_below).select("host", "sec", "event_id", "mean", F.lit(False).alias("elevated"))
    both = low.unionByName(high.withColumn("elevated", F.lit(True)))
    # a sample may clear the old mark and alert anew: the clear comes first; the rule looks one row back
    spread = in_chunks(both, "host", ["sec", "event_id", "elevated"], F.floor(F.col("sec") / 3600), 1)
    before = F.lag("elevated").over(Window.partitionBy("host", "chunk").orderBy("no"))
    kept = F.col("elevated") | F.coalesce(before, F.lit(False))
    return spread.withColumn("_kept", kept).where((F.col("chunk") == F.col("home")) & F.col("_kept")).select("host", "sec", "mean", "elevated")


def _alert_fold(state, rows, threshold, realert):
    last, out = state[0] if state else None, []
    for host, sec, event, mean in zip(*[rows[c].tolist() for c in ("host", "sec", "event_id", "mean")]):
        if last is None or sec - last >= realert:
            last = sec
            out.append((host, sec, event, mean))
    return (last,), pd.DataFrame(out, columns=["host", "sec", "event_id", "mean"])


def gauge_alerts(means: DataFrame) -> DataFrame:
    """``means(host, time, event_id, mean, short_mean)`` from ``telemetry.rolling_mean``.

    Samples that can neither alert nor clear the elevated mark do not reach the walk.
    """
    means = means.where((F.col("mean") >= C.GAUGE_THRESHOLD) | (F.col("short_mean") < C.GAUGE_RESET_BELOW))
    rows = means.select("host", F.unix_timestamp("time").alias("sec"), "event_id", "mean", "short_mean")
    return walk_sorted(rows, "host", ["sec", "event_id"], gauge_fold, GAUGE_SCHEMA)
