"""Same-day detectors that read a day's folded rows instead of scanning the day again after every batch.

A scan folds a batch into few rows from which its alerts can be told; folds of several batches merge into the fold of all
their rows (sums, minima, distinct rows, the last few by time). Each batch's folds are a partition of their own, so a
batch that runs again replaces itself; days that a batch touched are merged and judged anew, the others are left alone.
What was detected is written per batch; ``folds.dedup_alerts`` decides what is sent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import ip as IP
from ..operators.network import top_per
from ..operators.suppress import drop_devices as drop_listed

ALERTS = "day date, type string, device string, detail string"


@dataclass
class Part:
    """One kind of folded rows of a scan; all have a ``day``."""

    fold: Callable[[DataFrame], DataFrame]  # rows of a batch -> folded rows
    merge: Callable[[DataFrame], DataFrame]  # folded rows of several batches -> folded rows


@dataclass
class Scan:
    parts: dict[str, Part]
    detect: Callable[..., DataFrame]  # merged parts by name -> alerts(day, type, device, detail)


def sums(keys: list[str], *values: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def print_part() -> Part:
    """Fingerprint counts per day, source and print."""
    from ..operators.fingerprints import wan_prints

    return Part(wan_prints, sums(["day", "src", "ja4"], "n"))


def flow_part() -> Part:
    """Time and bytes per flow of an inside source; in the shape of flows, so ``relay.relay_flows`` reads them."""
    keys, values = ["day", "src", "dst", "dst_port", "proto"], ["duration", "orig_ip_bytes", "resp_ip_bytes"]
    merge = sums(keys, *values)
    return Part(lambda conn: merge(conn.where(IP.is_lan("src")).withColumn("proto", F.lower("proto"))), merge)


def tls_part() -> Part:
    """Distinct names and prints per flow of an inside source."""
    keep = lambda rows: rows.select("day", "src", "dst", "dst_port", "server_name", "ja4").distinct()
    return Part(lambda ssl: keep(ssl.where(IP.is_lan("src"))), keep)


def arp_part(last_bad: int = 20) -> Part:
    """One row per claim and the last malformed ones; in the shape of ARP rows, so ``network.l2_anomalies`` reads them."""
    columns = ["event_id", "ts", "day", "operation", "src_mac", "src_ip", "info"]

    def keep(arp: DataFrame) -> DataFrame:
        rows = arp.select(*columns)
        claim = rows.where("operation <> 'bad'").groupBy("day", F.lower("src_mac").alias("src_mac"), F.trim("src_ip").alias("src_ip")).agg(
            F.min(F.struct("event_id", "ts", "operation", "info")).alias("_f"))
        claim = claim.select("_f.event_id", "_f.ts", "day", "_f.operation", "src_mac", "src_ip", "_f.info")
        return claim.unionByName(top_per(rows.where("operation = 'bad'"), ["day"], [F.desc("ts"), F.desc("event_id")], last_bad).select(*columns))

    return Part(keep, keep)


def priority_part() -> Part:
    """Priority-one alerts per day, signature and source: how many, and the first."""
    from ..operators.ids import p1_fold

    merge = lambda rows: rows.groupBy("day", "sid", "src_ip").agg(F.sum("n").alias("n"), F.min("f").alias("f"))
    return Part(p1_fold, merge)


class DayScans:
    """``foreachBatch`` runner: ``write`` folds a batch, merges the touched days and writes what the scans find."""

    def __init__(self, folder: str, scans: dict[str, Scan], logs: Callable[[DataFrame], dict[str, DataFrame]]):
        self.folder, self.scans, self.logs = folder, scans, logs
        self.alerts = f"{folder}/alerts"

    def _write(self, rows: DataFrame, path: str, batch_id: int, by: list[str]) -> None:
        rows = rows.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist(StorageLevel.DISK_ONLY)  # read once for all folds
        logs = self.logs(rows)
        days = [r[0] for r in rows.select("day").where("day is not null").distinct().collect()]
        if not days:
            rows.unpersist()
            return
        found = None
        for name, scan in self.scans.items():
            merged = {}
            for part, how in scan.parts.items():
                path = f"{self.folder}/{name}-{part}"
                folded = how.fold(logs[part])
                self._write(folded, path, batch_id, ["day"])
                kept = spark.read.schema(StructType([*folded.schema.fields, StructField("batch", LongType())])).parquet(path)
                merged[part] = how.merge(kept.where((F.col("batch") <= batch_id) & F.col("day").isin(days)).drop("batch"))
            alerts = scan.detect(**merged).select("day", "type", "device", "detail", F.lit(name).alias("scan"))
            found = alerts if found is None else found.unionByName(alerts)
        # a day without alerts is marked as judged, so that what an earlier batch found on it is not read any more
        marks = spark.createDataFrame([(d,) for d in days], "day date").select("day", *[F.lit(None).cast("string").alias(c) for c in ("type", "device", "detail", "scan")])
        self._write(found.unionByName(marks), self.alerts, batch_id, [])
        rows.unpersist()

    def latest(self, spark: SparkSession) -> DataFrame:
        """(scan, day, type, device, detail): what the newest batch of each day found."""
        rows = spark.read.schema(f"{ALERTS}, scan string, batch long").parquet(self.alerts)
        newest = rows.groupBy("day").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["day", "batch"]).where("scan is not null").select("scan", "day", "type", "device", "detail")
