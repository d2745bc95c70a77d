"""Streams: ingest with late data, ordered folds, windows, interval joins, day-so-far scans.

Streams are read in event time: ``late`` is how much later than the newest row a row may arrive and still count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import folds as Q
from ..operators import identity as I
from ..session import shared_folder
from . import ordered as O

_SPAN = 8  # seconds of a source that meet as one key in the interval join
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _keyed_state(spark: SparkSession, partitions: int | None):
    """Timers need the RocksDB state store; other streams of the session keep their settings.

    Nothing here reads how many rows a store has, and counting them looks every written key up first.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_end(stream: DataFrame, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Process everything that is there, write it to a table in the shared folder and read it back.

    ``partitions``: into how many parts keyed state is dealt, for the life of the stream (the session's shuffles by default).
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with _keyed_state(spark, partitions):
        started = (
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .outputMode(mode).trigger(availableNow=True).start()
        )
        started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process everything that is there in update mode: every window is given out, closed or not.

    Each batch writes its updates into a partition of its own, so a batch that runs again replaces itself; the row of
    the newest batch counts for each key.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{base}/out")

    started = (
        stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{base}/state")
        .outputMode("update").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    written = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


class Ingest:
    """Day table of a stream with frozen days.

    A batch's rows of today and yesterday (by ``today()``, which never goes back) are written to ``table``, older rows and
    rows without a day to ``late``. Each batch owns its partitions, so a batch that runs again replaces itself. ``close``
    moves days that can get no more rows into ``closed``, one compact partition a day; ``read`` gives the whole table.
    """

    def __init__(self, folder: str, today: Callable[[DataFrame], str], keep_open: int = 1):
        self.table, self.late, self.closed = f"{folder}/open", f"{folder}/late", f"{folder}/closed"
        self.today, self.keep_open = today, keep_open

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` writer; the batch is read once for both tables."""
        rows = batch.withColumn("batch", F.lit(batch_id)).persist(StorageLevel.DISK_ONLY)
        fresh = F.coalesce(F.col("day") >= self._oldest(self.today(batch)), F.lit(False))
        for part, path in ((rows.where(fresh), self.table), (rows.where(~fresh), self.late)):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        rows.unpersist()

    def _oldest(self, today: str):
        return F.date_sub(F.lit(today).cast("date"), self.keep_open)

    def close(self, spark: SparkSession, schema: StructType, today: str) -> list[str]:
        """Compact the days older than the open ones; a run that dies between its steps is repeated harmlessly."""
        Path = spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.table).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(Path(self.table)):
            return []
        oldest = spark.range(1).select(self._oldest(today).cast("string")).first()[0]
        names = [s.getPath().getName() for s in fs.listStatus(Path(self.table))]
        days = sorted(n[4:] for n in names if n.startswith("day=") and n[4:] < oldest)
        if days:
            rows = self._open(spark, schema).where(F.col("day").isin([F.lit(d).cast("date") for d in days]))
            # a day is one partition of the shuffle, large days are cut by the writer
            rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
                "maxRecordsPerFile", 5_000_000).partitionBy("day").parquet(self.closed)
            for day in days:
                fs.delete(Path(f"{self.table}/day={day}"), True)
        return days

    def _open(self, spark: SparkSession, schema: StructType) -> DataFrame:
        return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(self.table).drop("batch")

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        Path = spark._jvm.org.apache.hadoop.fs.Path
        fs = Path(self.closed).getFileSystem(spark._jsc.hadoopConfiguration())
        rows = self._open(spark, schema) if fs.exists(Path(self.table)) else spark.createDataFrame([], schema)
        if not fs.exists(Path(self.closed)):
            return rows
        days = [s.getPath().getName()[4:] for s in fs.listStatus(Path(self.closed)) if s.getPath().getName().startswith("day=")]
        rows = rows.where(~F.col("day").isin([F.lit(d).cast("date") for d in days])) if days else rows
        return rows.unionByName(spark.read.schema(schema).parquet(self.closed))


def dedup_alerts(alerts: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming twin of ``folds.dedup_alerts``."""
    rows = alerts.withWatermark("ts", late)
    return O.run_dealt(Q.alert_seconds(rows, "ts"), O.Windows())


def rate_alerts(events: DataFrame, late: str = "1 day", **rule) -> DataFrame:
    """Streaming twin of ``folds.rate_alerts``; ``events(src, ts)``."""
    return O.run(events.withWatermark("ts", late).select("src", "ts", O.seconds(), F.lit(1).cast("bigint").alias("n")), O.Rate(**rule))


def failure_alerts(probes: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming twin of ``folds.failure_alerts``; ``probes(probe, ts, seq, ok)``."""
    rows = probes.withWatermark("ts", late).select("probe", "ts", O.seconds(), "seq", F.col("ok").cast("double").alias("sample"))
    return O.run(rows, O.Failures())


def load_changes(samples: DataFrame, late: str = "1 day", **rule) -> DataFrame:
    """Streaming twin of ``folds.load_changes`` straight from ``samples(host, ts, seq, sample)``: the means are kept here."""
    rows = samples.withWatermark("ts", late).select("host", "ts", O.seconds(), "seq", "sample")
    return O.run(rows, O.Load(**rule))


def first_sightings(keys: DataFrame, key: str, since, late: str = "1 day") -> DataFrame:
    """Keys never seen before, with the time. Keys first seen before ``since`` only seed."""
    seen = O.run(keys.withWatermark("ts", late).select(key, "ts", O.seconds()), O.First(key))
    return seen.where(F.col("sec") >= F.unix_timestamp(F.lit(since).cast("timestamp")))


def hourly_bytes(conn: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling hourly bytes per device."""
    rows = conn.where(F.col("src_local") & ~F.col("dst_local")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "src").agg(
        F.sum(F.col("orig_ip_bytes") + F.col("resp_ip_bytes")).alias("bytes")).select(F.col("w.start").alias("hour"), "src", "bytes")


def domain_minutes(dns: DataFrame, domain: str, late: str = "1 day") -> DataFrame:
    """Look-ups of a watched domain per minute and source."""
    rows = dns.where(F.lower("query").contains(domain.lower())).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 minute").alias("w"), "src").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("minute"), "src", "n")


def span_of(sec: Column) -> Column:
    return F.floor(sec / _SPAN)


def spans_near(sec: Column) -> Column:
    """The spans of the three seconds around ``sec``: one, or two at a span's edge."""
    return F.array_distinct(F.array(span_of(sec - 1), span_of(sec + 1)))


def domain_hosts(ssl: DataFrame, dns: DataFrame, others: DataFrame, domain: str, late: str = "1 hour") -> DataFrame:
    """Stream-stream join: (sec, src, kind, host), names a source looked up within a second of touching the domain, once each.

    ``dns`` and ``others`` are two reads of the look-ups. Both sides meet by equality on (src, span of ``_SPAN`` seconds),
    spread by the time as well as by the source. The interval is three whole seconds, so only an event at a span's edge is
    repeated, for the span beside it; a look-up is in one span and meets an event once. The time range in the condition
    lets the watermark remove both sides' state and that of the distinct.
    """
    domain = domain.lower()
    hit = lambda df, c, kind: df.where(F.lower(c).contains(domain)).select(
        F.date_trunc("second", "ts").alias("t"), "src", F.lit(kind).alias("kind"))
    events = hit(ssl, "server_name", "ssl").unionByName(hit(dns, "query", "dns")).withWatermark("t", late).dropDuplicates(["t", "src", "kind"])
    sec = F.unix_timestamp("t")
    events = events.withColumn("near", F.explode(spans_near(sec)))
    lookups = others.where(~F.lower("query").contains(domain) & (F.col("query") != "")).select(
        F.date_trunc("second", "ts").alias("q"), F.col("src").alias("src2"), F.col("query").alias("host"))
    lookups = lookups.withWatermark("q", late).dropDuplicates(["q", "src2", "host"])
    step = F.expr("interval 1 second")
    near = (F.col("src") == F.col("src2")) & (F.col("near") == span_of(F.unix_timestamp("q"))) & F.col("q").between(F.col("t") - step, F.col("t") + step)
    hosts = events.join(lookups, near).select("t", "src", "kind", "host").dropDuplicates(["t", "src", "kind", "host"])
    return hosts.select(F.unix_timestamp("t").alias("sec"), "src", "kind", "host")


def domain_pairs(
    ssl: DataFrame, dns: DataFrame, others: DataFrame, domain: str, top: int = 8, late: str = "1 hour", partitions: int | None = None
) -> DataFrame:
    """Streaming twin of ``identity.domain_pairs``: the joined rows come from the stream, the top eight from its table."""
    return I.top_hosts(run_to_end(domain_hosts(ssl, dns, others, domain, late), partitions=partitions), top)
