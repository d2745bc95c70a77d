"""Registered queries: ordered folds over tables, and the same rules run as streams."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bandwidth as B
from ..operators import fingerprints as P
from ..operators import folds as Q
from ..operators import ids as D
from ..operators import network as W
from ..operators import relay as Y
from ..operators import telemetry as M
from ..session import checkpoint, shared_folder
from ..streaming import jobs as J
from ..streaming import scans as S
from ..streaming.jobs import run_updates
from . import reference_lists as L
from .adapters import Views
from .oracle_views import with_views
from .queries_network import _FPM, PAIRS_SQL, WAN
from .queries_scoring import _base
from .registry import ORACLE, query


class StreamViews(Views):
    """The same views, with events arriving as a stream."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        batch = super().table(name)
        return self.spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(self.dir)


LATE_HOURS = 6


_GROUP_BYTES = 4 << 20


def arriving(rows: DataFrame, arrival: str) -> str:
    """Write ``rows`` as files in the order of the number ``arrival``, one file each, and give the folder.

    A file is a micro-batch. Its row groups are small, since they are what Spark deals to the tasks: a large file
    in a few of the usual size would be read, joined and folded by a few tasks, however many cores there are.
    """
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    rows.write.partitionBy(arrival).parquet(f"{base}/staged")
    staged = spark.read.parquet(f"{base}/staged")
    for (k,) in sorted(staged.select(arrival).distinct().collect()):
        staged.where(F.col(arrival) == k).drop(arrival).coalesce(1).write.mode("append").option("parquet.block.size", _GROUP_BYTES).parquet(f"{base}/files")
    return f"{base}/files"


class ArrivingViews(Views):
    """The same views over flows that come in several files, each row up to six hours after its time.

    A last file holds one row without any value two days later: the clock that lets the watermark pass everything.
    """

    def __init__(self, v: Views, folder: str | None = None):
        super().__init__(v.spark, v.dir)
        self.batch, self._folder = v, folder

    @cached_property
    def folder(self) -> str:
        if self._folder:
            return self._folder
        rows = self.batch.flows
        sec = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATE_HOURS * 3600))
        clock = rows.agg(F.max("ts").alias("ts")).select(
            *[(F.col("ts") + F.expr("interval 2 days") if c == "ts" else F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes])
        rows = rows.withColumn("_a", F.floor(sec / (10 * 86400))).unionByName(clock.withColumn("_a", F.lit(1 << 40)))
        return arriving(rows, "_a")

    @cached_property
    def flows(self) -> DataFrame:
        return self.spark.readStream.schema(self.batch.flows.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)

    def run(self, stream: DataFrame) -> DataFrame:
        return J.run_to_end(stream, partitions=self.spark.sparkContext.defaultParallelism)


def _device_alerts(v: Views) -> DataFrame:
    return v.flows.select(
        F.lit("flow").alias("type"), F.when(F.col("event_type") == "error", "high").otherwise("medium").alias("severity"),
        F.col("src").alias("device"), F.col("event_type").alias("detail"), "ts")


_DEDUP = with_views("", "flows").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
  a AS (SELECT DISTINCT src, event_type AS e, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CASE WHEN event_type = 'error' THEN 21600 ELSE 3600 END AS ttl FROM flows),
  s AS (SELECT src, e, ttl, min(sec) AS sec FROM a GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT s.src, s.e, s.ttl, (SELECT min(a.sec) FROM a WHERE a.src = s.src AND a.e = s.e AND a.sec >= s.sec + s.ttl) AS sec FROM s) WHERE sec IS NOT NULL)
SELECT 'flow' AS type, CASE WHEN e = 'error' THEN 'high' ELSE 'medium' END AS severity, src AS device, e AS detail, sec FROM s"""
_show = lambda df: df.select("type", "severity", "device", "detail", "sec")
query("alert_dedup_devices", lambda v: _show(Q.dedup_alerts(_device_alerts(v))), _DEDUP)

_LATE = f"{LATE_HOURS} hours"


def _streamed(job, shape):
    """Run a job over the arriving form of a shape of the views."""

    def build(v: Views) -> DataFrame:
        arriving_views = ArrivingViews(v)
        return arriving_views.run(job(shape(arriving_views), late=_LATE))

    return build


query("stream_dedup", lambda v: _show(_streamed(J.dedup_alerts, _device_alerts)(v)), _DEDUP)

_ONE = lambda v: v.flows.select(F.col("event_type").alias("src"), "ts")
_RATE = with_views("", "flows").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
  a AS (SELECT event_type AS src, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM flows),
  w AS (SELECT src, min(sec) AS sec FROM a GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT w.src, (SELECT min(a.sec) FROM a WHERE a.src = w.src AND a.sec >= w.sec + 300) AS sec FROM w) WHERE sec IS NOT NULL)
SELECT src, sec FROM (SELECT w.src, w.sec AS start, a.sec, row_number() OVER (PARTITION BY w.src, w.sec ORDER BY a.sec) AS n
  FROM w JOIN a ON a.src = w.src AND a.sec >= w.sec AND a.sec < w.sec + 300) WHERE n = 3"""
query("rate_threshold", lambda v: Q.rate_alerts(_ONE(v)), _RATE)
query("stream_threshold", _streamed(J.rate_alerts, _ONE), _RATE)
_BY_SRC = lambda v: v.flows.select("src", "ts")
_RATE_SRC = _RATE.replace("SELECT event_type AS src,", "SELECT src,").replace("300", "43200")
query("rate_threshold_sources", lambda v: Q.rate_alerts(_BY_SRC(v), seconds=43200), _RATE_SRC)
query("stream_threshold_sources", _streamed(lambda s, late: J.rate_alerts(s, late, seconds=43200), _BY_SRC), _RATE_SRC)

_probes = lambda v: v.flows.select(
    F.col("src").alias("probe"), F.unix_timestamp("ts").alias("sec"), F.col("event_id").alias("seq"), (F.col("k") >= 60).alias("ok"))
_FAILURES = (
      with_views("", "flows").rstrip() + """,
  p AS (SELECT src, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id, k >= 60 AS ok FROM flows),
  g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY src ORDER BY sec, event_id) AS grp FROM p)
SELECT src AS probe, sec FROM (SELECT *, row_number() OVER (PARTITION BY src, grp ORDER BY sec, event_id) AS n FROM g WHERE NOT ok) WHERE n = 3""")
query("failure_counter", lambda v: Q.failure_alerts(_probes(v)), _FAILURES)
query("stream_failures", _streamed(J.failure_alerts, lambda v: v.flows.select(F.col("src").alias("probe"), "ts", F.col("event_id").alias("seq"), (F.col("k") >= 60).alias("ok"))), _FAILURES)
query("sustained_load", lambda v: Q.gauge_alerts(M.rolling_mean(v.telemetry, window=20, reset=10).withColumn("mean", F.round(F.col("mean") * 3, 6)))
      .select("host", "sec", "mean"),
      with_views("", "telemetry").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
  ro AS (SELECT host, CAST(floor(epoch(time)) AS BIGINT) AS sec, event_id, row_number() OVER w AS no, round(3 * avg(cpu_pct) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS mean
    FROM telemetry WINDOW w AS (PARTITION BY host ORDER BY time, event_id) QUALIFY no >= 20),
  h AS (SELECT * FROM ro WHERE mean >= 60),
  s AS (SELECT host, min((sec, event_id, mean)) AS x FROM h GROUP BY host
    UNION ALL SELECT * FROM (SELECT s.host, (SELECT min((h.sec, h.event_id, h.mean)) FROM h WHERE h.host = s.host AND h.sec >= struct_extract_at(s.x, 1) + 14400) AS x FROM s) WHERE x IS NOT NULL)
SELECT host, struct_extract_at(x, 1) AS sec, struct_extract_at(x, 3) AS mean FROM s""")
# alerts and clears: threefold load, lines as configured, samples in windows of 20 and 10
_LOAD = with_views("", "telemetry").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
  ro AS (SELECT host, CAST(floor(epoch(time)) AS BIGINT) AS sec, event_id, row_number() OVER w AS no, avg(3 * cpu_pct) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean,
    avg(3 * cpu_pct) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS short FROM telemetry WINDOW w AS (PARTITION BY host ORDER BY time, event_id) QUALIFY no >= 20),
  h AS (SELECT * FROM ro WHERE mean >= 60),
  s AS (SELECT host, min((sec, event_id, mean)) AS x FROM h GROUP BY host
    UNION ALL SELECT * FROM (SELECT s.host, (SELECT min((h.sec, h.event_id, h.mean)) FROM h WHERE h.host = s.host AND h.sec >= struct_extract_at(s.x, 1) + 14400) AS x FROM s) WHERE x IS NOT NULL),
  clears AS (SELECT DISTINCT host, y FROM (SELECT host, (SELECT min((ro.sec, ro.event_id, ro.mean)) FROM ro WHERE ro.host = s.host AND ro.short < 50
    AND (ro.sec, ro.event_id) > (struct_extract_at(s.x, 1), struct_extract_at(s.x, 2))) AS y FROM s) WHERE y IS NOT NULL)
SELECT host, struct_extract_at(x, 1) AS sec, round(struct_extract_at(x, 3), 6) AS mean, true AS elevated FROM s
UNION ALL SELECT host, struct_extract_at(y, 1), round(struct_extract_at(y, 3), 6), false FROM clears"""
_tripled = lambda v: v.telemetry.withColumn("cpu_pct", F.col("cpu_pct") * 3)
_rounded = lambda df: df.withColumn("mean", F.round("mean", 6))
query("load_changes", lambda v: _rounded(Q.load_changes(M.rolling_mean(_tripled(v), window=20, reset=10))), _LOAD)
query("stream_load", lambda v: _rounded(_streamed(
    lambda s, late: J.load_changes(s, late, window=20, reset=10),
    lambda a: _tripled(a).select("host", F.col("time").alias("ts"), F.col("event_id").alias("seq"), F.col("cpu_pct").alias("sample")))(v)), _LOAD)
query("stream_hourly",
      lambda v: run_updates(J.hourly_bytes(StreamViews(v.spark, v.dir).conn), ["hour", "src"]).withColumn("hour", F.unix_timestamp("hour")),
      with_views(f"""SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, src, CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS bytes
FROM {WAN} GROUP BY ALL""", "conn"))
query("hourly_bytes",
      lambda v: B.wan_flows(v.conn).groupBy(F.window("ts", "1 hour").alias("w"), "src").agg(F.sum("bytes").alias("bytes"))
      .select(F.unix_timestamp("w.start").alias("hour"), "src", "bytes"),
      with_views(f"""SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, src, CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS bytes
FROM {WAN} GROUP BY ALL""", "conn"))
query("first_sightings", lambda v: v.conn.groupBy("dst").agg(F.min("ts").alias("t")).select("dst", F.unix_timestamp("t").alias("sec")).where("sec >= 1704844800"),
      with_views("SELECT dst, min(sec) AS sec FROM conn GROUP BY dst HAVING min(sec) >= 1704844800", "conn"))
query("stream_first_sightings", _streamed(lambda s, late: J.first_sightings(s, "dst", "2024-01-10 00:00:00", late), lambda v: v.conn.select("dst", "ts")),
      with_views("SELECT dst, min(sec) AS sec FROM conn GROUP BY dst HAVING min(sec) >= 1704844800", "conn"))


def _stream_pairs(v: Views) -> DataFrame:
    first = ArrivingViews(v)
    second, third = ArrivingViews(v, first.folder), ArrivingViews(v, first.folder)
    return J.domain_pairs(
        first.ssl, second.dns, third.dns, L.WATCHED_DOMAIN, late=_LATE, partitions=v.spark.sparkContext.defaultParallelism)


query("stream_domain_pairs", _stream_pairs, PAIRS_SQL)


# -- ingest: three-day files, some rows a day late, some eight days, some without a day -----------------
def _ingest_rows(v: Views) -> DataFrame:
    eid = F.col("event_id")
    delay = F.when(eid % 97 == 0, 8).when(eid % 3 == 0, 1).otherwise(0)
    came = F.floor((F.datediff("day", F.lit("2024-01-01")) + delay) / 3)
    rows = v.flows.select("event_id", F.when(eid % 101 != 0, F.col("day")).alias("day"), came.alias("_a"))
    return rows.withColumn("today", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("_a") * 3 + 2).cast("int")))


def _ingest(v: Views) -> DataFrame:
    """Run the files through the stream, run the last batch again, close the old days and count what lies where."""
    rows = _ingest_rows(v)
    folder = arriving(rows, "_a")
    schema = rows.drop("_a").schema
    job = J.Ingest(f"{folder}-tables", lambda batch: str(batch.agg(F.max("today")).first()[0]), keep_open=3)
    batches: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        job.write(batch, batch_id)
        batches.append(batch_id)
        if batch_id == 4:  # once more, as after a failure, and again with the days that are done by then
            job.write(batch, batch_id)
            job.close(v.spark, schema, str(batch.agg(F.max("today")).first()[0]))

    stream = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    last = str(rows.agg(F.max("today")).first()[0])
    job.close(v.spark, schema, last)
    late = v.spark.read.schema(schema).parquet(job.late).select(*schema.names)
    both = job.read(v.spark, schema).withColumn("place", F.lit("table")).unionByName(late.withColumn("place", F.lit("late")))
    return both.groupBy("day", "place").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


query("stream_ingest", _ingest, with_views("""
SELECT day, CASE WHEN day >= today - 3 THEN 'table' ELSE 'late' END AS place, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (
  SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN day END AS day, DATE '2024-01-01' + CAST(
    (date_diff('day', DATE '2024-01-01', day) + CASE WHEN event_id % 97 = 0 THEN 8 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) // 3 * 3 + 2 AS INTEGER) AS today FROM flows) GROUP BY ALL""", "flows"))


# -- same-day scans over arriving files ------------------------------------------------------------------
class BatchViews(Views):
    """The views over one batch of flows."""

    def __init__(self, v: Views, flows: DataFrame):
        super().__init__(v.spark, v.dir)
        self.flows = flows


def _scans(v: Views) -> dict[str, S.Scan]:
    labels, devices, baseline = v.listed("ja4_labels"), _FPM(v), checkpoint(_base(v))

    def relay(conn: DataFrame, ssl: DataFrame) -> DataFrame:
        found = Y.signals(Y.relay_flows(conn, ssl, v.registry).where("day > '2024-01-10'"), baseline, max_hours=500 / 3600)
        return Y.alerts(found)

    def layer2(arp: DataFrame) -> DataFrame:
        found = W.l2_anomalies(arp, devices, L.GATEWAY_IP, L.GATEWAY_MACS)
        return found.select("day", F.col("kind").alias("type"), F.col("ip").alias("device"), "detail")

    return {
        "ja4": S.Scan({"ssl": S.print_part()}, lambda ssl: P.threat_alerts(S.drop_listed(ssl, v.registry), labels)),
        "relay": S.Scan({"conn": S.flow_part(), "ssl": S.tls_part()}, relay),
        "l2": S.Scan({"arp": S.arp_part()}, layer2),
        "p1": S.Scan({"alerts": S.priority_part()}, lambda alerts: D.p1_pages(alerts)),
    }


def _stream_scans(v: Views) -> DataFrame:
    arrivals = ArrivingViews(v)

    def logs(batch: DataFrame) -> dict[str, DataFrame]:
        b = BatchViews(v, batch)
        return {"conn": b.conn, "ssl": b.ssl, "arp": b.arp, "alerts": b.alerts}

    job = S.DayScans(f"{arrivals.folder}-scans", _scans(v), logs)
    arrivals.flows.writeStream.foreachBatch(job.write).option("checkpointLocation", f"{arrivals.folder}-state").trigger(availableNow=True).start().awaitTermination()
    return job.latest(v.spark).withColumn("day", F.col("day").cast("string"))


query("stream_day_scans", _stream_scans, " UNION ALL ".join(
    f"SELECT '{scan}' AS scan, day, {kind} AS type, {device} AS device, detail FROM ({ORACLE[name]})" for scan, name, kind, device in (
        ("ja4", "ja4_threat_alerts", "type", "device"), ("relay", "relay_alerts", "type", "device"),
        ("l2", "l2_anomalies", "kind", "ip"), ("p1", "p1_alerts", "type", "device"))))
