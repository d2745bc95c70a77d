"""Streams give the rows of their batch twins, whatever the order of the files."""

import datetime as dt
import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from netsift.operators import folds as Q
from netsift.operators import ids as D
from netsift.operators import identity as I
from netsift.operators import telemetry as M
from netsift.plans import registry
from netsift.streaming import jobs as J
from netsift.streaming import ordered as O
from netsift.streaming import scans as S

T0 = dt.datetime(2024, 1, 1)
at = lambda sec: T0 + dt.timedelta(seconds=sec)


def write_files(spark, path, files, schema):
    """One file per list; they arrive one per batch, in this order."""
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture()
def events(spark, tmp_path):
    """Rows in four files that overlap by up to six hours, null keys among them; a clock row ends them."""
    rng = random.Random(12)
    rows = [(at(rng.randrange(200_000)), rng.choice(["a", "b", "c", None]), i) for i in range(900)]
    files = [[], [], [], []]
    for r in rows:
        late = (r[0] - T0).total_seconds() + rng.randrange(6 * 3600)
        files[min(int(late // 55_000), 3)].append(r)
    for f in files:
        rng.shuffle(f)
    schema = "ts timestamp, src string, seq bigint"
    path = str(tmp_path / "events")
    stream = write_files(spark, path, [*files, [(at(10**7), None, None)]], schema)
    return spark.createDataFrame(rows, schema), stream


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


LATE = "6 hours"
as_alerts = lambda df: df.select(F.lit("t").alias("type"), F.lit("medium").alias("severity"), F.col("src").alias("device"), F.lit("x").alias("detail"), "ts")


def test_alert_windows(spark, events):
    got = rows_of(J.run_to_end(J.dedup_alerts(as_alerts(events[1]()), LATE), partitions=3))
    assert got == rows_of(Q.dedup_alerts(as_alerts(events[0]))) and got


def test_an_earlier_alert_in_a_later_file_is_sent(spark, tmp_path):
    hour = lambda h: (at(3600 * h), "d", 0)
    schema = "ts timestamp, src string, seq bigint"
    stream = write_files(spark, str(tmp_path / "e"), [[hour(10)], [hour(2), hour(10.5)], [hour(100)]], schema)
    got = [r["sec"] for r in J.run_to_end(J.dedup_alerts(as_alerts(stream()), "12 hours"), partitions=2).collect()]
    assert sorted(got) == [int(at(3600 * h).replace(tzinfo=dt.timezone.utc).timestamp()) for h in (2, 10)]


def test_rate_threshold(spark, events):
    shape = lambda df: df.select("src", "ts")
    got = rows_of(J.run_to_end(J.rate_alerts(shape(events[1]()), LATE, seconds=3000), partitions=3))
    assert got == rows_of(Q.rate_alerts(shape(events[0]), seconds=3000)) and got


def test_failures_fire_exactly_at_the_third(spark, events):
    shape = lambda df: df.select(F.col("src").alias("probe"), "ts", "seq", (F.col("seq") % 4 == 0).alias("ok"))
    got = rows_of(J.run_to_end(J.failure_alerts(shape(events[1]()), LATE), partitions=3))
    assert got == rows_of(Q.failure_alerts(shape(events[0]).withColumn("sec", F.unix_timestamp("ts")))) and got


def test_first_sightings(spark, events):
    got = rows_of(J.run_to_end(J.first_sightings(events[1]().select("src", "ts"), "src", "2023-01-01 00:00:00", LATE), partitions=3))
    assert got == rows_of(events[0].groupBy("src").agg(F.unix_timestamp(F.min("ts")).alias("sec")))


def test_load_alerts_and_clears(spark, events):
    load = (F.abs(F.sin(F.unix_timestamp("ts") / 9000.0)) * 100).alias("sample")
    shape = lambda df: df.select(F.col("src").alias("host"), "ts", "seq", load)
    rule = {"window": 12, "reset": 6}
    got = J.run_to_end(J.load_changes(shape(events[1]()), LATE, **rule), partitions=3)
    samples = shape(events[0]).select("host", F.col("ts").alias("time"), F.col("seq").alias("event_id"), F.col("sample").alias("cpu_pct"))
    want = Q.load_changes(M.rolling_mean(samples, **rule))
    rounded = lambda df: rows_of(df.withColumn("mean", F.round("mean", 6)))
    assert rounded(got) == rounded(want) and {r[3] for r in rounded(got)} == {True, False}


def test_load_rings_match_a_plain_walk(spark):
    """Batch alerts and clears against the rule read row by row."""
    rng = random.Random(3)
    rows = [(f"h{k % 2}", at(60 * k), k, rng.choice([10.0, 90.0, 95.0]) if k // 150 % 2 else rng.uniform(40, 90)) for k in range(1200)]
    want, state = set(), {}
    for host, ts, _, x in rows:
        ring, last, up = state.get(host, ([], None, False))
        ring = [*ring, x][-60:]
        if len(ring) == 60:
            sec, mean = int((ts - dt.datetime(1970, 1, 1)).total_seconds()), sum(ring) / 60
            if up and sum(ring[-30:]) / 30 < 50:
                up = False
                want.add((host, sec, False))
            if mean >= 60 and (last is None or sec - last >= 4 * 3600):
                last, up = sec, True
                want.add((host, sec, True))
        state[host] = (ring, last, up)
    df = spark.createDataFrame(rows, "host string, time timestamp, event_id bigint, cpu_pct double")
    got = {(r["host"], r["sec"], r["elevated"]) for r in Q.load_changes(M.rolling_mean(df)).collect()}
    assert got == want and len(want) > 4


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    path, schema = str(tmp_path / "e"), "ts timestamp, src string, seq bigint"
    hour = lambda h: (at(3600 * h), "d", 0)

    def run(files):
        stream = write_files(spark, path, files, schema)
        with J._keyed_state(spark, 2):
            J.dedup_alerts(as_alerts(stream()), "4 hours").writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
                "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run([[hour(1)], [hour(1.5), hour(6)]])
    run([[hour(2.2), hour(3)], [hour(50)]])
    got = sorted(r["sec"] - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [3600, int(2.2 * 3600), 6 * 3600]


def test_pairs_of_a_watched_domain(spark, tmp_path):
    rng = random.Random(5)
    names = ["x.watched.net", "other.net", "far.net", "else.net", ""]
    dns = [(at(rng.randrange(900)), rng.choice("abc"), rng.choice(names)) for _ in range(700)]
    tls = [(at(rng.randrange(900)), rng.choice("abc"), rng.choice(names[:2])) for _ in range(60)]
    halves = lambda rows: [[r for r in rows if (r[0].second * 7) % 3 == k] for k in range(3)]
    d_schema, t_schema = "ts timestamp, src string, query string", "ts timestamp, src string, server_name string"
    d = write_files(spark, str(tmp_path / "d"), halves(dns), d_schema)
    t = write_files(spark, str(tmp_path / "t"), halves(tls), t_schema)
    got = rows_of(J.domain_pairs(t(), d(), d(), "watched.net"))
    assert got == rows_of(I.domain_pairs(spark.createDataFrame(tls, t_schema), spark.createDataFrame(dns, d_schema), "watched.net")) and got


def test_seconds_that_touch_share_one_span_and_few_events_are_repeated(spark):
    rows = spark.range(-40, 40).select(F.col("id").alias("sec"), J.spans_near(F.col("id")).alias("spans"))
    lookups = spark.range(-45, 45).select(F.col("id").alias("q"), J.span_of(F.col("id")).alias("span"))
    assert rows.agg(F.sum(F.size("spans"))).first()[0] == 100  # was 240: every event three times
    met = rows.select("sec", F.explode("spans").alias("span")).join(lookups, "span").where("q between sec - 1 and sec + 1")
    assert rows_of(met.select("sec", "q")) == sorted(((s, q) for s in range(-40, 40) for q in (s - 1, s, s + 1)), key=str)


def test_an_arrival_is_one_file_that_many_tasks_can_read(spark):
    rows = spark.range(0, 600_000, 1, 2).select(F.xxhash64("id").alias("x"), F.xxhash64(-F.col("id")).alias("y"), (F.col("id") % 2).alias("_a"))
    registry.load()
    from netsift.plans.queries_streams import arriving

    folder = arriving(rows, "_a")
    files = [pq.ParquetFile(f) for f in glob.glob(f"{folder.removeprefix('file:')}/*.parquet")]
    assert len(files) == 2 and all(f.metadata.num_rows == 300_000 for f in files)
    assert all(f.metadata.num_row_groups > 1 for f in files)  # was 1
    assert rows_of(spark.read.parquet(folder).agg(F.sum(F.col("x").cast("decimal(38,0)")))) == rows_of(rows.agg(F.sum(F.col("x").cast("decimal(38,0)"))))


def test_ingest_separates_late_rows_closes_days_and_loses_none(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "day string, x int").withColumn("day", F.to_date("day"))

    clock = {"today": "2024-01-10"}
    job = J.Ingest(str(tmp_path), lambda _: clock["today"])
    schema = batch(("2024-01-10", 1)).schema
    first = batch(("2024-01-10", 1), ("2024-01-09", 2), ("2024-01-05", 3), (None, 4))
    job.write(first, 0)
    job.write(first, 0)  # once more after a failure
    job.write(batch(("2024-01-10", 5)), 1)
    xs = lambda df: sorted(r["x"] for r in df.collect())
    assert xs(job.read(spark, schema)) == [1, 2, 5] and xs(spark.read.parquet(job.late)) == [3, 4]
    clock["today"] = "2024-01-12"
    job.write(batch(("2024-01-12", 6), ("2024-01-10", 7)), 2)
    assert job.close(spark, schema, "2024-01-12") == ["2024-01-09", "2024-01-10"]
    assert job.close(spark, schema, "2024-01-12") == []
    assert xs(job.read(spark, schema)) == [1, 2, 5, 6] and xs(spark.read.parquet(job.late)) == [3, 4, 7]
    assert xs(spark.read.parquet(job.closed)) == [1, 2, 5]


def test_day_scans_equal_a_scan_of_the_day_so_far(spark, tmp_path):
    rng = random.Random(2)
    schema = "event_id bigint, ts timestamp, day date, sid string, rule string, priority int, proto string, src_ip string, dst_ip string"
    rows = []
    for k in range(300):
        ts = at(rng.randrange(3 * 86400))
        rows.append((k, ts, ts.date(), str(rng.randrange(9)), "rule", rng.choice([1, 2]), "TCP", rng.choice(["10.0.0.1", "8.8.8.8"]), "9.9.9.9"))
    job = S.DayScans(str(tmp_path), {"p1": S.Scan({"alerts": S.priority_part()}, lambda alerts: D.p1_pages(alerts))}, lambda b: {"alerts": b})
    for n in range(3):
        part = spark.createDataFrame(rows[100 * n : 100 * n + 100], schema)
        job.write(part, n)
        if n == 1:
            job.write(part, n)  # once more after a failure
        whole = D.p1_alerts(spark.createDataFrame(rows[: 100 * n + 100], schema))
        columns = ["day", "type", "device", "detail"]
        assert rows_of(job.latest(spark).select(*columns)) == rows_of(whole.select(*columns))
    stored = spark.read.parquet(f"{tmp_path}/p1-alerts")
    assert stored.count() < 300 and stored.select("batch").distinct().count() == 3


class _Fake:
    """A state store in memory that counts the calls for one key."""

    def __init__(self):
        self.calls, self.rows, self.value, self.timers = 0, {}, None, set()

    def getListState(self, name, schema):
        store, rows = self, self.rows.setdefault(name, [])

        class List:
            def exists(self):
                store.calls += 1
                return bool(rows)

            def get(self):
                store.calls += 1
                return iter(list(rows))

            def appendList(self, more):
                store.calls += 1
                rows.extend(more)

            def clear(self):
                store.calls += 1
                rows.clear()

        return List()

    def getValueState(self, name, schema):
        store = self

        class Value:
            def get(self):
                return store.value

            def update(self, value):
                store.value = value

            def clear(self):
                store.value = None

        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Clock:
    def __init__(self, sec):
        self.sec = sec

    def getCurrentWatermarkInMs(self):
        return self.sec * 1000


def test_keys_of_a_deal_share_the_calls_to_the_state():
    from pyspark.sql import Row

    row = lambda k, sec: Row(fingerprint=k, type="t", severity="medium", device=k, detail="x", sec=sec, ttl=100)
    keys = [f"k{i}" for i in range(200)]
    store, walk = _Fake(), O.Dealt(O.Windows())
    walk.init(store)
    sent = []
    for rows, clock in (([row(k, s) for k in keys for s in (150, 10, 50, 10)], 120), ([row(k, s) for k in keys for s in (130, 260)], 1000)):
        list(walk.handleInputRows((0,), iter(rows), _Clock(0)))
        sent += [(r["fingerprint"], r["sec"]) for r in walk.handleExpiredTimer((0,), _Clock(clock), None)]
    assert sorted(sent) == sorted((k, s) for k in keys for s in (10, 130, 260))
    assert store.calls < 30  # was some for every key
    assert not any(store.rows.values()) and store.value is None
