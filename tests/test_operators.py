"""Operators against brute force on small random tables, and under skew."""

import datetime as dt
import fnmatch
import ipaddress
import random
import statistics
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from netsift.operators import assets as A
from netsift.operators import cadence as K
from netsift.operators import findings as D
from netsift.operators import folds as Q
from netsift.operators import gate as G
from netsift.operators import identity as I
from netsift.operators import intel as T
from netsift.operators import network as W
from netsift.operators import ranges as R
from netsift.operators import relay as Y
from netsift.operators import suppress as S
from netsift.operators import telemetry as M
from netsift.operators.skew import left_lookup
from netsift.plans import registry as plans

plans.load()

CONN = ("event_id bigint, ts timestamp, day date, src string, dst string, dst_port int, proto string, service string, src_local boolean, "
        "dst_local boolean, orig_ip_bytes bigint, resp_ip_bytes bigint, duration double")


def registry(spark, rules=(), devices=()):
    table = spark.createDataFrame(list(rules) or [("none", 0, "", "")], "kind string, ord int, pattern string, reason string")
    reg = S.make_registry(table)
    reg.devices = spark.createDataFrame(list(devices), "ip string, reason string")
    return reg


def flows(rng, n, pairs=12, days=20, hot=0.33):
    """Random flows where one pair owns a third of all rows."""
    out = []
    start = dt.datetime(2024, 1, 1)
    for i in range(n):
        p = 0 if rng.random() < hot else rng.randrange(1, pairs)
        day = rng.randrange(days)
        hour = p % 24 if p % 2 else rng.randrange(24)
        ts = start + dt.timedelta(days=day, hours=hour, seconds=rng.randrange(3600))
        out.append((i, ts, ts.date(), f"10.0.0.{p % 4}", f"93.184.0.{p}", 443, "tcp", "ssl", True, False, rng.randrange(5000), rng.randrange(5000), 1.0))
    return out


def test_slow_pairs_match_brute_force(spark):
    rng = random.Random(5)
    rows = flows(rng, 900)
    df = spark.createDataFrame(rows, CONN).repartition(5)
    pairs = K.slow_pairs(df, 14)
    got = {(r["src"], r["dst"]): r for r in pairs.collect()}
    cvs = {(r["src"], r["dst"]): r["interval_cv"] for r in K.interval_cv(df, pairs, 14).collect()}
    window = sorted({r[2] for r in rows})[-14:]
    by_pair = {}
    for r in rows:
        if r[2] in window:
            by_pair.setdefault((r[3], r[4]), []).append(r[1])
    want = {}
    for pair, times in by_pair.items():
        days = len({t.date() for t in times})
        if days >= 5 and len(times) <= 6 * days:
            bins = [0] * 24
            for t in times:
                bins[t.hour] += 1
            mode = bins.index(max(bins))
            secs = sorted(int(t.replace(tzinfo=dt.timezone.utc).timestamp()) for t in times)
            gaps = [b - a for a, b in zip(secs, secs[1:])]
            want[pair] = (len(times), days, mode, sum(bins[(mode + d) % 24] for d in (-1, 0, 1)) / len(times), statistics.pstdev(gaps) / statistics.mean(gaps))
    assert set(got) == set(want) and ("10.0.0.0", "93.184.0.0") not in got
    for pair, (n, days, mode, share, cv) in want.items():
        r = got[pair]
        assert (r["total_conns"], r["days_seen"], r["modal_hour"]) == (n, days, mode)
        assert r["hour_consistency"] == pytest.approx(share) and cvs[pair] == pytest.approx(cv)


def test_last14_candidates_take_names_from_whole_logs(spark, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    conn, ssl, http = [], [], []
    for day in range(20):  # one flow a day at four; names and hosts only on the first day, before the window
        ts = start + dt.timedelta(days=day, hours=4, minutes=day)
        for k, dst in enumerate(("93.184.0.1", "93.184.0.2")):
            conn.append((2 * day + k, ts, ts.date(), "10.0.0.5", dst, 443, "tcp", "ssl", True, False, 1, 1, 1.0))
    ssl.append((start, start.date(), "93.184.0.1", "old.example.org"))
    http.append((start, start.date(), "93.184.0.2", "bad.example.net", "GET", "/x", "agent"))
    views = SimpleNamespace(
        conn=spark.createDataFrame(conn, CONN), ssl=spark.createDataFrame(ssl, "ts timestamp, day date, dst string, server_name string"),
        http=spark.createDataFrame(http, "ts timestamp, day date, dst string, host string, method string, uri string, user_agent string"),
        geo=R.range_table(spark.createDataFrame([(1, 2, 0, "Example", "US")], "lo bigint, hi bigint, ord int, org string, cc string")),
        registry=registry(spark, [("domains", 0, "bad.example.net", "known")]))
    monkeypatch.setattr(plans, "Views", lambda spark, folder: views)
    rows = plans.QUERIES["slow_candidates_last14"](spark, "").collect()
    assert [(r["dst"], r["sni"], r["days_seen"]) for r in rows] == [("93.184.0.1", "old.example.org", 14)]


def test_new_pairs_seed_run_is_silent(spark):
    cand = spark.createDataFrame(
        [("a", "b", 1, True, False), ("a", "c", 1, False, True), ("a", "d", 1, False, False)],
        "src string, dst string, dst_port int, alert_eligible boolean, is_hyperscaler boolean")
    assert K.new_pairs(cand, None).count() == 0
    known = spark.createDataFrame([("::ffff:a|b|1",)], "pair string")
    assert {r["pair"]: r["verdict"] for r in K.new_pairs(cand, known).collect()} == {"a|c|1": "hyperscaler", "a|d|1": "shared_lan"}
    assert K.remember_pairs(cand, known).count() == 3


@pytest.mark.parametrize("pick", ["first", "longest"])
def test_range_lookup_matches_brute_force(spark, pick):
    rng = random.Random(7)
    nets = [f"{ipaddress.IPv4Address(rng.getrandbits(32) & 0x0F0FFFFF)}/{rng.randrange(4, 33)}" for _ in range(150)]
    nets += ["0.0.0.0/0", "2001:db8::/32", "2001:db8:1::/48", "bad"]
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32) & 0x0F0FFFFF)) for _ in range(300)] + ["2001:db8:1::5", "2001:db8:2::5", "x"]
    table = R.cidr_table(spark.createDataFrame(list(enumerate(nets)), "ord int, cidr string"))
    df = spark.createDataFrame([(i,) for i in ips] * 3, "ip string")
    got = {r["ip"]: r["cidr"] for r in R.with_ranges(df, "ip", table, ["cidr"], pick).collect()}
    parsed = [(i, n, ipaddress.ip_network(n, strict=False)) for i, n in enumerate(nets) if n != "bad"]
    for ip in ips:
        if ip == "x":
            assert got[ip] is None
            continue
        addr = ipaddress.ip_address(ip)
        hits = [(i, n, net) for i, n, net in parsed if net.version == addr.version and addr in net]
        hits.sort(key=(lambda h: h[0]) if pick == "first" else (lambda h: (-h[2].prefixlen, h[0])))
        assert got[ip] == (hits[0][1] if hits else None)


def test_ranges_are_covered_exactly(spark):
    rng = random.Random(8)
    ranges = [tuple(sorted((rng.randrange(2000), rng.randrange(2000)))) for _ in range(40)] + [(0, 2**32 - 1), (5, 5), (2**31, 2**32 - 1)]
    df = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(ranges)], "ord int, lo bigint, hi bigint")
    cover = {}
    for r in R.range_table(df).collect():
        size = 1 << (32 - r["plen"])
        first = (int(r["prefix"], 2) if r["prefix"] else 0) * size
        cover.setdefault(r["ord"], []).append((first, first + size - 1))
    for i, (lo, hi) in enumerate(ranges):
        parts = sorted(cover[i])
        assert parts[0][0] == lo and parts[-1][1] == hi
        assert all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:])) and len(parts) <= 62


def test_suppression_matches_brute_force(spark):
    rng = random.Random(9)
    domains = ["*.foo.com", "bar.net", "h?.x.org", "*.co*", "[ab]*.net", "*.a.b.c"]
    protocols = ["3478:udp", "53", "443:tcp:ssl"]
    rules = [("domains", i, p, f"r{i}") for i, p in enumerate(domains)] + [("protocols", i, p, f"p{i}") for i, p in enumerate(protocols)]
    words = ["foo.com", "a.foo.com", "xfoo.com", "bar.net", "h1.x.org", "z.com", "z.de", "b1.net", "q.a.b.c", "a.b.c", "", None, "c.net"]
    svcs = ["80:tcp:http,3478:udp:", "53:udp:dns", "443:tcp", "443:tcp:ssl,53", "534:x", "", None]
    rows = [(i, rng.choice(["10.0.0.1", "10.0.0.2"]), rng.choice(words), rng.choice(words), rng.choice(svcs)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, src string, fqdn string, dst string, service string")
    marked = S.mark_suppressed(df, registry(spark, rules, [("10.0.0.2", "mine")]), device="src", domains=["fqdn", "dst"], service="service")
    got = {r["i"]: r["suppressed_by"] for r in marked.collect()}

    def expect(src, fqdn, dst, svc):
        if src == "10.0.0.2":
            return ("device", src, "mine")
        for i, p in enumerate(domains):
            for t in (fqdn, dst):
                if t and (fnmatch.fnmatchcase(t, p) or (p.startswith("*.") and t == p[2:])):
                    return ("domain", p, f"r{i}")
        for comp in (svc or "").split(","):
            for i, p in enumerate(protocols):
                if comp and (comp == p or comp.startswith(p + ":")):
                    return ("protocol", p, f"p{i}")
        return None

    for i, src, fqdn, dst, svc in rows:
        assert (tuple(got[i]) if got[i] else None) == expect(src, fqdn, dst, svc)
    assert len(got) == len(rows)


def test_many_irregular_globs(spark):
    rules = [("domains", i, f"?{i}.x", "r") for i in range(450)]
    df = spark.createDataFrame([("a449.x",), ("a7.x",), ("a450.x",)], "h string")
    hits = {r["h"]: r["ord"] for r in S.glob_lookup(df, "h", registry(spark, rules).domains).collect()}
    assert hits == {"a449.x": 449, "a7.x": 7}


def test_look_up_joins_move_no_rows_for_a_small_list(spark):
    """Rows without a value, or with one of few, must not meet in one task: a written list is small enough to broadcast."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("src"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("n"), "id")).alias("name"), F.lit("a,b").alias("service"))
    listed = registry(spark, [("domains", 0, "n*0", "zero"), ("protocols", 0, "b", "b")], [("7", "dev")])
    marked = S.mark_suppressed(rows, listed, device="src", domains=["name"], service="service")
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert dict(marked.groupBy("suppressed_by.rule_type").count().collect()) == {"device": 1, "domain": 80, "protocol": 3919}


def test_look_ups_in_long_lists_spread_rows_without_a_value(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 100, F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    found = spark.range(50, 200).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = left_lookup(rows, F.col("k"), found, "key")
        assert {(r["v"], r["x"]) for r in joined.collect()} == {(v, 2 * v if 50 <= v < 100 else None) for v in range(3000)}
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def ttl_walk(events, ttl):
    until, sent = -1, []
    for s in sorted(set(events)):
        if s >= until:
            sent.append(s)
            until = s + ttl
    return sent


def test_alert_window_is_fixed_and_not_extended(spark):
    hours = [0, 5, 7, 12, 14]
    rows = [("t", "high", "d", "x", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for h in hours]
    rows += [("t", "medium", "d", "x", dt.datetime(2024, 1, 1, 5))]
    df = spark.createDataFrame(rows, "type string, severity string, device string, detail string, ts timestamp")
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    got = sorted((r["severity"], (r["sec"] - base) // 3600) for r in Q.dedup_alerts(df).collect())
    assert got == [("high", 0), ("high", 7), ("high", 14), ("medium", 5)]


def test_alert_walk_with_a_hot_key_over_many_batches(spark):
    rng = random.Random(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        secs = {"hot": [rng.randrange(400_000) for _ in range(3000)], "a": [1, 2, 90_000], "b": [5]}
        rows = [("t", "medium", k, "x", dt.datetime.fromtimestamp(s, dt.timezone.utc)) for k, v in secs.items() for s in v]
        df = spark.createDataFrame(rows, "type string, severity string, device string, detail string, ts timestamp")
        got = {}
        for r in Q.dedup_alerts(df).collect():
            got.setdefault(r["device"], []).append(r["sec"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {k: sorted(v) for k, v in got.items()} == {k: ttl_walk(v, 3600) for k, v in secs.items()}


def test_rolling_mean_across_chunks(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else "cold", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=60 * i), rng.random() * 100) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id bigint, host string, time timestamp, cpu_pct double").repartition(6)
    got = {(r["host"], r["event_id"]): (r["mean"], r["short_mean"]) for r in M.rolling_mean(df, chunk=70).collect()}
    want = {}
    for host in ("hot", "cold"):
        series = [r for r in rows if r[1] == host]
        for j in range(59, len(series)):
            want[(host, series[j][0])] = (statistics.mean(r[3] for r in series[j - 59 : j + 1]), statistics.mean(r[3] for r in series[j - 29 : j + 1]))
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_transitions_do_not_depend_on_layout(spark):
    rng = random.Random(6)
    rows = [(i, "h", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=400 * i), rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, host string, time timestamp, fan_1 boolean")
    want = sum(a[3] != b[3] for a, b in zip(rows, rows[1:]))
    assert {r["transitions"] for n in (1, 7) for r in M.transitions(df.repartition(n), "fan_1").collect()} == {want}


def test_relay_signals_and_baseline(spark):
    conn = [
        (1, None, dt.date(2024, 1, 5), "10.0.0.1", "52.113.0.1", 443, "tcp", "ssl", True, False, 10, 10, 9000.0),
        (2, None, dt.date(2024, 1, 5), "10.0.0.1", "52.113.0.1", 443, "udp", "", True, False, 10, 10, 400.0),
        (3, None, dt.date(2024, 1, 5), "10.0.0.2", "93.184.0.1", 443, "tcp", "ssl", True, False, 10, 10, 9000.0),
        (4, None, dt.date(2024, 1, 5), "10.0.0.3", "52.113.0.9", 443, "tcp", "ssl", True, False, 10, 10, 9000.0),
    ]
    ssl = [(dt.date(2024, 1, 5), "10.0.0.1", "52.113.0.1", 443, "teams.microsoft.com", "t13d_new_x"),
           (dt.date(2024, 1, 5), "10.0.0.3", "52.113.0.9", 443, "a.trouter.teams.microsoft.com", "t13d_old_x")]
    c = spark.createDataFrame(conn, CONN)
    s = spark.createDataFrame(ssl, "day date, src string, dst string, dst_port int, server_name string, ja4 string")
    f = Y.relay_flows(c, s, registry(spark))
    assert {(r["src"], r["proto"], r["via"], len(r["ja4s"])) for r in f.collect()} == {
        ("10.0.0.1", "tcp", "sni", 1), ("10.0.0.1", "udp", "sni", 0), ("10.0.0.3", "tcp", "sni", 1)}
    day1 = Y.update_baseline(f, None, "2024-01-04")
    assert Y.signals(f, day1).count() == 0  # the first day only seeds
    old = spark.createDataFrame([(x, ["t13d_old_y"], dt.date(2024, 1, 1), dt.date(2024, 1, 4), True) for x in ("10.0.0.1", "10.0.0.3")],
                                "src string, ja4s array<string>, first_seen date, last_seen date, seeded boolean")
    found = {(r["src"], r["proto"]): (r["signals"], r["severity"]) for r in Y.signals(f, old).collect()}
    assert found == {("10.0.0.1", "tcp"): (["long-flow", "new-JA4"], "medium"), ("10.0.0.1", "udp"): (["low-bw"], "low")}
    page = Y.alerts(Y.signals(f, old)).collect()
    assert [(r["device"], r["severity"]) for r in page] == [("10.0.0.1", "medium")]
    after = {r["src"]: r for r in Y.update_baseline(f, old, "2024-01-05").collect()}
    assert after["10.0.0.1"]["ja4s"] == ["t13d_new_x", "t13d_old_y"] and after["10.0.0.1"]["seeded"]


def test_finding_dedup_prefers_score_then_day(spark):
    cols = ("finding_id bigint, line_no int, day date, severity string, src string, dst string, fqdn string, score double, strobe boolean, "
            "threat_intel boolean, conns bigint, total_bytes bigint, service string, first_seen string")
    row = lambda i, day, score: (i, 1, dt.date(2024, 1, day), "High", "10.0.0.1", "1.1.1.1", "x", score, False, False, i, 0, "", "")
    df = spark.createDataFrame([row(1, 1, 0.9), row(2, 2, 0.9), row(3, 3, 0.5), row(4, 9, 0.1)], cols)
    r = D.dedup(df, 1).collect()
    assert [(x["conns"], x["score"], x["is_recent"]) for x in r] == [(2, 0.9, True)]


def test_gate_answers_unknown_when_talkers_are_missing(spark):
    df = spark.createDataFrame(
        [("1.1.1.1", None, "", None, None), ("1.1.1.1", "Google LLC", "", 1, None), ("1.1.1.1", None, "", 2, None),
         ("::", None, "a.live.net", None, 1), ("::", None, "x.org", None, 3), ("::", None, "y.org", None, 1)],
        "dst string, org string, fqdn string, t bigint, n bigint")
    verdict = lambda known: [r[0] for r in df.select(G.gate_reason("dst", "org", "fqdn", "t", "n", known)).collect()]
    assert verdict(True) == ["fire", "hyperscaler", "shared_lan", "hyperscaler", "shared_lan", "fire"]
    assert verdict(False) == ["talkers_unknown", "hyperscaler", "talkers_unknown", "hyperscaler", "talkers_unknown", "talkers_unknown"]


def test_identity_literal_hides_older_name(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ssl = spark.createDataFrame([(t(1), "1.1.1.1", "good.name", "CN=cert.name"), (t(2), "1.1.1.1", "1.1.1.1", ""), (t(1), "2.2.2.2", "b.name", "")],
                                "ts timestamp, dst string, server_name string, server_subject string")
    dns = spark.createDataFrame([(t(1), "dns.name", ["3.3.3.3"])], "ts timestamp, query string, answers array<string>")
    http = spark.createDataFrame([(t(1), "4.4.4.4", "web.name")], "ts timestamp, dst string, host string")
    got = {r["dst"]: (r["name"], r["source"], r["when_days"]) for r in I.identify(ssl, dns, http, "2024-01-03").collect()}
    assert got == {"1.1.1.1": ("cert.name", "cert", 2), "2.2.2.2": ("b.name", "SNI", 2), "3.3.3.3": ("dns.name", "DNS", 2), "4.4.4.4": ("web.name", "HTTP", 2)}


def test_no_new_devices_without_a_baseline(spark):
    assets = spark.createDataFrame([("10.0.0.1", "a2:00:00:00:00:01", "", ""), ("10.0.0.2", "dc:00:00:00:00:02", "", "")], "ip string, mac string, mac_vendor string, hostname string")
    empty, known = spark.createDataFrame([], "mac string"), spark.createDataFrame([("ff:ff",)], "mac string")
    assert A.new_devices(assets, empty, empty, empty).count() == 0
    assert {r["ip"]: r["gated"] for r in A.new_devices(assets, known, empty, empty).collect()} == {"10.0.0.1": True, "10.0.0.2": False}


def test_panels_do_not_depend_on_row_order(spark):
    rng = random.Random(11)
    conn = spark.createDataFrame(flows(rng, 600), CONN)
    geo = R.range_table(spark.createDataFrame([(0, 0, 5, "", "", "o")], "ord int, lo bigint, hi bigint, cc string, city string, org string"))
    reg = registry(spark)
    shuffled = conn.orderBy(F.rand(1)).repartition(9)
    for panel in (lambda c: W.exfil(c, geo, reg, 0.001), lambda c: W.night(c, reg), lambda c: K.lan_talkers(c, 14)):
        assert sorted(map(tuple, panel(conn).collect())) == sorted(map(tuple, panel(shuffled).collect()))


def test_null_source_is_a_source(spark):
    from netsift.operators import folds

    rows = [(s, f"2024-01-01 00:00:0{i}") for s in ("a", None) for i in range(5)]
    events = spark.createDataFrame(rows, "src string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["src"] for r in folds.rate_alerts(events).collect()} == {"a", None}


def test_chunks_refuse_windows_longer_than_a_chunk(spark):
    from netsift.operators.skew import in_chunks

    rows = spark.range(5).select(F.lit("k").alias("key"), F.col("id").alias("n"))
    with pytest.raises(ValueError):
        in_chunks(rows, "key", ["n"], F.lit(0), overlap=9, chunk=4)
    assert in_chunks(rows.withColumn("key", F.lit(None).cast("string")), "key", ["n"], F.lit(0), overlap=2, chunk=4).where("chunk = home").count() == 5


def test_scan_results_in_the_inventory(spark):
    assets = spark.createDataFrame(
        [("10.0.0.1", "aa:bb:cc:00:00:01", "Old", "", "Linux", ["22/tcp"], "arp"), ("10.0.0.2", "", "", "named", "", [], "dhcp"), ("10.0.0.3", "", "", "", "", [], "arp")],
        "ip string, mac string, mac_vendor string, hostname string, os string, open_ports array<string>, source string")
    scans = spark.createDataFrame(
        [(1, "10.0.0.1", "one", "AA:BB:CC:00:00:99", "New", "BSD", ["80/tcp:http", "22/tcp"]), (2, "10.0.0.1", "two", "", "", "Other", ["443/tcp"]),
         (3, "10.0.0.2", "other", "", "", "Windows", []), (4, "10.0.0.9", "", "", "", "", ["53/udp"]), (5, "", "x", "", "", "", [])],
        "ord int, ip string, hostname string, mac string, mac_vendor string, os string, open_ports array<string>")
    got = {r["ip"]: tuple(r)[1:] for r in A.merge_scan(assets, scans).collect()}
    assert got == {
        "10.0.0.1": ("aa:bb:cc:00:00:99", "New", "one", "Linux", ["22/tcp", "80/tcp:http", "443/tcp"], "scan"),
        "10.0.0.2": ("", "", "named", "Windows", [], "dhcp"), "10.0.0.3": ("", "", "", "", [], "arp"),
        "10.0.0.9": ("", "", "", "", ["53/udp"], "scan")}
    assert A.merge_scan(assets, scans.where("false")).count() == 3
    assert A.merge_scan(assets.where("false"), scans).count() == 3


def test_ratings_beside_rows(spark):
    cache = spark.createDataFrame(
        [("1.1.1.1", "2024-01-01", 0, [], 0, 3, True, True, None, False, False), ("1.1.1.1", "2024-01-09", 80, ["vpn"], 0, 0, True, True, None, False, False),
         ("2.2.2.2", "2024-01-01", None, [], 0, 0, False, False, "L7", True, False), ("3.3.3.3", "2024-01-01", None, [], 0, 0, False, False, None, False, False),
         ("4.4.4.4", "2024-01-01", None, None, None, None, True, None, None, False, False), ("10.0.0.1", "2024-01-01", 99, [], 0, 0, True, True, None, False, False)],
        "ip string, fetched string, abuse_score int, tags array<string>, n_vulns int, n_ports int, has_scan boolean, has_abuse boolean, sbl string, listed boolean, exit_node boolean")
    rows = spark.createDataFrame([("1.1.1.1", "10.0.0.1"), ("2.2.2.2", " 4.4.4.4"), ("3.3.3.3", None), ("1.1.1.1", "10.0.0.1")], "a string, b string")
    got = sorted((r["a"], r["a_badge"], r["a_evidence"], r["b_badge"], r["b_evidence"]) for r in T.rated(rows, cache, a="a", b="b").collect())
    assert got == [
        ("1.1.1.1", "high", "abuse 80/100; tags vpn", None, None), ("1.1.1.1", "high", "abuse 80/100; tags vpn", None, None),
        ("2.2.2.2", "high", "block list L7", "none", "nothing known"), ("3.3.3.3", None, None, None, None)]
    assert T.rated(rows, cache.where("false"), a="a").where("a_badge is null").count() == 4
