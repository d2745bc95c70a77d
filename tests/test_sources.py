"""Readers over small files written by the test."""

import gzip
import json

from netsift.functions import catalogues as C
from netsift.operators import ranges as R
from netsift.operators import suppress as S
from netsift.sources import lists as L
from netsift.sources import logs as T
from netsift.sources import sinks as K


def put(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = text if isinstance(text, bytes) else text.encode()
    path.write_bytes(gzip.compress(data) if zipped else data)
    return str(path)


def test_sensor_log(spark, tmp_path):
    put(tmp_path / "2024-01-01" / "ssl.00.log.gz",
        "#separator \\x09\n#fields\tts\tid.orig_h\tid.resp_h\tid.resp_p\tserver_name\testablished\n"
        "1704067200.5\t10.0.0.11\t::ffff:93.184.0.7\t443\tapi.example.net\tT\n1704067201\t10.0.0.11\tshort\n", True)
    put(tmp_path / "2024-01-01" / "ssl.01.log",
        b"#fields\tid.resp_h\tts\tid.orig_h\n93.184.0.8\t1704070800\t10.0.0.12\n"
        b"#fields\tid.orig_h\tts\tid.resp_h\tserver_name\n10.0.0.13\t1704070801\t93.184.0.9\t-\n10.0.0.14\t1704070802\t93.184.0.9\tb\xff.net\n")
    put(tmp_path / "2024-01-01" / "ssl.02.log", "")
    rows = T.as_ssl(T.sensor_log(spark, str(tmp_path / "*" / "ssl.*"), "ssl")).collect()
    got = {(r["src"], r["dst"], r["dst_port"], r["server_name"], r["established"], str(r["day"])) for r in rows}
    assert got == {
        ("10.0.0.11", "93.184.0.7", 443, "api.example.net", True, "2024-01-01"), ("10.0.0.12", "93.184.0.8", None, None, False, "2024-01-01"),
        ("10.0.0.13", "93.184.0.9", None, None, False, "2024-01-01"), ("10.0.0.14", "93.184.0.9", None, "b\ufffd.net", False, "2024-01-01")}
    live = put(tmp_path / "current" / "ssl.log", "#fields\tts\tid.orig_h\tid.resp_h\n1704153600\t10.0.0.1\t1.2.3.4\n")
    assert live
    days = T.sensor_days(spark, str(tmp_path), "ssl", "2024-01-02", 1).collect()
    assert [(r["id.orig_h"], str(r["day"])) for r in days] == [("10.0.0.1", "2024-01-02")]


def test_large_sensor_file_read_in_pieces(spark, tmp_path):
    """A header change in the middle of a file that several tasks read."""
    half = [f"{i}\t10.0.0.1\t1.1.1.1" for i in range(3000)]
    swapped = [f"10.0.0.2\t{i}\t1.1.1.1" for i in range(3000, 6000)]
    put(tmp_path / "2024-01-01" / "weird.log", "\n".join(
        ["#fields\tts\tid.orig_h\tname", *half, "#fields\tid.orig_h\tts\tname", *swapped]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = T.sensor_log(spark, str(tmp_path / "*" / "weird.log"), "weird").selectExpr("`id.orig_h` as s", "unix_timestamp(ts) as t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r["s"], r["t"]) for r in rows} == {("10.0.0.1" if i < 3000 else "10.0.0.2", i) for i in range(6000)}


def test_alert_lines(spark, tmp_path):
    path = put(tmp_path / "fast.log", "\n".join([
        "01/15/2024-10:20:30.123456  [**] [1:2000001:3] ET TEST Something [**] [Classification: Misc] [Priority: 1] {TCP} 10.0.0.11:5555 -> 203.0.113.7:443",
        "[x2] 01/14/2024-10:20:30.5  [**] [1:7:1] NO CLASS [**] [Priority: 3] {UDP} [2001:db8::1]:53 -> 10.0.0.1",
        "garbage", "01/01/2024-00:00:00.1  [**] [1:8:1] OLD [**] [Priority: 2] {TCP} 1.1.1.1:1 -> 2.2.2.2:2"]))
    rows = {r["sid"]: r for r in T.alert_log(spark, path, "2024-01-15", 2).collect()}
    assert set(rows) == {"1:2000001:3", "1:7:1"}
    first, second = rows["1:2000001:3"], rows["1:7:1"]
    assert (first["rule"], first["classification"], first["priority"], first["src_port"], first["dst_ip"]) == ("ET TEST Something", "Misc", 1, 5555, "203.0.113.7")
    assert (second["src_ip"], second["src_port"], second["dst_ip"], second["dst_port"], second["classification"]) == ("2001:db8::1", 53, "10.0.0.1", None, "")


def test_alert_events_and_rules(spark, tmp_path):
    ev = {"timestamp": "2024-01-15T10:00:00", "event_type": "alert", "src_ip": "a", "dest_ip": "b", "alert": {"signature": "s", "severity": 1}, "dns": {"rrname": "q"}}
    path = put(tmp_path / "eve.json", json.dumps(ev) + "\n{broken\n" + json.dumps({**ev, "event_type": "flow"}) + "\n")
    rows = T.alert_events(spark, path, "2024-01-15").collect()
    assert [(r["alert"]["signature"], r["dns"]["rrname"], r["http"]) for r in rows] == [("s", "q", None)]
    rules = put(tmp_path / "local.rules", '# comment\n#alert tcp any any -> any any (msg:"off"; classtype:bad-x; sid:5;)\ndrop udp any any (msg:"on"; sid : 6;)\n')
    got = {(r["sid"], r["enabled"], r["action"], r["msg"], r["classtype"]) for r in T.rule_catalogue(spark, rules).collect()}
    assert got == {("5", False, "alert", "off", "bad-x"), ("6", True, "drop", "on", "")}


def test_finding_report(spark, tmp_path):
    path = put(tmp_path / "beacon-report-20240103.txt", "\n".join([
        "title", "High,orphan,row", "┌─ 2024-01-01 ─────",
        'High,10.0.0.1,1.2.3.4,foo.com.,0.91,false,,,,,true,,3 hours ago,,40,1000,"80:tcp:http,3478:udp:",',
        "┌─ 2024-01-02 ─────", "None,10.0.0.2,::,", "noise line"]) + "\n")
    rows = sorted(T.finding_report(spark, path).collect(), key=lambda r: str(r["day"]))
    a, b = rows
    assert (str(a["day"]), a["fqdn"], a["score"], a["threat_intel"], a["conns"], a["service"], a["report"]) == (
        "2024-01-01", "foo.com", 0.91, True, 40, "80:tcp:http,3478:udp:", "20240103")
    assert (str(b["day"]), b["dst"], b["fqdn"], b["score"], b["modifiers"]) == ("2024-01-02", "::", "", 0.0, "")


def test_lists(spark, tmp_path):
    leases = put(tmp_path / "leases", "1 AA:BB:CC:00:00:01 10.0.0.5 host1 id\n2 aa:bb:cc:00:00:02 10.0.0.6 * id\nshort line\n")
    assert {tuple(r) for r in L.leases(spark, leases).collect()} == {("aa:bb:cc:00:00:01", "10.0.0.5", "host1"), ("aa:bb:cc:00:00:02", "10.0.0.6", "")}
    v2 = put(tmp_path / "v2.json", json.dumps({"version": 2, "devices": {"AA:BB": "x"}, "domains": {"*.a.b": "y"}, "orgs": {"O*": "z"}}, indent=1))
    assert {tuple(r) for r in L.suppression_rules(spark, v2).collect()} == {("devices", 0, "aa:bb", "x"), ("domains", 0, "*.a.b", "y"), ("orgs", 0, "O*", "z")}
    v1 = put(tmp_path / "v1.json", json.dumps({"AA:CC": "old"}))
    assert {tuple(r) for r in L.suppression_rules(spark, v1).collect()} == {("devices", 0, "aa:cc", "old")}
    drop = put(tmp_path / "drop.txt", "; head\n1.2.3.9/24 ; SBL1\n# c\nbad ; SBL2\n2001:db8::/32 ; SBL3\n5.5.5.5\n")
    ips = spark.createDataFrame([("1.2.3.77",), ("2001:db8:1::9",), ("5.5.5.5",), ("9.9.9.9",)], "ip string")
    hits = {r["ip"]: r["sbl"] for r in R.lookup(ips, "ip", L.netblocks(spark, drop), ["sbl"], "first").collect()}
    assert hits == {"1.2.3.77": "SBL1", "2001:db8:1::9": "SBL3", "5.5.5.5": ""}
    exits = put(tmp_path / "exits", "# h\n1.2.3.4\nnope\n2001:db8::1\n")
    assert {r["ip"] for r in L.exit_addresses(spark, exits).collect()} == {"1.2.3.4", "2001:db8::1"}
    eps = put(tmp_path / "eps.json", json.dumps([
        {"serviceArea": "Skype", "ips": ["52.112.0.0/14", "2603::/32"], "urls": ["*.Teams.example", " a.b "]}, {"serviceArea": "Other", "ips": ["1.1.1.0/24"]}]))
    assert {tuple(r) for r in L.service_endpoints(spark, eps).select("kind", "value").collect()} == {("cidr", "52.112.0.0/14"), ("suffix", ".teams.example"), ("exact", "a.b")}
    oui = put(tmp_path / "oui", "# c\nAA-BB-CC Some Vendor\nDCA632 Other\n")
    assert {tuple(r) for r in L.vendor_prefixes(spark, oui).collect()} == {("AABBCC", "Some Vendor"), ("DCA632", "Other")}
    scan = put(tmp_path / "scan", "# x\nHost: 10.0.0.9 (box)\tPorts: 22/open/tcp//ssh///, 80/closed/tcp//http///, 5353/open/udp/////\tOS: Linux 5.4; more\n"
               "Host: 10.0.0.8 ()\tOS: A|B\n")
    got = {r["ip"]: (r["hostname"], r["os"], r["open_ports"]) for r in L.scan_results(spark, scan).collect()}
    assert got == {"10.0.0.9": ("box", "Linux 5.4", ["22/tcp:ssh", "5353/udp"]), "10.0.0.8": ("", "", [])}
    rec = {"time": "2024-01-01T00:00:00", "temp_c": 50.0, "cpu_pct": 10.0, "mem_pct": 5.0, "top_cpu": [{"name": "a", "pct": 1.0}], "fan_1": True}
    day, bare = put(tmp_path / "t" / "a.json", json.dumps({"date": "2024-01-01", "records": [rec]})), put(tmp_path / "t" / "b.json", json.dumps([rec, rec]))
    assert L.telemetry_days(spark, [day, bare]).where("temp_c = 50 and fan_1").count() == 3
    mime = put(tmp_path / "mime.csv", 'css,text/css,.css,[r]\ncal,text/calendar,".ics, .ifb, .iCal",[r]\nx,text/x,none,[r]\njs,text/javascript,".js, .mjs., es",[r]\n')
    assert {tuple(r) for r in L.mime_extensions(spark, mime).collect()} == {
        ("text/css", ".css"), ("text/calendar", ".ics"), ("text/calendar", ".ifb"), ("text/calendar", ".ical"), ("text/javascript", ".js"),
        ("text/javascript", ".mjs"), ("text/javascript", ".es")}
    labels = put(tmp_path / "ja4.csv", "Application,Library,Device,OS,ja4\nSafari,,,macOS,t_a_b\n")
    assert L.ja4_labels(spark, labels).first()["app"] == "Safari"
    geo = put(tmp_path / "geo.csv", "lo,hi,cc,city,org\n16777216,16777300,AU,,Org\n")
    assert L.geo_ranges(spark, geo).first()["org"] == "Org"


def test_sinks(spark, tmp_path):
    table, state = str(tmp_path / "t"), str(tmp_path / "s")
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, x int")
    K.write_days(df, table)
    K.write_days(df.where("x = 2").selectExpr("day", "x * 10 as x"), table)
    assert {(str(r["day"]), r["x"]) for r in spark.read.parquet(table).collect()} == {("2024-01-01", 1), ("2024-01-02", 20)}
    assert K.prune_days(spark, table, "2024-02-01", 30) == ["day=2024-01-01"]
    assert K.read_state(spark, state) is None
    K.write_state(df.select("x"), state)
    K.write_state(K.read_state(spark, state).selectExpr("x + 1 as x"), state)
    assert sorted(r["x"] for r in K.read_state(spark, state).collect()) == [2, 3]
    stats = str(tmp_path / "g")
    one = spark.createDataFrame([("fire", 2)], "reason string, n int")
    for ts in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        K.append_stats(one, stats, "c", ts)
    assert K.latest_stats(spark.read.parquet(stats)).count() == 1


def test_local_vendor_list_does_not_override(spark):
    from netsift.operators import assets as A

    main = spark.createDataFrame([("DCA632", "Main name")], "prefix string, name string")
    got = {r["prefix"]: r["name"] for r in A.vendor_table(main).collect()}
    assert got["DCA632"] == "Main name" and got["B827EB"] == dict(C.LOCAL_PREFIXES)["B827EB"]
    assert S.make_registry(spark.createDataFrame([("domains", 0, "*.x", "r")], "kind string, ord int, pattern string, reason string")).domains.count() == 1


def test_duplicate_vendor_prefix_keeps_the_first_line(spark):
    from netsift.operators import assets as A

    main = spark.createDataFrame([("AABBCC", "First", 1), ("AABBCC", "Second", 2)], "prefix string, name string, ord int")
    assert [r["name"] for r in A.vendor_table(main).where("prefix = 'AABBCC'").collect()] == ["First"]
