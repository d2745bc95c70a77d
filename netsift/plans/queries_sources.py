"""Registered queries: readers and writers. The views are written as log files and lists, then read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import assets as A
from ..operators import ids as D
from ..operators import ranges as R
from ..operators import suppress as S
from ..session import shared_folder
from ..sources import lists as L
from ..sources import logs as T
from ..sources import sinks as K
from .adapters import Views
from .oracle_views import geo_of, with_views
from .queries_inventory import _inv, _ports
from .registry import query

TODAY, DAYS = "2024-01-28", 14
_WINDOW = "day BETWEEN DATE '2024-01-15' AND DATE '2024-01-28'"


def _folder(v: Views, name: str) -> str:
    return f"{shared_folder(v.spark)}/files-{uuid.uuid4().hex}/{name}"


def _lines(v: Views, rows: DataFrame, name: str) -> str:
    """Write one text column as text files."""
    path = _folder(v, name)
    rows.toDF("value").write.text(path)
    return path


def _in_order(rows: DataFrame, by: str) -> DataFrame:
    """Lines ``(by, ord, value)`` so that all of one ``by`` stand in one file, in the order of ``ord``."""
    return rows.repartition(by).sortWithinPartitions(by, "ord").select(by, "value")


def _day_folders(v: Views, rows: DataFrame, stem: str) -> str:
    """Write lines ``(day, ord, value)`` as ``root/YYYY-MM-DD/stem.00.log``."""
    root = _folder(v, stem)
    _in_order(rows, "day").write.partitionBy("day").text(f"{root}-written")
    Path = v.spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(root).getFileSystem(v.spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(Path(f"{root}-written")):
        name = status.getPath().getName()
        if name.startswith("day="):
            fs.mkdirs(Path(f"{root}/{name[4:]}"))
            fs.rename(status.getPath(), Path(f"{root}/{name[4:]}/{stem}.00.log"))
    return root


def _sensor_lines(rows: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Two headers a day, with another order of columns for the odd half; comments and a short row between them."""
    text = {c: F.coalesce(x.cast("string"), F.lit("-")) for c, x in cells.items()}
    names, odd = list(cells), F.col("event_id") % 2 == 1
    line = F.when(odd, F.concat_ws("\t", *[text[c] for c in reversed(names)])).otherwise(F.concat_ws("\t", *[text[c] for c in names]))
    body = rows.select("day", F.when(odd, 3).otherwise(1).alias("ord"), line.alias("value"))
    head = lambda order: "#fields\t" + "\t".join(order)
    fixed = [(0, "#separator \\x09"), (0, head(names)), (2, "#close"), (2, head(names[::-1])), (4, "1\tshort")]
    marks = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("value")) for o, t in fixed]))
    return body.unionByName(rows.select("day").distinct().select("day", marks.alias("m")).select("day", "m.ord", "m.value"))


def _mapped(address: str) -> Column:
    """Every third address as sensors write v4 in v6 columns."""
    return F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("::ffff:"), F.col(address))).otherwise(F.col(address))


def _epoch(ts: str = "ts") -> Column:
    return F.concat(F.unix_timestamp(ts).cast("string"), F.lit(".5"))


def _conn_days(v: Views) -> DataFrame:
    cells = {"ts": _epoch(), "id.orig_h": _mapped("src"), "id.resp_h": _mapped("dst"), "id.resp_p": F.col("dst_port"), "proto": F.upper("proto"),
             "service": F.col("service"), "duration": F.col("duration"), "orig_ip_bytes": F.col("orig_ip_bytes"), "resp_ip_bytes": F.col("resp_ip_bytes")}
    return T.as_conn(T.sensor_days(v.spark, _day_folders(v, _sensor_lines(v.conn, cells), "conn"), "conn", TODAY, DAYS))


query("read_conn", lambda v: _conn_days(v).select(
    F.col("day").cast("string").alias("day"), F.unix_timestamp("ts").alias("sec"), "src", "dst", "dst_port", "proto", "service", "src_local", "dst_local",
    F.round("duration", 6).alias("duration"), "orig_ip_bytes", "resp_ip_bytes"),
    with_views(f"""SELECT CAST(day AS VARCHAR) AS day, sec, src, dst, dst_port, proto, service, src_local, dst_local, round(duration, 6) AS duration, orig_ip_bytes, resp_ip_bytes
FROM conn WHERE {_WINDOW}""", "conn"))


def _dns_days(v: Views) -> DataFrame:
    answers = F.when(F.size("answers") > 0, F.array_join("answers", ",")).otherwise("(empty)")
    cells = {"ts": _epoch(), "id.orig_h": F.col("src"), "query": F.col("query"), "qtype_name": F.col("qtype_name"), "rcode_name": F.col("rcode_name"), "answers": answers}
    return T.as_dns(T.sensor_days(v.spark, _day_folders(v, _sensor_lines(v.dns, cells), "dns"), "dns", TODAY, DAYS))


query("read_dns", lambda v: _dns_days(v).select(
    F.col("day").cast("string").alias("day"), F.unix_timestamp("ts").alias("sec"), "src", "query", "qtype_name", "rcode_name", F.array_join("answers", ",").alias("answers")),
    with_views(f"""SELECT CAST(day AS VARCHAR) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS sec, src, query, qtype_name, rcode_name,
  CASE WHEN len(answers) > 0 THEN array_to_string(answers, ',') END AS answers FROM dns WHERE {_WINDOW}""", "dns"))


# -- IDS ------------------------------------------------------------------------------------------------
def _alert_lines(v: Views) -> DataFrame:
    e = F.col("event_id")
    line = F.concat(
        F.when(e % 11 == 0, "[x2] ").otherwise(""), F.date_format("ts", "MM/dd/yyyy-HH:mm:ss"), F.lit(".25  [**] [1:"), "sid", F.lit(":2] "), "rule", F.lit(" [**] "),
        F.when(e % 5 != 0, F.concat(F.lit("[Classification: Class "), (e % 3).cast("string"), F.lit("] "))).otherwise(""),
        F.lit("[Priority: "), F.col("priority").cast("string"), F.lit("] {"), F.upper("proto"), F.lit("} "), "src_ip", F.lit(":"), (e % 60000 + 1).cast("string"),
        F.lit(" -> "), F.when(e % 13 == 0, F.lit("[2001:db8::7]")).otherwise(F.col("dst_ip")), F.when(e % 7 != 0, F.concat(F.lit(":"), (e % 1000).cast("string"))).otherwise(""))
    noise = v.alerts.where("event_id % 50 = 0").select(F.concat(F.lit("no alert "), F.col("event_id").cast("string")))
    return v.alerts.select(line).union(noise)


query("read_alert_lines", lambda v: T.alert_log(v.spark, _lines(v, _alert_lines(v), "fast.log"), "2024-01-30", 7).select(
    F.col("day").cast("string").alias("day"), F.unix_timestamp("ts").alias("sec"), "sid", "rule", "classification", "priority", "proto", "src_ip", "src_port", "dst_ip", "dst_port"),
    with_views("""SELECT CAST(day AS VARCHAR) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS sec, '1:' || sid || ':2' AS sid, rule,
  CASE WHEN event_id % 5 <> 0 THEN 'Class ' || (event_id % 3) ELSE '' END AS classification, priority, upper(proto) AS proto, src_ip, CAST(event_id % 60000 + 1 AS INTEGER) AS src_port,
  CASE WHEN event_id % 91 = 0 THEN '[2001:db8::7]' WHEN event_id % 13 = 0 THEN '2001:db8::7' ELSE dst_ip END AS dst_ip, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 1000 AS INTEGER) END AS dst_port
FROM alerts WHERE day >= DATE '2024-01-24'""", "alerts"))


def _alert_events(v: Views) -> DataFrame:
    rows = v.eve.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxxx"))
    kept = F.to_json(F.struct("timestamp", F.when(F.col("event_id") % 10 == 9, "flow").otherwise("alert").alias("event_type"), "src_ip", "dest_ip", "alert", "http", "dns", "tls"))
    return T.alert_events(v.spark, _lines(v, rows.select(F.when(F.col("event_id") % 20 == 1, F.substring(kept, 1, 40)).otherwise(kept)), "eve.json"), "2024-01-20")


query("read_alert_events", lambda v: _alert_events(v).select(
    "src_ip", "dest_ip", F.col("alert.signature").alias("rule"), F.col("alert.severity").alias("priority"), F.col("http.hostname").alias("host"),
    F.col("http.url").alias("url"), F.col("dns.rrname").alias("name"), F.col("tls.sni").alias("sni")),
    with_views("""SELECT src_ip, dst_ip AS dest_ip, rule, priority, CASE WHEN event_id % 5 = 0 THEN site END AS host, CASE WHEN event_id % 5 = 0 THEN path END AS url,
  CASE WHEN event_id % 5 = 1 THEN site END AS name, CASE WHEN event_id % 5 = 2 THEN site END AS sni
FROM alerts JOIN sites ON page_id = event_id % (SELECT count(*) FROM pages) WHERE day = DATE '2024-01-20' AND event_id % 10 <> 9 AND event_id % 20 <> 1""", "alerts", "sites"))


def _rules(v: Views) -> DataFrame:
    """A catalogue of all parts, some of them rules for sids that alerts carry; every fifth is commented out, some are listed twice."""
    k = F.col("p_partkey")
    body = F.concat(
        F.when(k % 3 == 0, "drop").otherwise("alert"), F.lit(" tcp any any -> any any (msg:\""), "p_name", F.lit("\"; classtype:type-"), (k % 4).cast("string"),
        F.lit("; sid:"), (k % 1500 + 2000010).cast("string"), F.lit("; rev:1;)"))
    return v.table("part").select(F.when(k % 5 == 0, F.concat(F.lit("# "), body)).otherwise(body)).union(v.spark.sql("SELECT '# only a comment'"))


def _catalogue(v: Views) -> DataFrame:
    return T.rule_catalogue(v.spark, _lines(v, _rules(v), "rules"))


_RULES = """SELECT CAST(p_partkey % 1500 + 2000010 AS VARCHAR) AS sid, p_partkey % 5 <> 0 AS enabled, CASE WHEN p_partkey % 3 = 0 THEN 'drop' ELSE 'alert' END AS action,
  p_name AS msg, 'type-' || (p_partkey % 4) AS classtype FROM part"""
query("read_rules", _catalogue, _RULES)
query("alert_rules", lambda v: D.with_rules(v.alerts, _catalogue(v)).withColumn("last_seen", F.unix_timestamp("last_seen")),
      with_views("", "alerts").rstrip() + f""",
  r AS (SELECT * FROM ({_RULES}) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY NOT enabled, msg, action, classtype) = 1)
SELECT a.sid, rule, n, last_seen, r.sid IS NOT NULL AS known, enabled, action, classtype, msg
FROM (SELECT sid, rule, count(*) AS n, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen FROM alerts GROUP BY ALL) a LEFT JOIN r ON r.sid = a.sid""")


# -- finding reports --------------------------------------------------------------------------------------
def _report(v: Views) -> DataFrame:
    text = {
        "severity": F.col("severity"), "src": F.col("src"), "dst": F.col("dst"), "fqdn": F.when(F.col("fqdn") != "", F.concat("fqdn", F.lit("."))).otherwise(""),
        "score": F.col("score"), "strobe": F.col("strobe"), "threat_intel": F.col("threat_intel"), "first_seen": F.col("first_seen"), "conns": F.col("conns"),
        "total_bytes": F.col("total_bytes"), "service": F.concat(F.lit('"'), "service", F.lit('"'))}
    order = ["severity", "src", "dst", "fqdn", "score", "strobe", None, None, None, None, "threat_intel", None, "first_seen", None, "conns", "total_bytes", "service", None]
    line = F.concat_ws(",", *[F.lit("") if c is None else text[c].cast("string") for c in order])
    rows = v.findings.select("day", F.lit(1).alias("ord"), line.alias("value"))
    heads = v.findings.select("day").distinct().select(
        "day", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.concat(F.lit("┌─ "), F.col("day").cast("string"), F.lit(" ─────")).alias("value")),
                                 F.struct(F.lit(2).alias("ord"), F.lit("└──────").alias("value")))).alias("m")).select("day", "m.ord", "m.value")
    path = _folder(v, "report")
    _in_order(rows.unionByName(heads), "day").select("value").write.text(path)  # several days to a file, each under its header
    return T.finding_report(v.spark, path)


query("read_report", lambda v: _report(v).select(
    F.col("day").cast("string").alias("day"), "severity", "src", "dst", "fqdn", "score", "strobe", "threat_intel", "first_seen", "conns", "total_bytes", "service"),
    with_views("SELECT CAST(day AS VARCHAR) AS day, severity, src, dst, fqdn, CAST(score AS DOUBLE) AS score, strobe, threat_intel, first_seen, conns, total_bytes, service FROM findings", "findings"))


# -- lists --------------------------------------------------------------------------------------------------
query("read_leases", lambda v: L.leases(v.spark, _lines(v, v.leases.select(F.concat_ws(
    " ", F.lit("1704067200"), F.upper("mac"), "ip", F.when(F.col("hostname") == "", "*").otherwise(F.col("hostname")), F.lit("01:id"))).union(
        v.leases.select(F.concat(F.lit("short "), "mac"))), "leases")),
    with_views("SELECT lower(mac) AS mac, ip, hostname FROM leases", "leases"))


def _registry(v: Views) -> DataFrame:
    """One document with an entry per supplier and kind."""
    k = F.col("s_suppkey").cast("string")
    entries = v.table("supplier").select(
        F.concat(F.lit("AA:"), k).alias("d"), F.concat(F.lit("*.s"), k, F.lit(".net")).alias("n"), F.concat(k, F.lit(":udp")).alias("p"), F.col("s_name").alias("o"))
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, F.concat(F.lit(f"{kind} "), c))))).alias(kind) for kind, c in (
        ("devices", "d"), ("domains", "n"), ("protocols", "p"), ("orgs", "o"))]
    return L.suppression_rules(v.spark, _lines(v, entries.agg(*maps).select(F.to_json(F.struct(F.lit(2).alias("version"), "*"))), "registry"))


query("read_registry", lambda v: _registry(v).select("kind", "pattern", "reason"),
      """SELECT 'devices' AS kind, 'aa:' || s_suppkey AS pattern, 'devices AA:' || s_suppkey AS reason FROM supplier
UNION ALL SELECT 'domains', '*.s' || s_suppkey || '.net', 'domains *.s' || s_suppkey || '.net' FROM supplier
UNION ALL SELECT 'protocols', s_suppkey || ':udp', 'protocols ' || s_suppkey || ':udp' FROM supplier
UNION ALL SELECT 'orgs', s_name, 'orgs ' || s_name FROM supplier""")


def _endpoints(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    rows = v.table("supplier").select(F.struct(
        F.when(k % 2 == 0, "Skype").otherwise("Exchange").alias("serviceArea"),
        F.array(F.concat(F.lit("52."), (k % 250).cast("string"), F.lit(".0.0/16")), F.lit("2603:1063::/39")).alias("ips"),
        F.array(F.concat(F.lit("*.T"), k, F.lit(".Example.com")), F.concat(F.lit(" x"), k, F.lit(".example.net ")), F.lit("")).alias("urls")).alias("e"))
    doc = rows.agg(F.to_json(F.sort_array(F.collect_list("e"))))
    return L.service_endpoints(v.spark, _lines(v, doc, "endpoints"))


query("read_endpoints", lambda v: _endpoints(v).select("kind", "value"),
      """SELECT DISTINCT 'cidr' AS kind, '52.' || (s_suppkey % 250) || '.0.0/16' AS value FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'suffix', '.t' || s_suppkey || '.example.com' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'exact', 'x' || s_suppkey || '.example.net' FROM supplier WHERE s_suppkey % 2 = 0""")
query("read_exits", lambda v: L.exit_addresses(v.spark, _lines(v, v.arp_table.select("ip").union(v.arp_table.select(F.concat(F.lit("# "), "mac"))).union(
    v.arp_table.select(F.lit("2001:db8::1"))).union(v.arp_table.select("mac")), "exits")),
    with_views("SELECT DISTINCT ip FROM arp_table UNION SELECT '2001:db8::1' WHERE (SELECT count(*) FROM arp_table) > 0", "arp_table"))
query("read_vendor_prefixes", lambda v: L.vendor_prefixes(v.spark, _lines(v, v.devices.select(F.concat(
    F.when(F.col("key") % 2 == 0, F.regexp_replace(F.lpad(F.hex("key"), 6, "0"), "(..)(..)(..)", "$1-$2-$3")).otherwise(F.lower(F.lpad(F.hex("key"), 6, "0"))),
    F.lit("   "), F.col("c_name"))), "oui")),
    "SELECT lpad(to_hex(c_custkey), 6, '0') AS prefix, c_name AS name FROM customer")


def _scan(v: Views) -> DataFrame:
    ports = F.array_join(F.transform("open_ports", lambda p: F.concat(
        F.split(F.split(p, ":")[0], "/")[0], F.lit("/open/"), F.split(F.split(p, ":")[0], "/")[1], F.lit("//"), F.coalesce(F.get(F.split(p, ":"), F.lit(1)), F.lit("")), F.lit("///"))), ", ")
    line = F.concat(F.lit("Host: "), "ip", F.lit(" ("), "hostname", F.lit(")\tPorts: 9/closed/tcp//discard///, "), ports, F.lit("\tOS: "), "os", F.lit("; details"))
    return L.scan_results(v.spark, _lines(v, v.old_assets.select(line).union(v.old_assets.select(F.lit("# scan"))), "scan"))


query("read_scan", lambda v: _scan(v).select("ip", "hostname", "os", F.array_join("open_ports", ",").alias("open_ports")),
      with_views("SELECT ip, hostname, os, array_to_string(open_ports, ',') AS open_ports FROM old_assets", "old_assets"))


def _scans(v: Views) -> DataFrame:
    """Two scan files: all old devices, some with their hardware address; and a part of them again, named anew."""
    key = F.substring("hostname", 5, 20)
    n = key.cast("int")
    ports = F.array_join(F.transform("open_ports", lambda p: F.concat(
        F.split(F.split(p, ":")[0], "/")[0], F.lit("/open/tcp//"), F.coalesce(F.get(F.split(p, ":"), F.lit(1)), F.lit("")), F.lit("///"))), ", ")
    mac = F.when(n % 3 == 0, F.concat(F.lit("\tMAC: "), F.upper("mac"), F.lit(" (Maker "), key, F.lit(")"))).otherwise("")
    one = F.concat(F.lit("Host: "), "ip", F.lit(" ("), "hostname", F.lit(")"), mac, F.lit("\tPorts: 9/closed/tcp//discard///, "), ports, F.lit("\tOS: "), "os", F.lit("; x"))
    two = F.concat(F.lit("Host: "), "ip", F.lit(" (scan-"), key, F.lit(")\tPorts: 443/open/tcp//https///\tOS: "), F.when(n % 8 == 0, "BSD 9; x").otherwise("A 1|B 2"))
    again = v.old_assets.where(n % 4 == 0)
    return L.scan_results(v.spark, [_lines(v, v.old_assets.select(one), "scan-1"), _lines(v, again.select(two), "scan-2")])


query("asset_scan_merge", lambda v: _ports(A.merge_scan(_inv(v), _scans(v))),
      with_views("", "inv", "old_assets").rstrip() + """,
  o AS (SELECT *, CAST(substring(hostname, 5) AS INTEGER) AS n FROM old_assets),
  lines AS (SELECT ip, hostname, os, open_ports, CASE WHEN n % 3 = 0 THEN lower(mac) END AS mac, 'Maker ' || n AS maker FROM o
    UNION ALL SELECT ip, 'scan-' || n, CASE WHEN n % 8 = 0 THEN 'BSD 9' ELSE '' END, ['443/tcp:https'], NULL, NULL FROM o WHERE n % 4 = 0),
  hosts AS (SELECT ip, min(hostname) AS hostname, min(nullif(os, '')) AS os, max(mac) AS mac, arg_max(maker, mac) AS maker FROM lines GROUP BY ip),
  ports AS (SELECT ip, list(port ORDER BY pos, port) AS ports FROM (SELECT ip, unnest(open_ports) AS port, unnest(range(len(open_ports))) AS pos FROM lines) GROUP BY ip)
SELECT coalesce(i.ip, h.ip) AS ip, coalesce(h.mac, i.mac, '') AS mac, CASE WHEN h.mac IS NOT NULL THEN h.maker ELSE coalesce(i.mac_vendor, '') END AS mac_vendor,
  coalesce(nullif(i.hostname, ''), h.hostname, '') AS hostname, coalesce(nullif(i.os, ''), h.os, '') AS os,
  array_to_string(coalesce(i.open_ports, []) || list_filter(coalesce(p.ports, []), lambda x: NOT list_contains(coalesce(i.open_ports, []), x)), ',') AS open_ports,
  CASE WHEN i.ip IS NULL OR h.mac IS NOT NULL THEN 'scan' ELSE i.source END AS source
FROM inv i FULL JOIN hosts h ON h.ip = i.ip LEFT JOIN ports p ON p.ip = h.ip""")


def _telemetry(v: Views) -> DataFrame:
    """Two files a day: a document and a bare list of records."""
    rec = F.struct(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "temp_c", "cpu_pct", "mem_pct", "top_cpu", "top_mem", "fan_1", "fan_2")
    rows = v.telemetry.select(F.to_date("time").cast("string").alias("date"), (F.col("event_id") % 2).alias("half"), rec.alias("r"))
    docs = rows.groupBy("date", "half").agg(F.sort_array(F.collect_list("r")).alias("records"))
    text = F.when(F.col("half") == 0, F.to_json(F.struct("date", "records"))).otherwise(F.to_json("records"))
    path = _folder(v, "telemetry")
    docs.select("date", "half", text.alias("value")).repartition("date", "half").write.partitionBy("date", "half").text(path)
    return L.telemetry_days(v.spark, f"{path}/*/*")


query("read_telemetry", lambda v: _telemetry(v).select(
    F.unix_timestamp("time").alias("sec"), "temp_c", F.round("cpu_pct", 6).alias("cpu_pct"), "mem_pct", F.get("top_cpu", F.lit(0))["name"].alias("cpu_name"),
    F.get("top_mem", F.lit(0))["name"].alias("mem_name"), "fan_1", "fan_2"),
    with_views("""SELECT CAST(floor(epoch(time)) AS BIGINT) AS sec, temp_c, round(cpu_pct, 6) AS cpu_pct, mem_pct, top_cpu_name AS cpu_name, top_mem_name AS mem_name, fan_1, fan_2
FROM telemetry""", "telemetry"))
query("read_mime", lambda v: L.mime_extensions(v.spark, _lines(v, v.table("part").select(F.concat(
    "p_partkey", F.lit(",type/"), "p_partkey", F.lit(','), F.when(F.col("p_partkey") % 4 == 0, "none").otherwise(
        F.concat(F.lit('".A'), "p_partkey", F.lit(", b"), "p_partkey", F.lit('."'))), F.lit(",[ref]"))), "mime")),
    """SELECT 'type/' || p_partkey AS mime, '.a' || p_partkey AS ext FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'type/' || p_partkey, '.b' || p_partkey FROM part WHERE p_partkey % 4 <> 0""")


# -- writers --------------------------------------------------------------------------------------------------
def _days_written(v: Views) -> DataFrame:
    """All days, then one day again with half its rows, then the retention; what is left is counted."""
    path = _folder(v, "days")
    rows = v.conn.select("event_id", "day", "orig_ip_bytes")
    K.write_days(rows, path)
    K.write_days(rows.where("day = DATE '2024-01-25' AND event_id % 2 = 0"), path)
    K.prune_days(v.spark, path, "2024-01-30", 10)
    left = v.spark.read.schema(rows.schema).parquet(path)
    return left.groupBy("day").agg(F.count("*").alias("n"), F.sum("orig_ip_bytes").alias("bytes")).withColumn("day", F.col("day").cast("string"))


query("write_days", _days_written, with_views("""SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum(orig_ip_bytes) AS BIGINT) AS bytes
FROM conn WHERE day >= DATE '2024-01-20' AND (day <> DATE '2024-01-25' OR event_id % 2 = 0) GROUP BY day""", "conn"))


def _stats(v: Views) -> DataFrame:
    """Two runs of one component and one of another; the last run of each counts."""
    path = _folder(v, "stats")
    counts = v.alerts.groupBy(F.col("rule").alias("reason")).agg(F.count("*").alias("n"))
    K.append_stats(counts, path, "ids", "2024-01-30 10:00:00")
    K.append_stats(counts.withColumn("n", F.col("n") + 1), path, "ids", "2024-01-30 11:00:00")
    K.append_stats(counts.where("n > 10"), path, "dns", "2024-01-30 09:00:00")
    return K.latest_stats(v.spark.read.parquet(path)).select("component", "reason", "n")


query("gate_stats", _stats, with_views("""SELECT 'ids' AS component, rule AS reason, count(*) + 1 AS n FROM alerts GROUP BY rule
UNION ALL SELECT 'dns', rule, count(*) FROM alerts GROUP BY rule HAVING count(*) > 10""", "alerts"))


def _versions(v: Views) -> DataFrame:
    """Known pairs as versioned state: each third of the month adds its pairs to what the last version holds."""
    path = _folder(v, "pairs")
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-01-31")):
        new = v.conn.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("src", "dst", "dst_port").agg(F.min("day").alias("first"))
        old = K.read_state(v.spark, path)
        both = new if old is None else new.unionByName(old)
        K.write_state(both.groupBy("src", "dst", "dst_port").agg(F.min("first").alias("first")), path)
    return K.read_state(v.spark, path).withColumn("first", F.col("first").cast("string"))


query("versioned_pairs", _versions, with_views("SELECT src, dst, dst_port, CAST(min(day) AS VARCHAR) AS first FROM conn GROUP BY ALL", "conn"))


# -- mixed address families, many globs -----------------------------------------------------------------------
def _v6(k: Column) -> Column:
    return F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.floor(k / 65536))), F.lit(":"), F.lower(F.hex(k % 65536)))


def _v4(n: str) -> Column:
    return F.concat_ws(".", *[(F.floor(F.col(n) / (1 << s)) % 256).cast("string") for s in (24, 16, 8, 0)])


def _mixed(v: Views) -> DataFrame:
    """Owners of v4 and v6 destinations: the listed v4 ranges and one unaligned v6 range per supplier in one table."""
    k = F.col("s_suppkey")
    six = v.table("supplier").select((k + 1000).alias("ord"), _v6(k * 40000 + 7).alias("lo"), _v6(k * 40000 + 7 + k % 300 * 100).alias("hi"), F.col("s_name").alias("org"))
    four = v.listed("geo").select(F.col("ord").cast("long").alias("ord"), _v4("lo").alias("lo"), _v4("hi").alias("hi"), "org")
    table = R.address_range_table(four.unionByName(six))
    n = v.table("supplier").count()
    ips = v.conn.select("dst").union(v.conn.select(_v6((F.col("event_id") * 7919) % (n * 40000)))).toDF("ip").distinct()
    return R.lookup(ips, "ip", table, ["org"])


query("geo_join_mixed", _mixed, with_views("", "conn", "l_geo").rstrip() + """,
  six AS (SELECT s_suppkey * 40000 + 7 AS lo, s_suppkey * 40000 + 7 + s_suppkey % 300 * 100 AS hi, s_name AS org FROM supplier),
  ks AS (SELECT DISTINCT (event_id * 7919) % ((SELECT count(*) FROM supplier) * 40000) AS k FROM conn)
SELECT '2001:db8::' || lower(to_hex(k // 65536)) || ':' || lower(to_hex(k % 65536)) AS ip, org FROM ks JOIN six ON k BETWEEN lo AND hi
UNION ALL SELECT ip, org FROM (SELECT dst AS ip, """ + geo_of("dst", "org") + """ AS org FROM (SELECT DISTINCT dst FROM conn)) WHERE org IS NOT NULL""")


def _many_globs(v: Views) -> DataFrame:
    """First of the irregular globs, one per page, that each looked-up name matches."""
    site = F.col("site")
    glob = F.concat(F.substring(site, 1, 1), F.lit("?"), F.substring(site, 3, 4), F.lit("*"), F.substring(site, -6, 3), F.lit("[a-z]"), F.substring(site, -2, 2))
    patterns = v._sites.select(F.col("page_id").cast("int").alias("ord"), glob.alias("pattern"))
    return S.glob_lookup(v.dns.select(F.col("query").alias("name")), "name", patterns)


query("glob_many", _many_globs, with_views("""SELECT query AS name, CAST(min(page_id) AS INTEGER) AS ord FROM (SELECT DISTINCT query FROM dns)
JOIN (SELECT page_id, site[1:1] || '?' || substring(site, 3, 4) || '*' || substring(site, length(site) - 5, 3) || '[a-z]' || right(site, 2) AS p FROM sites) ON query GLOB p GROUP BY query""", "dns", "sites"))
