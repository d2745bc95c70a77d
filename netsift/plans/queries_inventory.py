"""Registered queries: IDS, assets, intel, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import devices as V
from ..operators import assets as A
from ..operators import findings as D
from ..operators import ids as S
from ..operators import intel as T
from ..operators import telemetry as M
from . import queries_cadence as QC
from . import queries_findings as _findings  # noqa: F401 - its views
from . import reference_lists as L
from .oracle_views import lan, v4num, view, with_views
from .queries_network import TODAY
from .registry import ORACLE, query

_text = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})

# -- IDS ------------------------------------------------------------------------------------------
view("rel", """SELECT * FROM alerts WHERE rule NOT LIKE 'SURICATA STREAM%' AND rule NOT LIKE 'SURICATA QUIC%'
  AND src_ip NOT IN (SELECT ip FROM fp_devices) AND dst_ip NOT IN (SELECT ip FROM fp_devices)""", "alerts", "fp_devices")
view("peers", f"""SELECT DISTINCT dst AS ext_ip, src AS lan_ip FROM conn WHERE {lan('src')} AND NOT {lan('dst')}
  AND dst IN (SELECT src_ip FROM rel UNION SELECT dst_ip FROM rel)""", "conn", "rel")
_rel = lambda v: S.relevant(v.alerts, v.registry)
query("sig_summary", lambda v: S.signatures(_rel(v)).withColumn("last_seen", F.unix_timestamp("last_seen")),
      with_views("""SELECT rule, count(*) AS count, arg_min(priority, (ts, event_id)) AS priority, count(DISTINCT src_ip) AS unique_srcs,
  CAST(floor(epoch(max(ts))) AS BIGINT) AS last_seen FROM rel GROUP BY rule""", "rel"))
query("alert_lan_rows", lambda v: S.lan_rows(_rel(v), v.conn, v.registry),
      with_views("", "rel", "peers").rstrip() + f""",
  d AS (SELECT CASE WHEN {lan('src_ip')} THEN src_ip ELSE dst_ip END AS lan_ip, CASE WHEN {lan('src_ip')} THEN dst_ip ELSE src_ip END AS ext_ip, rule, priority, ts, event_id
    FROM rel WHERE {lan('src_ip')} OR {lan('dst_ip')}
    UNION ALL SELECT p.lan_ip, p.ext_ip, rule, priority, ts, event_id FROM rel JOIN peers p ON p.ext_ip IN (src_ip, dst_ip)
    WHERE NOT {lan('src_ip')} AND NOT {lan('dst_ip')} AND p.lan_ip NOT IN (SELECT ip FROM fp_devices))
SELECT lan_ip, ext_ip, rule, count(*) AS count, arg_min(priority, (ts, event_id)) AS priority FROM d GROUP BY lan_ip, ext_ip, rule""")
query("alert_unresolved", lambda v: S.unresolved(_rel(v), v.conn),
      with_views(f"""SELECT src_ip, dst_ip, rule, arg_min(priority, (ts, event_id)) AS priority, count(*) AS count FROM rel WHERE NOT {lan('src_ip')} AND NOT {lan('dst_ip')}
  AND src_ip NOT IN (SELECT dst FROM conn) AND dst_ip NOT IN (SELECT dst FROM conn) GROUP BY src_ip, dst_ip, rule""", "rel", "conn"))
query("alert_categories", lambda v: S.categories(_rel(v)),
      with_views("SELECT split_part(rule, ' ', 1) || ' ' || split_part(rule, ' ', 2) AS category, count(*) AS count FROM rel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "rel"))
query("alert_hours", lambda v: S.hours(_rel(v)),
      with_views("SELECT h AS hour, (SELECT count(*) FROM rel WHERE hour(ts) = h) AS count FROM range(24) t(h)", "rel"))
query("alert_priorities", lambda v: S.priorities(_rel(v)), with_views("SELECT priority, count(*) AS count FROM rel GROUP BY 1", "rel"))
query("alert_trend_details", lambda v: _text(S.trend_details(_rel(v)).withColumn("ts", F.unix_timestamp("ts")), "day"),
      with_views("SELECT CAST(day AS VARCHAR) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS ts, priority, rule, src_ip, dst_ip FROM rel", "rel"))
query("alert_trend", lambda v: _text(S.trend(_rel(v), "2024-02-02"), "day"),
      with_views("""SELECT CAST(d AS VARCHAR) AS day, (SELECT count(*) FROM rel WHERE rel.day = d) AS count,
  (SELECT count(*) FROM rel WHERE rel.day = d) = 0 AND d <> DATE '2024-02-02' AS no_data
FROM (SELECT CAST(DATE '2024-02-02' - CAST(i AS INTEGER) AS DATE) AS d FROM range(7) t(i))""", "rel"))
query("offenders", lambda v: S.offenders(_rel(v)),
      with_views("", "rel").rstrip() + f""",
  p AS (SELECT DISTINCT unnest([src_ip, dst_ip]) AS ip, rule FROM rel), q AS (SELECT * FROM p WHERE NOT {lan('ip')}),
  t AS (SELECT ip, count(*) AS rule_count, list(rule ORDER BY rule) AS l FROM q GROUP BY ip HAVING count(*) >= 2 ORDER BY 2 DESC, ip LIMIT 20)
SELECT ip, rule_count, array_to_string(l[1:3], ' | ') AS rules FROM t""")
query("rule_context", lambda v: S.rule_context(v.eve),
      with_views("", "alerts", "sites").rstrip() + """,
  e AS (SELECT ts, event_id, rule, event_id % 5 AS j, site, path FROM alerts JOIN sites ON page_id = event_id % (SELECT count(*) FROM pages))
SELECT rule, arg_min(site, (ts, event_id)) FILTER (j = 0) AS http_host, arg_min(path, (ts, event_id)) FILTER (j = 0) AS http_url,
  CASE WHEN bool_or(j = 0) THEN 'curl/8' END AS http_agent, CASE WHEN bool_or(j = 0) THEN 'GET' END AS http_method,
  arg_min(site, (ts, event_id)) FILTER (j = 1) AS dns_query, arg_min(site, (ts, event_id)) FILTER (j = 2) AS tls_sni FROM e GROUP BY rule""")
query("beacon_overlap", lambda v: S.beacon_overlap(_rel(v), v.findings, v.registry),
      with_views(f"SELECT src_ip AS ip FROM rel WHERE {lan('src_ip')} INTERSECT SELECT src FROM findings WHERE src <> '::' AND src NOT IN (SELECT ip FROM fp_devices)", "rel", "findings"))
query("p1_alerts", lambda v: _text(S.p1_alerts(v.alerts), "day"),
      with_views("", "alerts").rstrip() + f""",
  p AS (SELECT * FROM alerts WHERE priority = 1)
SELECT CAST(day AS VARCHAR) AS day, 'suricata_p1_lan' AS type, src_ip AS device, 'SID ' || sid || ' — ' || substring(arg_min(rule, (ts, event_id)), 1, 80) || ' (' ||
  arg_min(proto, (ts, event_id)) || ' ' || src_ip || ' → ' || arg_min(dst_ip, (ts, event_id)) || ')' AS detail FROM p WHERE {lan('src_ip')} GROUP BY p.day, sid, src_ip
UNION ALL SELECT CAST(day AS VARCHAR), 'suricata_p1_repeated', 'sensor', 'SID ' || sid || ' fired ≥5× today — ' || substring(arg_min(rule, (ts, event_id)), 1, 80)
FROM p GROUP BY p.day, sid HAVING count(*) >= 5""")

# -- assets ---------------------------------------------------------------------------------------
_VEND = {"3C22FB": "Apple, Inc.", "001A2B": "Example Printers", "D83ADD": "Raspberry Pi Trading Ltd", "DCA632": "Raspberry Pi Trading Ltd"}
_VSQL = "coalesce(CASE upper(replace(mac, ':', ''))[1:6] " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in _VEND.items()) + " END, '')"
_UA = "CASE " + " ".join(f"WHEN user_agent = {L.literal(a)} THEN {L.literal(o)}" for a, o in zip(
    L.USER_AGENTS, ["iOS 17.2", "Windows 10/11", "Android 13", "Linux", None, "Sonos"]) if o) + " END"
view("inv", f"""
  SELECT b.ip, b.mac, mac_vendor, coalesce(nullif(b.hostname, ''), nullif(m.hostname, ''), nullif(o.hostname, ''), '') AS hostname,
    coalesce(nullif(osx, ''), nullif(m.os, ''), nullif(o.os, ''), '') AS os,
    CASE WHEN len(coalesce(m.open_ports, [])) > 0 THEN m.open_ports ELSE coalesce(o.open_ports, []) END AS open_ports, source
  FROM (SELECT *, CASE WHEN k IS NOT NULL AND NOT starts_with(lower(coalesce(ua, '')), lower(k)) AND (sure OR ua IS NULL) THEN k ELSE coalesce(ua, '') END AS osx
    FROM (SELECT *, CASE WHEN starts_with(lower(hostname), 'iphone') THEN 'iOS' WHEN starts_with(lower(hostname), 'desktop-') THEN 'Windows 10/11'
          WHEN mac_vendor LIKE 'Raspberry Pi%' THEN 'Linux (Raspberry Pi OS)' WHEN mac_vendor LIKE 'Apple%' AND contains(hostname, 'mac-mini') THEN 'macOS' END AS k,
        (starts_with(lower(hostname), 'iphone') OR starts_with(lower(hostname), 'desktop-') OR mac_vendor LIKE 'Raspberry Pi%') AS sure
      FROM (SELECT g.*, {_VSQL} AS mac_vendor, (SELECT arg_max(os, (n, os)) FROM (SELECT {_UA} AS os, count(*) AS n FROM http WHERE src = g.ip GROUP BY 1) WHERE os IS NOT NULL) AS ua
        FROM (SELECT ip, coalesce(arg_min(mac, (rk, mac)) FILTER (mac <> ''), '') AS mac, coalesce(arg_min(hostname, (rk, hostname)) FILTER (hostname NOT IN ('', '-')), '') AS hostname,
            CASE min(rk) WHEN 0 THEN 'leases' WHEN 1 THEN 'arp' ELSE 'dhcp' END AS source
          FROM (SELECT ip, 0 AS rk, mac, hostname FROM leases UNION ALL SELECT ip, 1, mac, '' FROM arp_table UNION ALL SELECT ip, 2, mac, hostname FROM dhcp_log) GROUP BY ip) g))) b
  LEFT JOIN (SELECT mac, arg_min(hostname, (ip, hostname, os)) AS hostname, arg_min(os, (ip, hostname, os)) AS os, arg_min(open_ports, (ip, hostname, os)) AS open_ports FROM old_assets GROUP BY mac) m ON m.mac = b.mac
  LEFT JOIN old_assets o ON o.ip = b.ip""", "leases", "arp_table", "dhcp_log", "http", "old_assets")
_inv = lambda v: A.merge_assets(v.leases, v.arp_table, v.dhcp_log, v.http, v.vendor_prefixes, v.old_assets)
_ports = lambda df: df.withColumn("open_ports", F.array_join("open_ports", ","))
query("asset_merge", lambda v: _ports(_inv(v)), with_views("SELECT * REPLACE (array_to_string(open_ports, ',') AS open_ports) FROM inv", "inv"))
query("asset_one_per_mac", lambda v: A.one_address_per_mac(_inv(v)).select("ip", "mac", "source"),
      with_views("SELECT ip, mac, source FROM inv QUALIFY row_number() OVER (PARTITION BY CASE WHEN mac = '' THEN ip ELSE mac END ORDER BY CASE WHEN source = 'arp' THEN 1 ELSE 0 END, ip) = 1", "inv"))
_fpm = lambda v: v.listed("rules").where("kind = 'devices'").select(F.col("pattern").alias("mac"))
query("new_devices", lambda v: A.new_devices(_inv(v), v.arp_table.select("mac"), v.old_assets, _fpm(v)),
      with_views("""SELECT ip, mac, mac_vendor, hostname, starts_with(mac, 'a2') AS gated FROM inv WHERE mac <> '' AND mac NOT IN (SELECT mac FROM arp_table)
  AND mac NOT IN (SELECT mac FROM old_assets) AND mac NOT IN (SELECT pattern FROM l_rules WHERE kind = 'devices')""", "inv", "l_rules"))
query("new_device_alerts", lambda v: A.device_alerts(A.new_devices(_inv(v), v.arp_table.select("mac"), v.old_assets, _fpm(v))),
      with_views("""SELECT 'new_device' AS type, 'medium' AS severity, ip AS device, 'MAC ' || mac || ' — ' || coalesce(nullif(mac_vendor, ''), 'unknown vendor') ||
  CASE WHEN hostname <> '' THEN ' (' || hostname || ')' ELSE '' END AS detail FROM inv WHERE mac <> '' AND NOT starts_with(mac, 'a2') AND mac NOT IN (SELECT mac FROM arp_table)
  AND mac NOT IN (SELECT mac FROM old_assets) AND mac NOT IN (SELECT pattern FROM l_rules WHERE kind = 'devices')""", "inv", "l_rules"))
query("known_macs", lambda v: A.remember_macs(v.leases, v.old_assets),
      with_views("SELECT lower(mac) AS mac FROM leases UNION SELECT lower(mac) FROM old_assets", "leases", "old_assets"))
_replayed = lambda v: A.replay_dhcp(v.dhcp_log, TODAY)
_REPLAY = f"""rp AS (SELECT ip, arg_max(mac, (day, mac)) AS mac, coalesce(arg_max(hostname, (day, hostname)) FILTER (hostname NOT IN ('', '-')), '') AS hostname,
    min(day) AS first_seen, max(day) AS last_seen FROM dhcp_log WHERE day >= DATE '{TODAY}' - 14 AND day <= DATE '{TODAY}' GROUP BY ip)"""
query("asset_replay", lambda v: _text(_replayed(v), "first_seen", "last_seen"),
      with_views("", "dhcp_log").rstrip() + "," + _REPLAY + "SELECT * REPLACE (CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen) FROM rp")
_wide = lambda v: _replayed(v).select("ip", "mac", F.lit("").alias("mac_vendor"), "hostname", F.lit("").alias("os"),
                                      F.array().cast("array<string>").alias("open_ports"), "first_seen", "last_seen")
query("asset_history", lambda v: _text(_ports(A.fold_history(_wide(v), _inv(v), "2024-02-04")), "first_seen", "last_seen"),
      with_views("", "inv").rstrip() + "," + _REPLAY + """
SELECT coalesce(a.ip, h.ip) AS ip, coalesce(a.mac, h.mac) AS mac, coalesce(a.mac_vendor, '') AS mac_vendor, CASE WHEN a.ip IS NOT NULL THEN a.hostname ELSE h.hostname END AS hostname,
  coalesce(a.os, '') AS os, array_to_string(coalesce(a.open_ports, []), ',') AS open_ports, CAST(coalesce(h.first_seen, DATE '2024-02-04') AS VARCHAR) AS first_seen,
  CAST(CASE WHEN a.ip IS NOT NULL THEN DATE '2024-02-04' ELSE h.last_seen END AS VARCHAR) AS last_seen
FROM rp h FULL JOIN inv a ON a.ip = h.ip WHERE a.ip IS NOT NULL OR h.last_seen >= DATE '2024-02-04' - 14""")
query("asset_ghosts", lambda v: A.ghosts(_replayed(v), v.leases, TODAY).select("ip", "mac", "days_ago"),
      with_views("", "dhcp_log", "leases").rstrip() + "," + _REPLAY + f"""
SELECT ip, mac, CAST(date_diff('day', last_seen, DATE '{TODAY}') AS INTEGER) AS days_ago FROM rp WHERE ip NOT IN (SELECT ip FROM leases)""")
query("device_labels",
      lambda v: A.labels(v.conn.select(F.col("src").alias("ip")), v.spark.sql("SELECT * FROM VALUES ('10.0.0.5', 'office router') AS t(ip, name)"),
                         v.leases, v.old_assets.withColumn("mac_vendor", F.lit("vendor"))),
      with_views("""SELECT DISTINCT c.src AS ip, c.src || ' (' || CASE WHEN c.src = '10.0.0.5' THEN 'office router' ELSE coalesce(nullif(l.hostname, ''), o.hostname) END || ')' AS label
FROM conn c LEFT JOIN leases l ON l.ip = c.src LEFT JOIN old_assets o ON o.ip = c.src WHERE c.src = '10.0.0.5' OR coalesce(nullif(l.hostname, ''), o.hostname) IS NOT NULL
UNION SELECT DISTINCT c.src, c.src FROM conn c LEFT JOIN leases l ON l.ip = c.src LEFT JOIN old_assets o ON o.ip = c.src
WHERE c.src <> '10.0.0.5' AND coalesce(nullif(l.hostname, ''), o.hostname) IS NULL""", "conn", "leases", "old_assets"))
query("ua_votes", lambda v: A.user_agent_votes(v.http),
      with_views(f"SELECT src AS ip, arg_max(os, (n, os)) AS os FROM (SELECT src, {_UA} AS os, count(*) AS n FROM http GROUP BY 1, 2) WHERE os IS NOT NULL GROUP BY 1", "http"))
query("mac_expressions", lambda v: v.leases.select("mac", V.is_local_mac("mac").alias("randomised"), V.mac_prefix("mac").alias("prefix")),
      with_views("SELECT mac, starts_with(mac, 'a2') AS randomised, upper(replace(mac, ':', ''))[1:6] AS prefix FROM leases", "leases"))

# -- intel ----------------------------------------------------------------------------------------
_NOTPUB = "'^(0|10|127|22[4-9]|2[3-5][0-9])\\.|^(169\\.254|192\\.168|192\\.0\\.[02]|198\\.1[89]|198\\.51\\.100|203\\.0\\.113|172\\.(1[6-9]|2[0-9]|3[01]))\\.'"
view("tgt", f"""
  SELECT ip, CAST(min(age) AS INTEGER) AS age, max(n) AS n FROM (SELECT dst AS ip, date_diff('day', day, DATE '{TODAY}') AS age, count(*) AS n FROM findings
    WHERE day > DATE '{TODAY}' - 7 AND dst <> '::' AND NOT regexp_matches(dst, {_NOTPUB}) GROUP BY dst, day) GROUP BY ip
  UNION ALL SELECT DISTINCT dst_ip, 0, 1 FROM alerts WHERE day > DATE '{TODAY}' - 7 AND NOT regexp_matches(dst_ip, {_NOTPUB})
    AND dst_ip NOT IN (SELECT dst FROM findings WHERE day > DATE '{TODAY}' - 7)""", "findings", "alerts")
_tgt = lambda v: T.targets(v.findings, v.alerts, TODAY)
query("intel_targets", _tgt, with_views("SELECT * FROM tgt", "tgt"))
query("intel_stale", lambda v: T.stale(_tgt(v), v.intel, TODAY, 60),
      with_views(f"""SELECT * FROM tgt WHERE ip NOT IN (SELECT ip FROM intel WHERE fetched >= DATE '{TODAY}' - 30 AND has_scan AND has_abuse)
ORDER BY age, n DESC, ip LIMIT 60""", "tgt", "intel"))
view("stamped", f"""
  SELECT *, sbl IS NOT NULL AS listed, ip IN (SELECT ip FROM l_exit_ips) AS exit_node FROM (SELECT *, (SELECT b.sbl FROM (
      SELECT ord, sbl, plen, {v4num('net')} AS a FROM (SELECT ord, sbl, split_part(cidr, '/', 1) AS net, CAST(split_part(cidr, '/', 2) AS INTEGER) AS plen
        FROM l_blocklist WHERE regexp_matches(cidr, '^[0-9.]+/[0-9]+$'))) b
    WHERE {v4num('i.ip')} // pow(2, 32 - b.plen)::BIGINT = b.a // pow(2, 32 - b.plen)::BIGINT ORDER BY b.ord LIMIT 1) AS sbl FROM intel i)""", "intel", "l_blocklist", "l_exit_ips")
_stamp = lambda v: T.restamp(v.intel, v.blocklist, v.listed("exit_ips"))
query("intel_restamp", lambda v: _stamp(v).select("ip", "sbl", "listed", "exit_node"), with_views("SELECT ip, sbl, listed, exit_node FROM stamped", "stamped"))
query("intel_badge", lambda v: T.badges(_stamp(v)),
      with_views("""SELECT ip, CASE WHEN coalesce(abuse_score, 0) >= 75 OR list_contains(tags, 'honeypot') OR n_vulns > 0 OR listed OR exit_node THEN 'high'
  WHEN coalesce(abuse_score, 0) > 0 OR len(tags) > 0 OR n_ports >= 50 THEN 'med' ELSE 'none' END AS badge FROM stamped""", "stamped"))
view("rating", f"""
  SELECT ip, CASE WHEN coalesce(abuse_score, 0) >= 75 OR list_contains(tags, 'honeypot') OR n_vulns > 0 OR listed OR exit_node THEN 'high'
      WHEN coalesce(abuse_score, 0) > 0 OR len(tags) > 0 OR n_ports >= 50 THEN 'med' ELSE 'none' END AS badge,
    coalesce(nullif(concat_ws('; ', CASE WHEN listed THEN 'block list ' || sbl END, CASE WHEN exit_node THEN 'exit node' END,
      CASE WHEN abuse_score > 0 THEN 'abuse ' || abuse_score || '/100' END, CASE WHEN len(tags) > 0 THEN 'tags ' || array_to_string(tags, ', ') END,
      CASE WHEN n_vulns > 0 THEN 'known flaws ' || n_vulns END, CASE WHEN n_ports > 0 THEN 'open ports ' || n_ports END), ''), 'nothing known') AS evidence
  FROM stamped WHERE (has_scan OR has_abuse OR listed OR exit_node) AND NOT {lan('ip')}""", "stamped")
_rated = lambda sql, address, name, t: f"SELECT x.*, {t}.badge AS {name}_badge, {t}.evidence AS {name}_evidence FROM ({sql}) x LEFT JOIN rating {t} ON {t}.ip = trim(x.{address})"
query("alert_lan_intel", lambda v: T.rated(S.lan_rows(_rel(v), v.conn, v.registry), _stamp(v), ext_ip="ext"),
      with_views(_rated(ORACLE["alert_lan_rows"], "ext_ip", "ext", "r"), "rating"))
query("alert_unresolved_intel", lambda v: T.rated(S.unresolved(_rel(v), v.conn), _stamp(v), src_ip="src", dst_ip="dst"),
      with_views(_rated(_rated(ORACLE["alert_unresolved"], "src_ip", "src", "r"), "dst_ip", "dst", "q"), "rating"))
query("finding_intel", lambda v: T.rated(D.dedup(v.findings).select("src", "dst", "fqdn", "severity", "score"), _stamp(v), dst="dst"),
      with_views(_rated("SELECT src, dst, fqdn, severity, score FROM dedup", "dst", "dst", "r"), "rating", "dedup"))
query("candidate_intel", lambda v: T.rated(QC._cand(v, QC.ALL_DAYS).select("src", "dst"), _stamp(v), dst="dst"),
      with_views(_rated(f"SELECT src, dst FROM ({ORACLE['slow_candidates']})", "dst", "dst", "r"), "rating"))
query("intel_gc", lambda v: T.collect_garbage(v.intel, _tgt(v), TODAY).select("ip"),
      with_views(f"SELECT ip FROM intel WHERE fetched >= DATE '{TODAY}' - 60 OR ip IN (SELECT ip FROM tgt)", "intel", "tgt"))

# -- telemetry ------------------------------------------------------------------------------------
query("telemetry_hourly", lambda v: _text(
        M.hourly(v.telemetry).withColumn("top_cpu", F.get("top_cpu", F.lit(0))["name"]).withColumn("top_mem", F.get("top_mem", F.lit(0))["name"]), "hour"),
      with_views("""SELECT host, strftime(date_trunc('hour', time), '%Y-%m-%d %H:%M:%S') AS hour, max(temp_c) AS temp_c, max(cpu_pct) AS cpu_pct, max(mem_pct) AS mem_pct,
  arg_max(top_cpu_name, (cpu_pct, time, event_id)) FILTER (top_cpu_name IS NOT NULL) AS top_cpu, arg_max(top_mem_name, (mem_pct, time, event_id)) AS top_mem,
  bool_or(fan_1) AS fan_1, bool_or(fan_2) AS fan_2 FROM telemetry GROUP BY 1, 2""", "telemetry"))
_DUTY = """SELECT host, count(*) AS samples, round(count(*) FILTER (fan_1) * 100.0 / count(*), 6) AS duty_pct, max(temp_c) AS peak_c,
  median(temp_c) FILTER (NOT fan_1 AND NOT fan_2) AS idle_median_c, count(*) FILTER (b <> fan_1) AS transitions,
  round(count(*) FILTER (b <> fan_1) / (count(*) / 60.0), 6) AS transitions_per_hour
FROM (SELECT *, lag(fan_1) OVER (PARTITION BY host ORDER BY time, event_id) AS b FROM telemetry) GROUP BY host"""
query("transitions", lambda v: M.duty(v.telemetry, "fan_1", "fan_2").withColumn("duty_pct", F.round("duty_pct", 6))
      .withColumn("transitions_per_hour", F.round("transitions_per_hour", 6)), with_views(_DUTY, "telemetry"))
_ROLL = """ro AS (SELECT host, time, event_id, row_number() OVER w AS no, avg(cpu_pct) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS mean,
    avg(cpu_pct) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS short_mean FROM telemetry WINDOW w AS (PARTITION BY host ORDER BY time, event_id) QUALIFY no >= 60)"""
query("rolling_gauge", lambda v: M.rolling_mean(v.telemetry).select("host", "event_id", F.col("no").cast("bigint").alias("no"),
        F.round("mean", 6).alias("mean"), F.round("short_mean", 6).alias("short_mean")),
      with_views("", "telemetry").rstrip() + "," + _ROLL + "SELECT host, event_id, no, round(mean, 6) AS mean, round(short_mean, 6) AS short_mean FROM ro")
query("chart_bounds", lambda v: M.chart_bounds(v.telemetry, "temp_c").withColumn("p2", F.round("p2", 6)).withColumn("p98", F.round("p98", 6)),
      with_views("SELECT host, round(quantile_cont(temp_c, 0.02), 6) AS p2, round(quantile_cont(temp_c, 0.98), 6) AS p98 FROM telemetry GROUP BY host", "telemetry"))
query("capture_rate", lambda v: M.capture_rate(v.conn, "2024-01-30 23:55:00", "service"),
      with_views("""SELECT sensor, rows, CASE WHEN rows > 10 THEN 'ok' WHEN rows > 0 THEN 'warn' ELSE 'fail' END AS status FROM (
  SELECT service AS sensor, count(*) FILTER (epoch(TIMESTAMP '2024-01-30 23:55:00') - floor(epoch(ts)) BETWEEN 0 AND 299) AS rows FROM conn GROUP BY 1)""", "conn"))
query("freshness", lambda v: M.freshness(v.conn, "2024-01-31 00:30:00", "ts", "src"),
      with_views("""SELECT source, age_seconds, CASE WHEN age_seconds >= 21600 THEN 'fail' WHEN age_seconds >= 5400 THEN 'warn' ELSE 'ok' END AS status FROM (
  SELECT src AS source, CAST(epoch(TIMESTAMP '2024-01-31 00:30:00') AS BIGINT) - max(sec) AS age_seconds FROM conn GROUP BY 1)""", "conn"))
