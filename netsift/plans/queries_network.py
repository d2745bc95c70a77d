"""Registered queries: bandwidth, daily panels, fingerprints, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..operators import bandwidth as B
from ..operators import fingerprints as P
from ..operators import identity as I
from ..operators import network as W
from . import reference_lists as L
from .oracle_views import VIEWS, geo_of, glob_hit, lan, with_views
from .registry import query

TODAY = "2024-01-30"
_text = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
_SAFE_ORGS = "(" + ", ".join(L.literal(o) for o in C.SAFE_ORGS) + ")"
WAN = "conn WHERE src_local AND NOT dst_local"

query("bw_talkers", lambda v: B.talkers(v.conn).withColumn("last_active", F.unix_timestamp("last_active")),
      with_views(f"""SELECT src, CAST(sum(orig_ip_bytes) AS BIGINT) AS up_bytes, CAST(sum(resp_ip_bytes) AS BIGINT) AS down_bytes,
  CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS total_bytes, count(*) AS flows, count(DISTINCT dst) AS external_dests,
  max(sec) AS last_active FROM {WAN} GROUP BY src""", "conn"))
_TOP8 = f"top8 AS (SELECT src FROM {WAN} GROUP BY src ORDER BY sum(orig_ip_bytes + resp_ip_bytes) DESC, src LIMIT 8)"
_CELLS = f"""cells AS (SELECT date_trunc('hour', ts) AS hour, CASE WHEN src IN (SELECT src FROM top8) THEN src ELSE '__other__' END AS series,
  sum(orig_ip_bytes + resp_ip_bytes) AS b FROM {WAN} GROUP BY ALL)"""
query("bw_hourly_top8", lambda v: _text(B.hourly(v.conn), "hour"),
      with_views("", "conn").rstrip() + f""", {_TOP8}, {_CELLS}
SELECT strftime(h.hour, '%Y-%m-%d %H:%M:%S') AS hour, s.series, CAST(coalesce(sum(c.b), 0) AS BIGINT) AS bytes
FROM (SELECT DISTINCT hour FROM cells) h CROSS JOIN (SELECT DISTINCT series FROM cells) s
LEFT JOIN cells c ON c.hour = h.hour AND c.series = s.series GROUP BY ALL""")
query("bw_hourly_wide", lambda v: _text(B.hourly_wide(v.conn, ["10.0.0.1", "10.0.0.8"]), "hour"),
      with_views(f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour,
  CAST(coalesce(sum(orig_ip_bytes + resp_ip_bytes) FILTER (src = '10.0.0.1'), 0) AS BIGINT) AS "10.0.0.1",
  CAST(coalesce(sum(orig_ip_bytes + resp_ip_bytes) FILTER (src = '10.0.0.8'), 0) AS BIGINT) AS "10.0.0.8",
  CAST(coalesce(sum(orig_ip_bytes + resp_ip_bytes) FILTER (src NOT IN ('10.0.0.1', '10.0.0.8')), 0) AS BIGINT) AS "__other__"
FROM {WAN} GROUP BY 1""", "conn"))
query("bw_summary", lambda v: _text(B.summary(v.conn), "peak_hour"),
      with_views("", "conn").rstrip() + f""",
  w AS (SELECT *, orig_ip_bytes + resp_ip_bytes AS b FROM {WAN}),
  d AS (SELECT src, CAST(sum(b) AS BIGINT) AS b FROM w GROUP BY src), h AS (SELECT date_trunc('hour', ts) AS hour, CAST(sum(b) AS BIGINT) AS b FROM w GROUP BY 1)
SELECT CAST(sum(b) AS BIGINT) AS total_bytes, CAST(sum(orig_ip_bytes) AS BIGINT) AS up_bytes, CAST(sum(resp_ip_bytes) AS BIGINT) AS down_bytes,
  count(DISTINCT src) AS device_count, (SELECT src FROM d ORDER BY b DESC, src DESC LIMIT 1) AS top_device, (SELECT max(b) FROM d) AS top_device_bytes,
  (SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') FROM h ORDER BY b DESC, hour LIMIT 1) AS peak_hour, (SELECT max(b) FROM h) AS peak_hour_bytes
FROM w""")
query("bw_destinations", lambda v: B.destinations(v.conn, v.geo),
      with_views("", "conn", "l_geo").rstrip() + f""",
  t AS (SELECT dst, CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS total_bytes, count(*) AS flows, count(DISTINCT src) AS distinct_sources
    FROM {WAN} GROUP BY dst ORDER BY 2 DESC, dst LIMIT 20)
SELECT *, {geo_of('dst', 'cc')} AS cc, {geo_of('dst', 'city')} AS city, {geo_of('dst', 'org')} AS org FROM t""")
query("bw_device", lambda v: B.device_destinations(v.conn, v.geo, "10.0.0.9", "up"),
      with_views("", "conn", "l_geo").rstrip() + f""",
  t AS (SELECT dst, CAST(sum(orig_ip_bytes) AS BIGINT) AS up_bytes, CAST(sum(resp_ip_bytes) AS BIGINT) AS down_bytes,
    CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS total_bytes, count(*) AS flows
    FROM {WAN} AND src = '10.0.0.9' GROUP BY dst ORDER BY up_bytes DESC, dst LIMIT 10)
SELECT *, {geo_of('dst', 'cc')} AS cc, {geo_of('dst', 'city')} AS city, {geo_of('dst', 'org')} AS org FROM t""")

_NOT_FP = "src NOT IN (SELECT ip FROM fp_devices)"
query("exfil", lambda v: _text(W.exfil(v.conn, v.geo, v.registry, 0.2), "day"),
      with_views("", "conn", "l_geo", "fp_devices").rstrip() + f""",
  f AS (SELECT * FROM {WAN} AND orig_ip_bytes > 0 AND {_NOT_FP}),
  o AS (SELECT dst, {geo_of('dst', 'org')} AS org FROM (SELECT DISTINCT dst FROM f)),
  s AS (SELECT day, src, CAST(sum(orig_ip_bytes) AS BIGINT) AS total_bytes, count(*) AS conns, arg_max(dst, (orig_ip_bytes, dst)) AS top_dst
    FROM f JOIN o USING (dst) WHERE coalesce(org, '') NOT IN {_SAFE_ORGS} GROUP BY day, src HAVING total_bytes >= 200000)
SELECT CAST(day AS VARCHAR) AS day, src, total_bytes, conns, top_dst FROM s
QUALIFY row_number() OVER (PARTITION BY s.day ORDER BY total_bytes DESC, src) <= 20""")
query("night", lambda v: _text(W.night(v.conn, v.registry, min_conns=2), "day"),
      with_views("", "conn", "fp_devices").rstrip() + f""",
  s AS (SELECT day, src, count(*) AS conns, CAST(sum(greatest(orig_ip_bytes, 0)) AS BIGINT) AS bytes, count(DISTINCT dst) AS unique_dsts
    FROM {WAN} AND hour(ts) BETWEEN 1 AND 5 AND {_NOT_FP} GROUP BY day, src HAVING conns >= 2)
SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM s QUALIFY row_number() OVER (PARTITION BY s.day ORDER BY conns DESC, src) <= 20""")
_ENT = """CASE WHEN len(sld) >= 8 THEN list_sum(list_transform(list_distinct(string_split(sld, '')),
    lambda c: -(len(list_filter(string_split(sld, ''), lambda x: x = c)) / len(sld)) * log2(len(list_filter(string_split(sld, ''), lambda x: x = c)) / len(sld)))) ELSE 0.0 END"""
query("dns_anomalies", lambda v: _text(W.dns_anomalies(v.dns.withColumn("day", F.trunc("day", "month")), v.registry).withColumn("nxdomain_pct", F.round("nxdomain_pct", 6)), "day"),
      with_views("", "dns", "fp_devices", "l_rules").rstrip() + f""",
  q AS (SELECT * REPLACE (CAST(date_trunc('month', day) AS DATE) AS day), string_split(rtrim(lower(query), '.'), '.')[-2] AS sld FROM dns WHERE {lan('src')} AND {_NOT_FP} AND query NOT LIKE '%.in-addr.arpa'),
  t AS (SELECT day, src, count(*) AS total, count(*) FILTER (rcode_name = 'NXDOMAIN') AS nxdomain FROM q GROUP BY ALL),
  e AS (SELECT day, src, query, min(ts) AS f FROM q WHERE qtype_name IN ('A', 'AAAA') AND {_ENT} >= 3.5 AND NOT {glob_hit('query', 'domains')} GROUP BY ALL),
  x AS (SELECT day, src, string_agg(query, ', ' ORDER BY f, query) AS examples FROM
    (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY day, src ORDER BY f, query) <= 5) GROUP BY ALL),
  r AS (SELECT t.*, x.examples, total >= 30 AND nxdomain / total >= 0.25 AS bad FROM t LEFT JOIN x USING (day, src))
SELECT CAST(r.day AS VARCHAR) AS day, src, total, nxdomain, round(nxdomain / total * 100, 6) AS nxdomain_pct,
  CASE WHEN bad AND examples IS NOT NULL THEN 'both' WHEN bad THEN 'nxdomain' ELSE 'entropy' END AS flag, coalesce(examples, '') AS examples
FROM r WHERE bad OR examples IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY r.day ORDER BY nxdomain / total DESC, total DESC, src) <= 20""")
_TLS = f"""
  i0 AS (SELECT day, src, dst, server_name, unnest(list_filter([CASE WHEN server_name IS NULL THEN 'no-sni' END,
      CASE WHEN validation_status LIKE '%self signed%' THEN 'self-signed' END, CASE WHEN validation_status LIKE '%expired%' THEN 'expired' END],
      lambda x: x IS NOT NULL)) AS issue FROM ssl WHERE {lan('src')} AND NOT {lan('dst')} AND established AND {_NOT_FP}
      AND NOT {glob_hit('dst', 'domains')} AND NOT {glob_hit('server_name', 'domains')}),
  og AS (SELECT dst, {geo_of('dst', 'org')} AS org FROM (SELECT DISTINCT dst FROM i0)),
  iss AS (SELECT day, src, dst, issue, count(*) AS n, coalesce(nullif(any_value(org), ''), 'Unknown') AS org FROM i0 JOIN og USING (dst)
    WHERE issue <> 'no-sni' OR coalesce(org, '') NOT IN {_SAFE_ORGS} GROUP BY day, src, dst, issue)"""
_TLS_V = ("ssl", "fp_devices", "l_rules", "l_geo")
query("tls_issue_ips", lambda v: _text(W.tls_issues(v.ssl, v.geo, v.registry), "day"),
      with_views("", *_TLS_V).rstrip() + "," + _TLS + "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM iss")
query("tls_anomalies", lambda v: _text(W.tls_anomalies(W.tls_issues(v.ssl, v.geo, v.registry)), "day"),
      with_views("", *_TLS_V).rstrip() + "," + _TLS + """,
  en AS (SELECT day, src, org, issue, CAST(sum(n) AS BIGINT) AS count, count(*) AS n_ips, arg_max(dst, (n, dst)) AS top_ip,
    CASE issue WHEN 'expired' THEN 0 WHEN 'self-signed' THEN 1 ELSE 2 END AS rk FROM iss GROUP BY day, src, org, issue),
  so AS (SELECT day, src, row_number() OVER (PARTITION BY day ORDER BY min(rk), sum(count) DESC, src) AS src_place FROM en GROUP BY day, src)
SELECT CAST(day AS VARCHAR) AS day, src, CAST(src_place AS INTEGER) AS src_place, org, issue, count, n_ips, top_ip
FROM en JOIN so USING (day, src) WHERE src_place <= 50""")
query("weird", lambda v: W.weird(v.weird, v.registry),
      with_views("", "weird", "fp_devices").rstrip() + f""",
  s AS (SELECT DISTINCT name, src FROM weird WHERE {lan('src')} AND {_NOT_FP}),
  n AS (SELECT name, count(*) AS count, arg_min(addl, (ts, addl)) AS addl FROM weird WHERE name NOT IN ('-', '') GROUP BY name ORDER BY 2 DESC, name LIMIT 30)
SELECT name, count, (SELECT count(*) FROM s WHERE s.name = n.name) AS src_count,
  coalesce((SELECT string_agg(src, ', ' ORDER BY src) FROM (SELECT src FROM s WHERE s.name = n.name ORDER BY src LIMIT 3)), '—') AS srcs,
  substring(addl, 1, 60) AS addl FROM n""")
_FPM = lambda v: v.listed("rules").where("kind = 'devices'").select(F.col("pattern").alias("mac"))
_L2 = f"""
  c AS (SELECT DISTINCT day, src_ip AS ip, lower(src_mac) AS mac FROM arp WHERE operation <> 'bad' AND {lan('src_ip')}),
  l2 AS (SELECT day, 'gateway_impersonation' AS kind, 'critical' AS severity, ip, mac, 'MAC ' || mac || ' announced as gateway ' || ip AS detail FROM c
    WHERE ip = '{L.GATEWAY_IP}' AND mac NOT IN ('{L.GATEWAY_MACS[0]}', '{L.GATEWAY_MACS[1]}')
  UNION ALL SELECT day, 'mac_change', 'warning', ip, min(mac), count(*) || ' distinct MACs claiming ' || ip || ' today' FROM c WHERE ip <> '{L.GATEWAY_IP}'
    GROUP BY day, ip HAVING count(*) >= 2 AND count(*) FILTER (mac NOT IN ('{L.GATEWAY_MACS[0]}', '{L.GATEWAY_MACS[1]}')) > 0
    AND count(*) FILTER (mac IN (SELECT lower(pattern) FROM l_rules WHERE kind = 'devices')) = 0
  UNION ALL (SELECT day, 'bad_arp', 'info', src_ip, lower(src_mac), info FROM arp WHERE operation = 'bad'
    QUALIFY row_number() OVER (PARTITION BY day ORDER BY ts DESC, event_id DESC) <= 20))"""
query("l2_anomalies", lambda v: _text(W.l2_anomalies(v.arp, _FPM(v), L.GATEWAY_IP, L.GATEWAY_MACS), "day"),
      with_views("", "arp", "l_rules").rstrip() + "," + _L2 + "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM l2")

_LABEL = """
  lb AS (SELECT *, CASE WHEN array_to_string(parts, ' / ') = '' THEN 'Known JA4' ELSE array_to_string(parts, ' / ') END AS label FROM
    (SELECT ord, ja4, list_filter([nullif(app, ''), nullif(lib, ''), 'on ' || nullif(os, '')], lambda x: x IS NOT NULL) AS parts FROM l_ja4_labels)),
  ex AS (SELECT ja4, arg_max(label, ord) AS el FROM lb GROUP BY ja4),
  cf AS (SELECT split_part(ja4, '_', 2) AS ci, min(label) AS cl FROM lb GROUP BY 1 HAVING count(DISTINCT label) = 1),
  cls AS (SELECT d.ja4, coalesce(el, cl || ' (cipher-family)', shape, 'Unknown TLS client') AS label,
      CASE WHEN el IS NOT NULL THEN 'ja4db' WHEN cl IS NOT NULL THEN 'ja4db-cipher' WHEN shape IS NOT NULL THEN 'heuristic' ELSE 'unknown' END AS source,
      regexp_matches(lower(coalesce(el, cl, '')), 'cobalt strike|sliver|havoc|qakbot|pikabot|darkgate|icedid|lumma|ngrok|mythic|brute ratel')
        AND NOT contains(lower(coalesce(el, cl, '')), 'golang') AS is_threat
    FROM (SELECT DISTINCT ja4, CASE WHEN ja4 LIKE '_12%00\\_%' ESCAPE '\\' THEN 'TLS 1.2 / no-ALPN (IoT-likely)' WHEN ja4 LIKE 'q%' THEN 'QUIC client (Chrome / Apple-family)'
        WHEN regexp_matches(ja4, '^.13[^_]*h1_') THEN 'TLS 1.3 / h1 client (system service or app)' WHEN regexp_matches(ja4, '^.13[^_]*h2_') THEN 'TLS 1.3 / h2 client'
        WHEN ja4 LIKE 't%' THEN 'TLS client' END AS shape FROM ssl) d
    LEFT JOIN ex USING (ja4) LEFT JOIN cf ON ci = split_part(d.ja4, '_', 2))"""
_PRINTS = f"""
  pr AS (SELECT day, src, ja4, count(*) AS n FROM ssl WHERE {lan('src')} AND NOT {lan('dst')} AND {_NOT_FP} GROUP BY ALL),
  hi AS (SELECT src AS ip, ja4, min(day) AS first_seen, max(day) AS last_seen, count(*) AS cnt FROM ssl WHERE {lan('src')} GROUP BY src, ja4)"""
query("ja4_classify", lambda v: P.classify(v.ssl, v.listed("ja4_labels")),
      with_views("", "ssl", "l_ja4_labels").rstrip() + "," + _LABEL + "SELECT * FROM cls")
query("ja4_fold", lambda v: _text(P.fold_history(P.daily_counts(v.ssl)), "first_seen", "last_seen"),
      with_views("", "ssl", "fp_devices").rstrip() + "," + _PRINTS + """
SELECT ip, ja4, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, cnt AS count FROM hi""")
_hist = lambda v: P.fold_history(P.daily_counts(v.ssl))
query("ja4_inventory", lambda v: _text(P.inventory(P.wan_prints(v.ssl, v.registry), _hist(v), v.listed("ja4_labels")), "day"),
      with_views("", "ssl", "fp_devices", "l_ja4_labels").rstrip() + "," + _LABEL + "," + _PRINTS + """,
  m AS (SELECT pr.*, coalesce(first_seen >= day, TRUE) AS is_new, is_threat AND source = 'ja4db' AS thr FROM pr JOIN cls USING (ja4)
    LEFT JOIN hi ON hi.ip = pr.src AND hi.ja4 = pr.ja4),
  tp AS (SELECT day, src, string_agg(ja4 || '=' || n, ', ' ORDER BY n DESC, ja4) AS top FROM
    (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY day, src ORDER BY n DESC, ja4) <= 3) GROUP BY ALL)
SELECT CAST(m.day AS VARCHAR) AS day, m.src, count(*) AS n_unique, CAST(sum(n) AS BIGINT) AS n_total, count(*) FILTER (is_new) AS n_new, any_value(top) AS top,
  greatest(count(*) - 3, 0) AS more, count(*) = 1 AND sum(n) >= 5 AS outlier, count(*) FILTER (thr) AS n_threats
FROM m JOIN tp ON tp.day = m.day AND tp.src = m.src GROUP BY m.day, m.src""")
query("ja4_threats", lambda v: _text(P.threats(P.wan_prints(v.ssl, v.registry), v.listed("ja4_labels")), "day"),
      with_views("", "ssl", "fp_devices", "l_ja4_labels").rstrip() + "," + _LABEL + "," + _PRINTS + """
SELECT CAST(day AS VARCHAR) AS day, src AS ip, ja4, label AS match, n AS count FROM pr JOIN cls USING (ja4) WHERE is_threat AND source = 'ja4db'""")
query("ja4_threat_alerts", lambda v: _text(P.threat_alerts(P.wan_prints(v.ssl, v.registry), v.listed("ja4_labels")), "day"),
      with_views("", "ssl", "fp_devices", "l_ja4_labels").rstrip() + "," + _LABEL + "," + _PRINTS + """
SELECT DISTINCT CAST(day AS VARCHAR) AS day, 'threat_intel_hit' AS type, 'high' AS severity, src AS device, 'JA4 match: ' || label AS detail
FROM pr JOIN cls USING (ja4) WHERE is_threat AND source = 'ja4db'""")
query("intel_counts",
      lambda v: W.intel_counts({"l2": W.l2_anomalies(v.arp, _FPM(v), L.GATEWAY_IP, L.GATEWAY_MACS), "weird": W.weird(v.weird, v.registry)}),
      with_views("", "arp", "l_rules", "weird").rstrip() + "," + _L2 + """,
  sizes AS (SELECT 'l2' AS panel, (SELECT count(*) FROM l2) AS n
    UNION ALL SELECT 'weird', (SELECT least(30, count(DISTINCT name)) FROM weird WHERE name NOT IN ('-', '')))
SELECT * FROM sizes UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM sizes""")
query("ja4_device_summary",
      lambda v: _text(P.device_summary(P.wan_prints(v.ssl).where(F.col("day") == TODAY), _hist(v), v.listed("ja4_labels"), v.registry, TODAY), "first_seen"),
      with_views("", "ssl", "fp_devices", "l_ja4_labels").rstrip() + "," + _LABEL + "," + _PRINTS + f""",
  nw AS (SELECT src AS ip, ja4, count(*) AS n_now FROM ssl WHERE {lan('src')} AND NOT {lan('dst')} AND day = DATE '{TODAY}' GROUP BY ALL),
  b AS (SELECT ip, ja4, first_seen, coalesce(cnt, 0) + coalesce(n_now, 0) AS n, n_now, is_threat AND source = 'ja4db'
      AND (n_now IS NOT NULL OR last_seen >= DATE '{TODAY}' - 14) AND ip NOT IN (SELECT ip FROM fp_devices) AS thr
    FROM hi FULL JOIN nw USING (ip, ja4) JOIN cls USING (ja4))
SELECT ip, count(*) AS n_total, count(n_now) AS n_today, count(*) FILTER (n_now IS NOT NULL AND coalesce(first_seen >= DATE '{TODAY}', TRUE)) AS n_new_today,
  arg_max(ja4, (n, ja4)) AS modal, max(n) AS modal_count, CAST(min(first_seen) AS VARCHAR) AS first_seen, bool_or(thr) AS any_threat,
  count(*) FILTER (thr) AS n_threat_hashes FROM b GROUP BY ip""")

VIEWS["identity"] = (("ssl", "dns", "http"), f"""
  SELECT dst, arg_min(name, rk) AS name, arg_min(source, rk) AS source, CAST(arg_min(age, rk) AS INTEGER) AS when_days FROM (
    SELECT dst, source, rk, date_diff('day', CAST(max(ts) AS DATE), DATE '{TODAY}') AS age,
      CASE WHEN source = 'cert' THEN trim(regexp_extract(arg_max(name, (ts, name)), '(?:^|,)\\s*CN=([^,]*)', 1)) ELSE arg_max(name, (ts, name)) END AS name
    FROM (SELECT dst, 'SNI' AS source, 1 AS rk, ts, server_name AS name FROM ssl
      UNION ALL SELECT unnest(answers), 'DNS', 2, ts, query FROM dns UNION ALL SELECT dst, 'cert', 3, ts, server_subject FROM ssl
      UNION ALL SELECT dst, 'HTTP', 4, ts, host FROM http) WHERE coalesce(name, '') <> '' GROUP BY dst, source, rk)
  WHERE NOT regexp_matches(name, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') AND name <> dst GROUP BY dst""")
query("identity", lambda v: I.identify(v.ssl, v.dns, v.http, TODAY), with_views("SELECT * FROM identity", "identity"))
_EV = f"""
  ev AS (SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT) AS sec, src, 'ssl' AS kind FROM ssl WHERE contains(lower(server_name), '{L.WATCHED_DOMAIN}')
    UNION SELECT DISTINCT CAST(floor(epoch(ts)) AS BIGINT), src, 'dns' FROM dns WHERE contains(lower(query), '{L.WATCHED_DOMAIN}'))"""
query("domain_minutes", lambda v: I.domain_minutes(v.ssl, v.dns, L.WATCHED_DOMAIN),
      with_views("", "ssl", "dns").rstrip() + "," + _EV + "SELECT sec // 60 * 60 AS minute, src, count(*) AS n FROM ev GROUP BY ALL")
PAIRS_SQL = with_views("", "ssl", "dns").rstrip() + "," + _EV + f""",
  lk AS (SELECT DISTINCT src, CAST(floor(epoch(ts)) AS BIGINT) AS q, query AS host FROM dns WHERE NOT contains(lower(query), '{L.WATCHED_DOMAIN}')),
  h AS (SELECT DISTINCT sec, ev.src, kind, host FROM ev JOIN lk ON lk.src = ev.src AND abs(q - sec) <= 1)
SELECT * FROM (SELECT sec // 60 * 60 AS minute, host, count(*) AS n FROM h GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY minute ORDER BY n DESC, host) <= 8"""
query("domain_pairs", lambda v: I.domain_pairs(v.ssl, v.dns, L.WATCHED_DOMAIN), PAIRS_SQL)
query("domain_addresses", lambda v: I.domain_addresses(v.dns, L.WATCHED_DOMAIN, "2024-01-29 00:00:00"),
      with_views(f"""SELECT DISTINCT ip FROM (SELECT unnest(answers) AS ip FROM dns WHERE contains(lower(query), '{L.WATCHED_DOMAIN}')
  AND ts >= TIMESTAMP '2024-01-29 00:00:00') WHERE regexp_matches(ip, '^[0-9.]+$')""", "dns"))
query("dest_labels", lambda v: I.annotate(v.conn.select("dst").distinct(), "dst", v.geo),
      with_views("", "conn", "l_geo").rstrip() + f""",
  t AS (SELECT dst, list_filter([nullif({geo_of('dst', 'org')}, ''), nullif({geo_of('dst', 'city')}, ''), nullif({geo_of('dst', 'cc')}, '')],
    lambda x: x IS NOT NULL) AS p FROM (SELECT DISTINCT dst FROM conn))
SELECT dst, CASE WHEN len(p) = 0 THEN dst ELSE dst || ' (' || array_to_string(p, ', ') || ')' END AS dest_label FROM t""")
