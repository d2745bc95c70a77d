"""Registered queries: low-rate beacons, address joins and suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ip as IP
from ..functions import names as N
from ..operators import cadence as K
from ..operators import ranges as R
from ..operators import suppress as S
from ..sources import windows as W
from .oracle_views import geo_of, glob_hit, service_hit, v4num, with_views
from .registry import query

_PAIR = "src, dst, dst_port"
ALL_DAYS = None  # the detectors below run over every day


def last_days(view: str, n: int | None) -> str:
    return "true" if n is None else f"day IN (SELECT DISTINCT day FROM {view} ORDER BY day DESC LIMIT {n})"


def _pairs_sql(days: int | None) -> str:
    return f"""
  pairs0 AS (SELECT {_PAIR}, count(*) AS total_conns, count(DISTINCT day) AS days_seen FROM egress
    WHERE {last_days('conn', days)} GROUP BY ALL HAVING days_seen >= 5 AND total_conns <= days_seen * 6),
  hrs AS (SELECT {_PAIR}, hour(ts) AS h, count(*) AS n FROM egress JOIN pairs0 USING ({_PAIR})
    WHERE {last_days('conn', days)} GROUP BY ALL),
  modes AS (SELECT {_PAIR}, arg_max(h, n * 100 - h) AS modal_hour FROM hrs GROUP BY ALL),
  pairs AS (SELECT {_PAIR}, any_value(total_conns) AS total_conns, any_value(days_seen) AS days_seen,
      CAST(any_value(modal_hour) AS INTEGER) AS modal_hour,
      sum(CASE WHEN (h - modal_hour + 24) % 24 IN (0, 1, 23) THEN n ELSE 0 END) / any_value(total_conns) AS hour_consistency
    FROM hrs JOIN modes USING ({_PAIR}) JOIN pairs0 USING ({_PAIR}) GROUP BY {_PAIR})"""


def _cv_sql(days: int | None) -> str:
    return f"""
  gaps AS (SELECT {_PAIR}, sec - lag(sec) OVER (PARTITION BY {_PAIR} ORDER BY sec) AS gap
    FROM egress JOIN pairs USING ({_PAIR}) WHERE {last_days('conn', days)}),
  cvs AS (SELECT {_PAIR}, CASE WHEN count(gap) >= 2 AND avg(gap) <> 0 THEN stddev_pop(gap) / avg(gap) END AS interval_cv
    FROM gaps GROUP BY {_PAIR})"""


_SNI_SQL = """
  sni AS (SELECT dst, arg_max(server_name, (ts, server_name)) AS sni FROM ssl WHERE coalesce(server_name, '') <> '' GROUP BY dst)"""
_HTTP_SQL = """
  hx AS (SELECT * FROM http WHERE coalesce(host, '') <> ''),
  uas AS (SELECT dst, arg_max(user_agent, (n, user_agent)) AS ua FROM
    (SELECT dst, user_agent, count(*) AS n FROM hx WHERE user_agent <> '' GROUP BY ALL) GROUP BY dst),
  uris AS (SELECT dst, arg_max(u, (n, u)) AS uri FROM
    (SELECT dst, substring(uri, 1, 60) AS u, count(*) AS n FROM hx GROUP BY ALL) GROUP BY dst),
  prof AS (SELECT dst, arg_max(host, (ts, host)) AS http_host, count(DISTINCT host) AS n_hosts,
      count(*) FILTER (method = 'GET') AS g, count(*) FILTER (method = 'POST') AS p,
      count(*) FILTER (method NOT IN ('GET', 'POST')) AS o, count(*) AS t FROM hx GROUP BY dst),
  web AS (SELECT dst, http_host, n_hosts, substring(coalesce(ua, ''), 1, 120) AS http_useragent, uri AS http_uri_sample,
      array_to_string(list_filter([CASE WHEN g > 0 THEN 'GET ' || (g * 100 // t) || '%' END,
        CASE WHEN p > 0 THEN 'POST ' || (p * 100 // t) || '%' END,
        CASE WHEN o > 0 THEN 'other ' || (o * 100 // t) || '%' END], lambda x: x IS NOT NULL), ' · ') AS http_method_mix
    FROM prof LEFT JOIN uas USING (dst) LEFT JOIN uris USING (dst))"""
_HYPER = "'" + "|".join(t.replace(".", "\\.") for t in __import__("netsift.functions.catalogues", fromlist=["x"]).HYPERSCALER_TOKENS) + "'"


def _candidates_sql(days: int, own_days: bool = True) -> str:
    own = lambda sql, log: sql.replace(f"FROM {log}", f"FROM own_{log}")
    logs = f"""
  own_ssl AS (SELECT * FROM ssl WHERE {last_days('conn', days)}), own_http AS (SELECT * FROM http WHERE {last_days('conn', days)}),
  {own(_SNI_SQL, 'ssl')},{own(_HTTP_SQL, 'http')}""" if own_days else f"{_SNI_SQL},{_HTTP_SQL}"
    return f"""{_pairs_sql(days)},{_cv_sql(days)},{logs},
  talk AS (SELECT dst, dst_port, count(DISTINCT src) AS lan_talkers FROM egress WHERE {last_days('conn', days)} GROUP BY ALL),
  badhost AS (SELECT DISTINCT dst FROM hx WHERE {glob_hit('host', 'domains')}),
  cand0 AS (SELECT p.*, s.sni, w.http_host, w.http_useragent, w.http_uri_sample, w.http_method_mix, t.lan_talkers,
      {geo_of('p.dst', 'org')} AS org, {geo_of('p.dst', 'cc')} AS cc
    FROM pairs p LEFT JOIN sni s ON p.dst = s.dst LEFT JOIN web w ON p.dst = w.dst
    LEFT JOIN talk t ON p.dst = t.dst AND p.dst_port = t.dst_port
    WHERE p.hour_consistency >= 0.8 AND p.dst NOT IN (SELECT dst FROM badhost) AND p.src NOT IN (SELECT ip FROM fp_devices)),
  cand AS (SELECT {_PAIR}, coalesce(sni, '') AS sni, coalesce(http_host, '') AS http_host,
      coalesce(http_useragent, '') AS http_useragent, coalesce(http_uri_sample, '') AS http_uri_sample,
      coalesce(http_method_mix, '') AS http_method_mix, days_seen, total_conns,
      total_conns / days_seen AS conns_per_active_day, modal_hour, hour_consistency, interval_cv,
      coalesce(org, '') AS dst_org, coalesce(cc, '') AS dst_cc,
      regexp_matches(lower(coalesce(org, '')), {_HYPER}) AS is_hyperscaler, coalesce(lan_talkers, 1) AS lan_talkers,
      coalesce(lan_talkers, 1) = 1 AND NOT regexp_matches(lower(coalesce(org, '')), {_HYPER}) AS alert_eligible
    FROM cand0 LEFT JOIN cvs USING ({_PAIR})
    WHERE NOT {glob_hit('sni', 'domains')} AND NOT {glob_hit('dst', 'domains')} AND NOT {glob_hit("nullif(org, '')", 'orgs')})"""


_CAND_VIEWS = ("egress", "ssl", "http", "fp_devices", "l_geo", "l_rules")


def _cand(v, days, own_days=True):
    return K.slow_candidates(v.conn, v.ssl, v.http, v.geo, v.registry, days, own_days=own_days)


def _show(df):
    return (
        df.withColumn("conns_per_active_day", F.round("conns_per_active_day", 6))
        .withColumn("hour_consistency", F.round("hour_consistency", 6))
        .withColumn("interval_cv", F.round("interval_cv", 6))
    )


_SHOW = """* REPLACE (round(conns_per_active_day, 6) AS conns_per_active_day,
  round(hour_consistency, 6) AS hour_consistency, round(interval_cv, 6) AS interval_cv)"""


def _after(ctes: str, select: str, *views: str) -> str:
    """Views, then the query's own steps, then the final select."""
    return with_views("", *views).rstrip() + "," + ctes + "\n" + select


for _name, _days in (("slow_pairs", ALL_DAYS), ("slow_pairs_last14", 14)):
    query(
        _name,
        lambda v, d=_days: K.slow_pairs(v.conn, d).withColumn("hour_consistency", F.round("hour_consistency", 6)),
        _after(_pairs_sql(_days), "SELECT * REPLACE (round(hour_consistency, 6) AS hour_consistency) FROM pairs", "egress"),
    )
query(
    "interval_cv",
    lambda v: K.interval_cv(v.conn, K.slow_pairs(v.conn, ALL_DAYS), ALL_DAYS).withColumn("interval_cv", F.round("interval_cv", 6)),
    _after(_pairs_sql(ALL_DAYS) + "," + _cv_sql(ALL_DAYS), f"SELECT {_PAIR}, round(interval_cv, 6) AS interval_cv FROM cvs", "egress"),
)
query("latest_sni", lambda v: K.latest_sni(v.ssl), _after(_SNI_SQL, "SELECT * FROM sni", "ssl"))
query("http_profile", lambda v: K.http_profile(v.http), _after(_HTTP_SQL, "SELECT * FROM web", "http"))
query(
    "lan_talkers", lambda v: K.lan_talkers(v.conn, ALL_DAYS),
    with_views("SELECT dst, dst_port, count(DISTINCT src) AS lan_talkers FROM egress GROUP BY ALL", "egress"),
)
for _name, _days in (("slow_candidates", ALL_DAYS), ("slow_candidates_last14", 14)):
    query(
        # names and web profiles are read from the whole logs, whatever the window of the flows
        _name, lambda v, d=_days: _show(_cand(v, d, own_days=d is None)),
        _after(_candidates_sql(_days, own_days=_days is None), f"SELECT {_SHOW} FROM cand", *_CAND_VIEWS),
    )
query(
    "new_pairs",
    # state of an earlier run: the pairs of the last 14 days
    lambda v: K.new_pairs(_cand(v, ALL_DAYS), K.remember_pairs(_cand(v, 14), None)).select("pair", "verdict"),
    _after(
        _candidates_sql(ALL_DAYS) + f", known AS (SELECT * FROM ({_after(_candidates_sql(14), 'SELECT src || chr(124) || dst || chr(124) || dst_port AS pair FROM cand', *_CAND_VIEWS)}))",
        """SELECT src || '|' || dst || '|' || dst_port AS pair,
  CASE WHEN alert_eligible THEN 'fire' WHEN is_hyperscaler THEN 'hyperscaler' ELSE 'shared_lan' END AS verdict
FROM cand WHERE src || '|' || dst || '|' || dst_port NOT IN (SELECT pair FROM known)""", *_CAND_VIEWS),
)
query(
    "pair_alerts", lambda v: K.pair_alerts(K.new_pairs(_cand(v, ALL_DAYS), v.spark.createDataFrame([], "pair string"))),
    _after(_candidates_sql(ALL_DAYS), """SELECT 'slow_cadence_beacon' AS type, 'medium' AS severity, src AS device,
  substring('Slow-cadence beacon: ' || coalesce(nullif(sni, ''), nullif(http_host, ''), dst) || ':' || dst_port || ', ' || days_seen ||
   ' days, ~' || round(total_conns / days_seen, 2) || '/day at ' || lpad(CAST(modal_hour AS VARCHAR), 2, '0') || ':00 UTC (hour-cons ' ||
   CAST(floor(round(hour_consistency, 3) * 100) AS INTEGER) || '%) — sole LAN talker, ASN: ' || coalesce(nullif(dst_org, ''), 'unknown ASN'), 1, 240) AS detail
FROM cand WHERE alert_eligible""", *_CAND_VIEWS),
)
query(
    "slow_source_rows", lambda v: _show(K.source_rows(_cand(v, ALL_DAYS))),
    _after(_candidates_sql(ALL_DAYS), f"SELECT {_SHOW} FROM cand", *_CAND_VIEWS),
)
query(
    "slow_source_groups", lambda v: K.source_groups(_cand(v, ALL_DAYS)),
    _after(_candidates_sql(ALL_DAYS), """SELECT src, count(*) AS n_candidates, count(DISTINCT dst) AS n_dsts,
  count(*) FILTER (alert_eligible) AS n_eligible FROM cand GROUP BY src""", *_CAND_VIEWS),
)
query(
    "slow_digest", lambda v: K.hunt_digest(_cand(v, ALL_DAYS)).select(*K.PAIR, "days_seen"),
    _after(_candidates_sql(ALL_DAYS), f"""SELECT {_PAIR}, days_seen FROM cand WHERE NOT alert_eligible
ORDER BY days_seen DESC, hour_consistency DESC, src, dst, dst_port LIMIT 10""", *_CAND_VIEWS),
)
query(
    "slow_tile", lambda v: K.tile(_cand(v, ALL_DAYS)),
    _after(_candidates_sql(ALL_DAYS), "SELECT count(*) AS total, count(*) FILTER (alert_eligible) AS eligible FROM cand", *_CAND_VIEWS),
)
query(
    "window_existing", lambda v: W.last_existing_days(v.findings, 14).withColumn("day", F.col("day").cast("string")),
    with_views("""SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS day_no, CAST(day AS VARCHAR) AS day
FROM (SELECT DISTINCT day FROM findings ORDER BY day DESC LIMIT 14)""", "findings"),
)
query(
    "window_calendar",
    lambda v: W.in_calendar_window(v.conn, 7, "2024-01-30").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n")),
    with_views("""SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM conn
WHERE day > DATE '2024-01-30' - 7 AND day <= DATE '2024-01-30' GROUP BY 1""", "conn"),
)
query(
    "geo_join",
    lambda v: R.with_ranges(v.conn.select("event_id", "dst"), "dst", v.geo, ["cc", "city", "org"]),
    with_views(f"""SELECT event_id, dst, {geo_of('dst', 'cc')} AS cc, {geo_of('dst', 'city')} AS city, {geo_of('dst', 'org')} AS org
FROM conn""", "conn", "l_geo"),
)
_BLOCK = f"""blk AS (SELECT ord, sbl, lo, lo + pow(2, 32 - plen)::BIGINT - 1 AS hi FROM (
    SELECT ord, sbl, plen, ({v4num('net')} // pow(2, 32 - plen)::BIGINT) * pow(2, 32 - plen)::BIGINT AS lo FROM (
      SELECT ord, sbl, split_part(cidr, '/', 1) AS net, CAST(split_part(cidr, '/', 2) AS INTEGER) AS plen FROM l_blocklist
      WHERE regexp_matches(cidr, '^[0-9.]+/[0-9]+$'))))"""
query(
    "cidr_join",
    lambda v: R.with_ranges(v.conn.select("event_id", "dst"), "dst", v.blocklist, ["sbl"], "first"),
    with_views("", "conn", "l_blocklist").rstrip() + "," + _BLOCK + f"""
SELECT event_id, dst, (SELECT sbl FROM blk WHERE {v4num('dst')} BETWEEN lo AND hi ORDER BY ord LIMIT 1) AS sbl FROM conn""",
)
query(
    "glob_suppress",
    lambda v: S.keep_unsuppressed(v.dns, v.registry, domains=["query"]).select("event_id", "query"),
    with_views(f"SELECT event_id, query FROM dns WHERE NOT {glob_hit('query', 'domains')}", "dns", "l_rules"),
)
query(
    "service_suppress",
    lambda v: S.keep_unsuppressed(v.findings, v.registry, service="service").select("finding_id", "line_no", "service"),
    with_views(f"SELECT finding_id, line_no, service FROM findings WHERE NOT {service_hit('service')}", "findings", "l_rules"),
)
query(
    "device_ips", lambda v: v.registry.devices, with_views("SELECT ip, reason FROM fp_devices", "fp_devices"),
)
query(
    "ip_expressions",
    lambda v: v.conn.select("dst").distinct().select(
        "dst", IP.ip_num("dst").alias("num"), IP.is_public_v4("dst").alias("public"), IP.is_lan("dst").alias("lan"),
        IP.is_exit_net("dst").alias("exit_net"), F.coalesce(IP.vendor_net("dst"), F.lit("")).alias("vendor"),
    ),
    with_views(f"""SELECT DISTINCT dst, {v4num('dst')} AS num,
  NOT regexp_matches(dst, '^(0|10|127|22[4-9]|2[3-5][0-9])\\.|^(169\\.254|192\\.168|192\\.0\\.[02]|198\\.1[89]|198\\.51\\.100|203\\.0\\.113|172\\.(1[6-9]|2[0-9]|3[01]))\\.') AS public,
  regexp_matches(dst, '^10\\.') AS lan, regexp_matches(dst, '^185\\.220\\.101\\.') AS exit_net,
  CASE WHEN dst LIKE '17.%' THEN 'Apple' WHEN dst LIKE '52.%' THEN 'AWS/Microsoft' ELSE '' END AS vendor FROM conn""", "conn"),
)
_LABELS = "string_split(rtrim(lower(query), '.'), '.')"
query(
    "name_expressions",
    lambda v: v.dns.select("query").distinct().select(
        "query", F.round(N.sld_entropy("query"), 6).alias("entropy"), N.registrable_pattern("query").alias("pattern"),
        N.is_lookup_noise("query").alias("noise"), N.is_safe_name("query").alias("safe"),
    ),
    with_views(f"""SELECT query, CASE WHEN len(sld) >= 8 THEN round(list_sum(list_transform(list_distinct(string_split(sld, '')),
    lambda c: -(len(list_filter(string_split(sld, ''), lambda x: x = c)) / len(sld)) * log2(len(list_filter(string_split(sld, ''), lambda x: x = c)) / len(sld)))), 6) ELSE 0.0 END AS entropy,
  CASE WHEN query LIKE '%.co.uk' THEN '*.' || array_to_string(labels[-3:], '.') ELSE '*.' || array_to_string(labels[-2:], '.') END AS pattern,
  query LIKE '%.in-addr.arpa' AS noise, FALSE AS safe
FROM (SELECT DISTINCT query, {_LABELS} AS labels, {_LABELS}[-2] AS sld FROM dns)""", "dns"),
)
