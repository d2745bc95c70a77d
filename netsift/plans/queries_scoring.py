"""Registered queries: relay detector and beacon scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..operators import relay as Y
from ..operators import scoring as Z
from .oracle_views import lan, view, with_views
from .queries_network import TODAY
from .registry import ORACLE, query

_text = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
_joined = lambda df, *cs: df.withColumns({c: F.array_join(c, ",") for c in cs})

_EXACT = "('" + "', '".join(C.RELAY_SNI_EXACT) + "')"
_SUFFIX = "'(" + "|".join(s.replace(".", "\\.") for s in C.RELAY_SNI_SUFFIXES) + ")$'"
_NET = "regexp_matches(dst, '^52\\.(11[2-5]|12[23])\\.')"
view("rflows", f"""
  SELECT f.day, f.src, f.dst, f.dst_port, f.proto, duration_sec, ip_bytes, CASE WHEN f.proto = 'tcp' THEN coalesce(snis, []) ELSE [] END AS snis,
    CASE WHEN f.proto = 'tcp' THEN coalesce(ja4s, []) ELSE [] END AS ja4s, CASE WHEN t.src IS NOT NULL THEN 'sni' ELSE 'cidr' END AS via
  FROM (SELECT day, src, dst, dst_port, proto, sum(duration) AS duration_sec, CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS ip_bytes FROM conn WHERE src_local GROUP BY ALL) f
  LEFT JOIN (SELECT day, src, dst, dst_port, list_sort(list_filter(list(DISTINCT server_name), lambda x: x IS NOT NULL)) AS snis, list_sort(list(DISTINCT ja4)) AS ja4s
    FROM ssl WHERE {lan('src')} AND (lower(server_name) IN {_EXACT} OR regexp_matches(lower(server_name), {_SUFFIX}) OR {_NET}) GROUP BY ALL) t
    ON t.day = f.day AND t.src = f.src AND t.dst = f.dst AND t.dst_port = f.dst_port
  WHERE (t.src IS NOT NULL OR {_NET.replace('dst', 'f.dst')}) AND f.src NOT IN (SELECT ip FROM fp_devices)""", "conn", "ssl", "fp_devices")
view("rbase", """
  SELECT r.src, coalesce(any_value(l.ja4s), []) AS ja4s, min(r.day) AS first_seen, min(r.day) < DATE '2024-01-11' AS seeded
  FROM rflows r LEFT JOIN (SELECT src, list(DISTINCT j) AS ja4s FROM (SELECT src, unnest(ja4s) AS j FROM rflows WHERE day <= DATE '2024-01-10') GROUP BY src) l ON l.src = r.src
  WHERE r.day <= DATE '2024-01-10' GROUP BY r.src""", "rflows")
_CH = "list_transform(b.ja4s, lambda x: split_part(x, '_', 2))"
view("rsig", f"""
  SELECT *, CASE len(signals) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM (
    SELECT r.*, n.new_ja4s, list_filter([CASE WHEN duration_sec > 500 AND NOT (len(snis) > 0 AND len(list_filter(snis, lambda s: s LIKE '%.trouter.teams.microsoft.com')) = len(snis)) THEN 'long-flow' END,
      CASE WHEN proto = 'udp' AND duration_sec >= 300 AND ip_bytes / greatest(duration_sec, 1) < 30000 / 8 THEN 'low-bw' END,
      CASE WHEN len(n.new_ja4s) > 0 THEN 'new-JA4' END], lambda x: x IS NOT NULL) AS signals
    FROM rflows r JOIN rbase b ON b.src = r.src AND b.seeded,
    LATERAL (SELECT list_filter(r.ja4s, lambda j: NOT list_contains(b.ja4s, j) AND NOT list_contains({_CH}, split_part(j, '_', 2))) AS new_ja4s) n
    WHERE r.day > DATE '2024-01-10') WHERE len(signals) > 0""", "rflows", "rbase")
_flows = lambda v: Y.relay_flows(v.conn, v.ssl, v.registry)
# The baseline is learned on the first ten days and used on the rest. Flows here are shorter than real
# calls, so "long" starts at 500 seconds.
_base = lambda v: Y.update_baseline(_flows(v).where("day <= '2024-01-10'"), Y.update_baseline(_flows(v).where("day <= '2024-01-10'"), None, "2024-01-10"), "2024-01-11")
_sig = lambda v: Y.signals(_flows(v).where("day > '2024-01-10'"), _base(v), max_hours=500 / 3600)
query("relay_flows", lambda v: _joined(_text(_flows(v).withColumn("duration_sec", F.round("duration_sec", 4)), "day"), "snis", "ja4s"),
      with_views("""SELECT * REPLACE (CAST(day AS VARCHAR) AS day, round(duration_sec, 4) AS duration_sec, array_to_string(snis, ',') AS snis,
  array_to_string(ja4s, ',') AS ja4s) FROM rflows""", "rflows"))
query("relay_baseline", lambda v: _joined(Y.update_baseline(_flows(v), None, TODAY), "ja4s").select("src", "ja4s", "seeded"),
      with_views("""SELECT src, coalesce(string_agg(DISTINCT j, ',' ORDER BY j), '') AS ja4s, FALSE AS seeded FROM (
  SELECT src, unnest(CASE WHEN len(ja4s) = 0 THEN [NULL] ELSE ja4s END) AS j FROM rflows) GROUP BY src""", "rflows"))
query("relay_signals", lambda v: _joined(_text(_sig(v), "day"), "signals", "new_ja4s").select("day", "src", "dst", "dst_port", "proto", "signals", "new_ja4s", "severity", "via"),
      with_views("""SELECT CAST(day AS VARCHAR) AS day, src, dst, dst_port, proto, array_to_string(signals, ',') AS signals, array_to_string(new_ja4s, ',') AS new_ja4s, severity, via FROM rsig""", "rsig"))
query("relay_alerts", lambda v: _text(Y.alerts(_sig(v)), "day"),
      with_views("""SELECT CAST(day AS VARCHAR) AS day, 'teams_relay_anomaly' AS type, severity, src AS device, 'Relay anomaly on ' || dst || ':' || dst_port || '/' || proto || ': ' ||
  array_to_string(signals, '+') || ' (via ' || via || ')' AS detail FROM (SELECT * FROM rsig WHERE list_contains(signals, 'new-JA4') AND len(signals) >= 2
  QUALIFY row_number() OVER (PARTITION BY day, src ORDER BY len(signals) DESC, duration_sec DESC, dst, dst_port, proto) <= 5)""", "rsig"))

# -- scoring: a week counts as one "day" here, so that pairs have enough points --------------------
view("wk", "SELECT * REPLACE (CAST(date_trunc('week', day) AS DATE) AS day) FROM conn WHERE src_local AND NOT dst_local", "conn")
_week = lambda df: df.withColumn("day", F.trunc("day", "week"))
_REG = "(({sp}) + ({sk})) / 2"


def _quart(name: str, src: str, value: str) -> str:
    return f"""
  {name}_m AS (SELECT day, src, dst, quantile_cont({value}, 0.5) AS m, quantile_cont({value}, 0.25) AS a, quantile_cont({value}, 0.75) AS b FROM {src} GROUP BY ALL),
  {name}_d AS (SELECT day, src, dst, quantile_cont(abs({value} - m), 0.5) AS d FROM {src} JOIN {name}_m USING (day, src, dst) GROUP BY ALL),
  {name} AS (SELECT day, src, dst, ((1 - CASE WHEN m > 0 THEN least(d / m, 1.0) WHEN d > 0 THEN 1.0 ELSE 0.0 END) +
    (1 - CASE WHEN b <> a THEN abs((a + b - 2 * m) / (b - a)) ELSE 0.0 END)) / 2 AS {name} FROM {name}_m JOIN {name}_d USING (day, src, dst))"""


_SCORE = f"""
  se AS (SELECT day, src, dst, sec, count(*) AS n FROM wk GROUP BY ALL),
  sp AS (SELECT day, src, dst, CAST(sum(n) AS BIGINT) AS conns, (max(sec) - min(sec)) / 3600.0 AS hrs FROM se GROUP BY ALL HAVING count(*) >= 4),
  ga AS (SELECT * FROM (SELECT day, src, dst, CAST(sec - lag(sec) OVER (PARTITION BY day, src, dst ORDER BY sec) AS DOUBLE) AS gap FROM se) WHERE gap IS NOT NULL),
  sz AS (SELECT day, src, dst, CAST(orig_ip_bytes AS DOUBLE) AS sz FROM wk),
  hi AS (SELECT day, src, dst, 1 - least(stddev_pop(n) / avg(n), 1.0) AS histogram FROM (SELECT day, src, dst, sec // 3600 AS h, sum(n) AS n FROM se GROUP BY ALL) GROUP BY ALL),
  {_quart('timing', 'ga', 'gap')}, {_quart('size', 'sz', 'sz')},
  sc AS (SELECT day, src, dst, conns, timing, size, CASE WHEN hrs >= 6 THEN least(hrs / 12.0, 1.0) ELSE 0.0 END AS duration, histogram
    FROM sp JOIN timing USING (day, src, dst) JOIN size USING (day, src, dst) JOIN hi USING (day, src, dst)),
  fs AS (SELECT *, 0.25 * timing + 0.25 * size + 0.25 * duration + 0.25 * histogram AS score FROM sc)"""
_LEVEL = "CASE WHEN round({s} * 100, 6) >= 100 THEN 'high' WHEN round({s} * 100, 6) >= 90 THEN 'medium' WHEN round({s} * 100, 6) >= 70 THEN 'low' WHEN round({s} * 100, 6) >= 50 THEN 'base' ELSE 'none' END"
_r = lambda df, *cs: df.withColumns({c: F.round(c, 6) for c in cs})
query("beacon_score", lambda v: _text(_r(Z.beacon_scores(_week(v.conn)), "timing", "size", "duration", "histogram", "score"), "day"),
      with_views("", "wk").rstrip() + "," + _SCORE + f"""
SELECT CAST(day AS VARCHAR) AS day, src, dst, conns, round(timing, 6) AS timing, round(size, 6) AS size, round(duration, 6) AS duration, round(histogram, 6) AS histogram,
  round(score, 6) AS score, {_LEVEL.format(s='score')} AS severity FROM fs""")
query("long_conn", lambda v: _text(_r(Z.long_connections(_week(v.conn)), "seconds", "longest"), "day"),
      with_views("""SELECT CAST(day AS VARCHAR) AS day, src, dst, round(sum(duration), 6) AS seconds, round(max(duration), 6) AS longest,
  CASE WHEN sum(duration) >= 43200 THEN 'high' WHEN sum(duration) >= 28800 THEN 'medium' WHEN sum(duration) >= 14400 THEN 'low' ELSE 'base' END AS level
FROM wk GROUP BY wk.day, src, dst HAVING sum(duration) >= 3600""", "wk"))
query("strobe", lambda v: _text(Z.strobes(_week(v.conn), 6), "day"),
      with_views("SELECT CAST(day AS VARCHAR) AS day, src, dst, count(*) AS conns FROM wk GROUP BY wk.day, src, dst HAVING count(*) >= 6", "wk"))
query("c2_dns", lambda v: _text(Z.c2_over_dns(_week(v.dns)), "day"),
      with_views("""SELECT CAST(day AS VARCHAR) AS day, domain, subdomains, CASE WHEN subdomains >= 1000 THEN 'high' WHEN subdomains >= 800 THEN 'medium'
  WHEN subdomains >= 500 THEN 'low' WHEN subdomains >= 100 THEN 'base' ELSE 'none' END AS level FROM (
  SELECT CAST(date_trunc('week', day) AS DATE) AS day, regexp_extract(lower(query), '([^.]+\\.(co\\.uk|[^.]+))$', 1) AS domain, count(DISTINCT lower(query)) AS subdomains
  FROM dns WHERE query NOT LIKE '%.in-addr.arpa' GROUP BY 1, 2)""", "dns"))
query("threat_hits", lambda v: _text(Z.threat_hits(_week(v.conn), v.listed("threat_feed")), "day"),
      with_views("""SELECT CAST(day AS VARCHAR) AS day, src, dst, CAST(sum(orig_ip_bytes + resp_ip_bytes) AS BIGINT) AS bytes,
  CASE WHEN sum(orig_ip_bytes + resp_ip_bytes) >= 25000000 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS modifier FROM wk WHERE dst IN (SELECT ip FROM l_threat_feed) GROUP BY wk.day, src, dst""", "wk", "l_threat_feed"))
_PREV = """pv AS (SELECT day, dst, count(DISTINCT src) / any_value(h) AS prevalence FROM wk JOIN (SELECT day, count(DISTINCT src) AS h FROM wk GROUP BY day) USING (day) GROUP BY day, dst),
  pm AS (SELECT *, CASE WHEN prevalence <= 0.02 THEN 0.15::DOUBLE WHEN prevalence >= 0.5 THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END AS modifier FROM pv)"""
query("prevalence", lambda v: _text(_r(Z.prevalence(_week(v.conn)), "prevalence"), "day"),
      with_views("", "wk").rstrip() + "," + _PREV + "SELECT CAST(day AS VARCHAR) AS day, dst, round(prevalence, 6) AS prevalence, modifier FROM pm")
_FIRST = f"""fm AS (SELECT dst, age AS age_days, CASE WHEN age <= 7 THEN 0.15::DOUBLE WHEN age >= 30 THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END AS modifier
    FROM (SELECT dst, CAST(date_diff('day', min(day), DATE '2024-02-02') AS INTEGER) AS age FROM conn WHERE src_local AND NOT dst_local GROUP BY dst))"""
query("first_seen", lambda v: Z.first_seen(v.conn, "2024-02-02"), with_views("", "conn").rstrip() + "," + _FIRST + "SELECT * FROM fm")
_mime = lambda v: v.spark.sql("SELECT * FROM VALUES ('text/html', '.html'), ('text/html', '.htm'), ('text/css', '.css') AS t(mime, ext)")
query("http_modifiers", lambda v: _text(Z.http_modifiers(_week(v.http), _mime(v)), "day"),
      with_views("""SELECT CAST(h.day AS VARCHAR) AS day, src, dst, CAST(sum((host = '')::INT) AS BIGINT) AS no_host, bool_or(coalesce(u.users, 0) = 1) AS rare_agent,
  bool_or(uri LIKE '%.html' AND mime <> 'text/html') AS mime_mismatch,
  CASE WHEN sum((host = '')::INT) > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN bool_or(coalesce(u.users, 0) = 1) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END +
  CASE WHEN bool_or(uri LIKE '%.html' AND mime <> 'text/html') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS modifier
FROM (SELECT * REPLACE (CAST(date_trunc('week', day) AS DATE) AS day) FROM http) h LEFT JOIN (SELECT user_agent, count(DISTINCT src) AS users FROM http WHERE user_agent <> '' GROUP BY 1) u USING (user_agent)
GROUP BY h.day, src, dst""", "http"))
query("rare_signatures", lambda v: _text(Z.rare_signatures(v.ssl), "day"),
      with_views("SELECT DISTINCT CAST(day AS VARCHAR) AS day, src, dst, 0.15::DOUBLE AS modifier FROM ssl WHERE ja4 IN (SELECT ja4 FROM ssl GROUP BY ja4 HAVING count(DISTINCT src) = 1)", "ssl"))
query("direct_to_c2", lambda v: _text(Z.direct_to_c2(_week(v.conn), v.dns, Z.c2_over_dns(_week(v.dns), {"base": 3, "low": 5, "medium": 8, "high": 10}).where("level <> 'none'")), "day"),
      with_views("", "wk", "dns").rstrip() + """,
  dm AS (SELECT *, regexp_extract(lower(query), '([^.]+\\.(co\\.uk|[^.]+))$', 1) AS domain FROM dns),
  su AS (SELECT DISTINCT domain FROM (SELECT CAST(date_trunc('week', day) AS DATE) AS w, domain, count(DISTINCT lower(query)) AS n FROM dm WHERE query NOT LIKE '%.in-addr.arpa' GROUP BY 1, 2) WHERE n >= 3)
SELECT DISTINCT CAST(day AS VARCHAR) AS day, src, dst, 0.15::DOUBLE AS modifier FROM wk WHERE dst IN (SELECT unnest(answers) FROM dm WHERE domain IN (SELECT domain FROM su))""")
query("final_score",
      lambda v: _text(_r(Z.apply_modifiers(Z.beacon_scores(_week(v.conn)), (Z.prevalence(_week(v.conn)), ["day", "dst"]), (Z.first_seen(v.conn, "2024-02-02"), ["dst"]))
                         .select("day", "src", "dst", "score", "final_score", "final_severity"), "score", "final_score"), "day"),
      with_views("", "wk", "conn").rstrip() + "," + _SCORE + "," + _PREV + "," + _FIRST + f""",
  z AS (SELECT fs.*, least(greatest(score + coalesce(pm.modifier, 0) + coalesce(fm.modifier, 0), 0.0), 1.0) AS f FROM fs LEFT JOIN pm ON pm.day = fs.day AND pm.dst = fs.dst LEFT JOIN fm ON fm.dst = fs.dst)
SELECT CAST(day AS VARCHAR) AS day, src, dst, round(score, 6) AS score, round(f, 6) AS final_score, {_LEVEL.format(s='f')} AS final_severity FROM z""")


def _all_modifiers(v):
    """The beacon score with every modifier of its week: prevalence, age, feed, HTTP, TLS fingerprint, straight to C2."""
    conn = _week(v.conn)
    suspects = Z.c2_over_dns(_week(v.dns), {"base": 3, "low": 5, "medium": 8, "high": 10}).where("level <> 'none'")
    return Z.apply_modifiers(
        Z.beacon_scores(conn), (Z.prevalence(conn), ["day", "dst"]), (Z.first_seen(v.conn, "2024-02-02"), ["dst"]),
        (Z.threat_hits(conn, v.listed("threat_feed")), Z.PAIR), (Z.http_modifiers(_week(v.http), _mime(v)), Z.PAIR),
        (Z.rare_signatures(_week(v.ssl)), Z.PAIR), (Z.direct_to_c2(conn, v.dns, suspects), Z.PAIR))


_PARTS = ["threat_hits", "http_modifiers", "rare_weekly", "direct_to_c2"]
_RARE = with_views("""SELECT DISTINCT CAST(date_trunc('week', day) AS DATE)::VARCHAR AS day, src, dst, 0.15::DOUBLE AS modifier
FROM ssl WHERE ja4 IN (SELECT ja4 FROM ssl GROUP BY ja4 HAVING count(DISTINCT src) = 1)""", "ssl")
query("final_score_all", lambda v: _text(_r(_all_modifiers(v).select("day", "src", "dst", "score", "final_score", "final_severity"), "score", "final_score"), "day"),
      with_views("", "wk", "conn").rstrip() + "," + _SCORE + "," + _PREV + "," + _FIRST + ", " + ", ".join(
          f"m{i} AS (SELECT day, src, dst, sum(modifier) AS modifier FROM ({_RARE if n == 'rare_weekly' else ORACLE[n]}) GROUP BY ALL)" for i, n in enumerate(_PARTS)) + f""",
  z AS (SELECT fs.*, least(greatest(score + coalesce(pm.modifier, 0) + coalesce(fm.modifier, 0) + {' + '.join(f'coalesce(m{i}.modifier, 0)' for i in range(4))}, 0.0), 1.0) AS f
    FROM fs LEFT JOIN pm ON pm.day = fs.day AND pm.dst = fs.dst LEFT JOIN fm ON fm.dst = fs.dst
    {' '.join(f'LEFT JOIN m{i} ON m{i}.day = CAST(fs.day AS VARCHAR) AND m{i}.src = fs.src AND m{i}.dst = fs.dst' for i in range(4))})
SELECT CAST(day AS VARCHAR) AS day, src, dst, round(score, 6) AS score, round(f, 6) AS final_score, {_LEVEL.format(s='f')} AS final_severity FROM z""")
