"""Registered queries: findings, summary, gate and alert repetition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..operators import cadence as K
from ..operators import findings as D
from ..operators import gate as G
from ..operators import identity as I
from ..operators import fingerprints as P
from ..operators import folds as Q
from .oracle_views import geo_of, glob_hit, service_hit, view, with_views
from .queries_network import _LABEL, TODAY
from .registry import query


def _sql_rx(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _suffix_rx(names) -> str:
    return _sql_rx(r"(^|\.)(" + "|".join(n.replace(".", r"\.") for n in names) + ")$")


def first_label_sql(value: str, catalogue) -> str:
    cases = " ".join(f"WHEN regexp_matches({value}, {_sql_rx(rx)}, 'i') THEN '{label}'" for rx, label in catalogue)
    return f"(CASE {cases} END)"


SAFE = "('" + "', '".join(C.SAFE_ORGS) + "')"
_V4 = "'^([0-9]{1,3}\\.){3}[0-9]{1,3}$'"
_DEST = "CASE WHEN fqdn <> '' THEN fqdn ELSE dst END"
_HOURS = """CASE WHEN first_seen LIKE '%hours ago' THEN CAST(regexp_extract(first_seen, '^[0-9]+') AS DOUBLE)
  ELSE CAST(regexp_extract(first_seen, '^[0-9]+') AS DOUBLE) / 60 END"""
_VENDOR_NETS = {c.split(".")[0]: label for c, label in C.VENDOR_NETS}
_IS_VENDOR_NET = "regexp_matches(dst, '^(" + "|".join(_VENDOR_NETS) + ")\\.')"
_EXIT = "regexp_matches(dst, '^(162\\.247\\.241|162\\.247\\.72|199\\.87\\.154|176\\.10\\.104|185\\.220\\.101)\\.')"


def annotated(value: str) -> str:
    return f"""CASE WHEN regexp_matches({value}, {_V4}) AND coalesce(org, '') || coalesce(city, '') || coalesce(cc, '') <> '' THEN {value} || ' (' ||
      array_to_string(list_filter([nullif(org, ''), nullif(city, ''), nullif(cc, '')], lambda x: x IS NOT NULL), ', ') || ')' ELSE {value} END"""


view("fgeo", f"""SELECT dst, {geo_of('dst', 'org')} AS org, {geo_of('dst', 'city')} AS city, {geo_of('dst', 'cc')} AS cc
  FROM (SELECT DISTINCT dst FROM findings WHERE dst <> '::')""", "findings", "l_geo")
view("dedup", """
  SELECT f.* EXCLUDE (rn), is_recent FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, fqdn ORDER BY score DESC, day DESC, finding_id DESC, line_no DESC, severity DESC, strobe DESC,
      threat_intel DESC, conns DESC, total_bytes DESC, service DESC, first_seen DESC) AS rn FROM findings) f
  JOIN (SELECT src, dst, fqdn, bool_or(day IN (SELECT DISTINCT day FROM findings ORDER BY day DESC LIMIT 3)) AS is_recent FROM findings GROUP BY ALL) USING (src, dst, fqdn)
  WHERE rn = 1""", "findings")


def rule_sql(kind: str, cond: str) -> str:
    return f"(SELECT min(r.ord) FROM l_rules r WHERE r.kind = '{kind}' AND ({cond}))"


def glob_cond(value: str) -> str:
    return f"({value} IS NOT NULL AND {value} <> '' AND ({value} GLOB r.pattern OR (r.pattern LIKE '*.%' AND {value} = substring(r.pattern, 3))))"


view("page", f"""
  SELECT *, CASE WHEN dev IS NOT NULL THEN 'device' WHEN dom IS NOT NULL THEN 'domain' WHEN pro IS NOT NULL THEN 'protocol' END AS rule_type,
    CASE WHEN dev IS NOT NULL THEN src WHEN dom IS NOT NULL THEN (SELECT pattern FROM l_rules WHERE kind = 'domains' AND ord = dom)
      WHEN pro IS NOT NULL THEN (SELECT pattern FROM l_rules WHERE kind = 'protocols' AND ord = pro) END AS rule,
    CASE WHEN dev IS NOT NULL THEN dev WHEN dom IS NOT NULL THEN (SELECT reason FROM l_rules WHERE kind = 'domains' AND ord = dom)
      WHEN pro IS NOT NULL THEN (SELECT reason FROM l_rules WHERE kind = 'protocols' AND ord = pro) END AS reason
  FROM (SELECT d.*, org, city, cc, {annotated(_DEST)} AS dest, fp.reason AS dev,
      (SELECT min(o) FROM (SELECT {rule_sql('domains', glob_cond('d.fqdn'))} AS o UNION ALL SELECT {rule_sql('domains', glob_cond('d.dst'))}
        UNION ALL SELECT {rule_sql('domains', glob_cond("CASE WHEN d.fqdn = '' THEN i.name END"))})) AS dom,
      (SELECT arg_min(r.ord, (u.p, r.ord)) FROM l_rules r, generate_series(1, 9) AS u(p)
        WHERE r.kind = 'protocols' AND (trim(string_split(d.service, ',')[u.p]) = r.pattern OR starts_with(trim(string_split(d.service, ',')[u.p]), r.pattern || ':'))) AS pro
    FROM dedup d LEFT JOIN fgeo USING (dst) LEFT JOIN identity i ON i.dst = d.dst LEFT JOIN fp_devices fp ON fp.ip = d.src
    WHERE d.src <> '::' AND NOT regexp_matches(lower(d.fqdn), {_suffix_rx(C.SAFE_SUFFIXES)}) AND coalesce(org, '') NOT IN {SAFE})""",
     "dedup", "fgeo", "identity", "fp_devices", "l_rules")
view("live", "SELECT * FROM page WHERE rule_type IS NULL AND score <> 0", "page")

_ident = lambda v: I.identify(v.ssl, v.dns, v.http, TODAY)
_page = lambda v: D.page_rows(v.findings, v.geo, _ident(v), v.registry)
_live = lambda v: D.kept(_page(v))
_COLS = ["src", "dst", "fqdn", "score", "severity", "conns", "total_bytes", "service", "first_seen", "is_recent"]
_c = ", ".join(_COLS)

query("finding_dedup", lambda v: D.dedup(v.findings).select(*_COLS, F.col("day").cast("string").alias("day")),
      with_views(f"SELECT {_c}, CAST(day AS VARCHAR) AS day FROM dedup", "dedup"))
query("finding_page", lambda v: _page(v).select(
        *_COLS, "dest", F.coalesce("suppressed_by.rule_type", F.lit("")).alias("rule_type"),
        F.coalesce("suppressed_by.rule", F.lit("")).alias("rule"), F.coalesce("suppressed_by.reason", F.lit("")).alias("reason")),
      with_views(f"SELECT {_c}, dest, coalesce(rule_type, '') AS rule_type, coalesce(rule, '') AS rule, coalesce(reason, '') AS reason FROM page", "page"))
query("severity_counts", lambda v: D.severity_counts(_live(v)), with_views("SELECT severity, count(*) AS n FROM live GROUP BY 1", "live"))
query("suppressed_groups", lambda v: D.suppressed_groups(_page(v)),
      with_views("""SELECT rule_type, rule, count(*) AS n_rows, max(reason) AS reason, max(score) AS max_score FROM page
WHERE rule_type IS NOT NULL GROUP BY 1, 2""", "page"))
query("hotlist", lambda v: D.hotlist(_live(v)),
      with_views("", "live").rstrip() + """,
  pd AS (SELECT src, dest, max(score) AS s FROM live GROUP BY ALL),
  tp AS (SELECT src, string_agg(dest, ', ' ORDER BY s DESC, dest) AS top_dests FROM
    (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dest) <= 3) GROUP BY src)
SELECT src, count(*) FILTER (severity IN ('Critical', 'High')) AS high, count(*) FILTER (severity = 'Medium') AS med,
  count(*) FILTER (severity = 'Low') AS low, count(*) AS total, max(score) AS max_score, any_value(top_dests) AS top_dests
FROM live JOIN tp USING (src) GROUP BY src""")
query("device_beacons", lambda v: D.device_beacons(_live(v)),
      with_views("""SELECT src, bucket, dst, fqdn, score, conns, service, severity
FROM (SELECT *, CASE WHEN severity IN ('Critical', 'High') THEN 'high' WHEN severity = 'Medium' THEN 'med' WHEN severity = 'Low' THEN 'low' ELSE 'other' END AS bucket FROM live)""", "live"))
query("top_beacons", lambda v: D.top_beacons(_live(v)),
      with_views(f"""SELECT src, dest_key, score, dst, conns, service, severity FROM (SELECT *, {_DEST} AS dest_key FROM live WHERE score >= 0.8 AND is_recent)
QUALIFY row_number() OVER (PARTITION BY src, dest_key ORDER BY score DESC, day DESC, dst DESC, conns DESC, service DESC, severity DESC) = 1""", "live"))


def flag_sql(benign_names: bool) -> str:
    unnamed = f"score >= 0.97 AND fqdn = '' AND NOT {_IS_VENDOR_NET}"
    if benign_names:
        unnamed += f" AND {first_label_sql('dst', C.BENIGN_VENDORS)} IS NULL"
    vendor = first_label_sql(_DEST, C.TELEMETRY_VENDORS)
    return f"""SELECT *, CASE flag
    WHEN 'tor' THEN printf('Tor Project IP (%d conns, %.1f MB)', conns, total_bytes / 1e6) WHEN 'vendor-telemetry' THEN {vendor}
    WHEN 'icmp' THEN CASE WHEN hrs > 0 AND conns > 0 THEN printf('ICMP beacon: %d pings, ~1 every %.1f min', conns, hrs * 60 / conns) ELSE 'ICMP beacon: ' || conns || ' pings' END
    WHEN 'dns' THEN CASE WHEN hrs > 0 THEN 'Excessive DNS: ' || conns || ' queries, ~' || printf('%.0f', conns / hrs) || '/hr → ' || dest ELSE 'Excessive DNS: ' || conns || ' queries → ' || dest END
    ELSE printf('Score %.3f beacon to unnamed IP (no FQDN)', score) END AS msg
  FROM (SELECT *, {_HOURS} AS hrs, CASE WHEN {_EXIT} THEN 'tor' WHEN {vendor} IS NOT NULL THEN 'vendor-telemetry'
      WHEN service LIKE '%icmp%' AND score >= 0.9 THEN 'icmp' WHEN service LIKE '%53:udp:dns%' AND conns >= 200 AND score >= 0.9 THEN 'dns'
      WHEN {unnamed} THEN 'unknown' END AS flag FROM SOURCE) WHERE flag IS NOT NULL"""


view("flagged", flag_sql(False).replace("SOURCE", "live"), "live")
query("finding_flags", lambda v: D.flagged(_live(v)).select("src", "dst", "fqdn", "flag", "msg"),
      with_views("SELECT src, dst, fqdn, flag, msg FROM flagged", "flagged"))
_INV = """
  ds AS (SELECT src, flag, dest, max(score) AS s, sum(conns) AS c FROM flagged GROUP BY ALL),
  ms AS (SELECT src, flag, count(DISTINCT msg) AS n, arg_max(msg, (score, msg)) AS m, string_agg(DISTINCT msg, ' + ' ORDER BY msg) AS vs FROM flagged GROUP BY ALL),
  dd AS (SELECT src, flag, count(*) AS n_dests, CAST(sum(c) AS BIGINT) AS conns, max(s) AS score, list(dest ORDER BY s DESC, dest) AS l FROM ds GROUP BY ALL)
SELECT src, flag, score, n_dests, CASE WHEN n_dests <= 3 THEN array_to_string(l, ', ') ELSE l[1] || ', ' || l[2] || ', +' || (n_dests - 2) || ' more' END AS dests,
  CASE WHEN flag = 'vendor-telemetry' THEN vs || ' telemetry (' || conns || ' conns)' WHEN flag = 'dns' AND n > 1 THEN 'Excessive DNS: ' || conns || ' total queries' ELSE m END AS flag_str
FROM dd JOIN ms USING (src, flag)"""
query("investigate", lambda v: D.investigate(D.flagged(_live(v))), with_views("", "flagged").rstrip() + "," + _INV)
# The flows of the TLS view go to other addresses than the findings: findings' own connections of the last four days beside it.
_CLIENTS = ["t13d1516h2_badc0ffee_e1", "t13d1517h1_cccc3333_e1", "q13d0312h3_bbbb2222_e4", "t12d190800_dddd1111_e0", "t13d1516h2_aaaa0000_e0"]


def _finding_tls(v):
    day = F.date_sub(F.lit(TODAY).cast("date"), (F.col("finding_id") % 4).cast("int"))
    client = F.get(F.array(*[F.lit(c) for c in _CLIENTS]), ((F.col("finding_id") + F.col("line_no")) % len(_CLIENTS)).cast("int"))
    own = v.findings.select("src", "dst", day.alias("day"), client.alias("ja4"))
    return v.ssl.select("src", "dst", "day", "ja4").unionByName(own)


query("investigate_details", lambda v: D.investigate_details(D.flagged(_live(v)), _finding_tls(v), v.listed("ja4_labels"), _ident(v), TODAY),
      with_views("", "flagged", "findings", "ssl", "l_ja4_labels", "identity").rstrip() + f""",
  tls AS (SELECT src, dst, day, ja4 FROM ssl UNION ALL SELECT src, dst, CAST(DATE '{TODAY}' - CAST(finding_id % 4 AS INTEGER) AS DATE),
    {_CLIENTS}[(finding_id + line_no) % {len(_CLIENTS)} + 1] FROM findings),""" + _LABEL.replace("FROM ssl) d", "FROM tls) d") + f""",
  ds AS (SELECT src, flag, dest, max(score) AS s, max(CASE WHEN fqdn = '' THEN dst END) AS address FROM flagged GROUP BY ALL),
  nd AS (SELECT src, flag, count(*) AS n_dests FROM ds GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY src, flag ORDER BY s DESC, dest) AS place FROM ds),
  rec AS (SELECT rk.src, rk.flag, string_agg(address || ': ' || i.name || ' (' || i.source || ')', '; ' ORDER BY place) AS recovered
    FROM rk JOIN nd USING (src, flag) JOIN identity i ON i.dst = address WHERE place <= 2 OR (place = 3 AND n_dests = 3) GROUP BY ALL),
  jc AS (SELECT f.src, flag, ja4, count(*) AS n FROM (SELECT DISTINCT src, flag, dst FROM flagged) f JOIN tls ON tls.src = f.src AND tls.dst = f.dst
    WHERE tls.day > DATE '{TODAY}' - 2 AND tls.day <= DATE '{TODAY}' GROUP BY ALL),
  jm AS (SELECT src, flag, arg_max(ja4, (n, ja4)) AS ja4, max(n) AS ja4_count FROM jc GROUP BY src, flag)
SELECT nd.src, nd.flag, jm.ja4, ja4_count, cls.label AS ja4_label, cls.source AS ja4_source, cls.is_threat AS ja4_threat, coalesce(recovered, '') AS recovered
FROM nd LEFT JOIN jm ON jm.src = nd.src AND jm.flag = nd.flag LEFT JOIN cls ON cls.ja4 = jm.ja4 LEFT JOIN rec ON rec.src = nd.src AND rec.flag = nd.flag""")
query("modal_ja4", lambda v: P.modal_print(v.ssl, v.conn.select("src", F.col("service").alias("flag"), "dst")),
      with_views("", "conn", "ssl").rstrip() + """,
  n AS (SELECT p.src, p.flag, ja4, count(*) AS n FROM (SELECT DISTINCT src, service AS flag, dst FROM conn) p JOIN ssl ON ssl.src = p.src AND ssl.dst = p.dst GROUP BY ALL)
SELECT src, flag, arg_max(ja4, (n, ja4)) AS ja4, max(n) AS ja4_count FROM n GROUP BY src, flag""")
query("beaconing_devices", lambda v: D.beaconing_devices(_live(v)), with_views("SELECT count(DISTINCT src) AS devices FROM live", "live"))
_LISTED = f"""src <> '::' AND NOT regexp_matches(lower(fqdn), {_suffix_rx(C.SAFE_SUFFIXES)}) AND coalesce(org, '') NOT IN {SAFE}"""
query("persistence", lambda v: D.persistence(v.findings, v.geo, v.registry).withColumn("latest", F.col("latest").cast("string")),
      with_views("", "findings", "fgeo", "fp_devices", "l_rules").rstrip() + f""",
  p AS (SELECT src, {_DEST} AS dest_key, count(DISTINCT day) AS days, max(day) AS latest, max(score) AS score, arg_max(dst, (day, dst)) AS dst
    FROM findings LEFT JOIN fgeo USING (dst) WHERE day IN (SELECT DISTINCT day FROM findings ORDER BY day DESC LIMIT 14) AND {_LISTED} GROUP BY 1, 2 HAVING count(DISTINCT day) >= 3)
SELECT src, dest_key, days, CAST(latest AS VARCHAR) AS latest, score, dst FROM p WHERE src NOT IN (SELECT ip FROM fp_devices) AND NOT {glob_hit('dest_key', 'domains')}
ORDER BY days DESC, score DESC, src, dest_key LIMIT 30""")
query("new_beacons", lambda v: D.new_beacons(v.findings, v.geo, _ident(v), v.registry),
      with_views("", "findings", "fgeo", "fp_devices", "l_rules", "identity").rstrip() + f""",
  dy AS (SELECT DISTINCT day FROM findings ORDER BY day DESC LIMIT 8),
  nw AS (SELECT *, {_DEST} AS dest_key FROM findings LEFT JOIN fgeo USING (dst) WHERE day = (SELECT max(day) FROM dy) AND {_LISTED}),
  b AS (SELECT * FROM nw QUALIFY row_number() OVER (PARTITION BY src, dest_key ORDER BY score DESC, finding_id DESC, line_no DESC, dst DESC, fqdn DESC, service DESC, severity DESC, first_seen DESC) = 1),
  k AS (SELECT b.*, CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS rk
    FROM b LEFT JOIN identity i ON i.dst = b.dst WHERE b.src NOT IN (SELECT ip FROM fp_devices) AND NOT {service_hit('b.service')}
    AND NOT {glob_hit('b.fqdn', 'domains')} AND NOT {glob_hit('b.dst', 'domains')} AND NOT {glob_hit("(CASE WHEN b.fqdn = '' THEN i.name END)", 'domains')}
    AND NOT EXISTS (SELECT 1 FROM findings h WHERE h.src = b.src AND CASE WHEN h.fqdn <> '' THEN h.fqdn ELSE h.dst END = b.dest_key
      AND h.day IN (SELECT day FROM dy) AND h.day < (SELECT max(day) FROM dy))),
  o AS (SELECT *, max((rk, score)) OVER (PARTITION BY src) AS g FROM k),
  t AS (SELECT * FROM o ORDER BY g DESC, src, rk DESC, score DESC, dest_key LIMIT 30),
  z AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rk DESC, score DESC, dest_key) AS pl, count(*) OVER (PARTITION BY src) AS gn FROM t)
SELECT src, dest_key, dst, score, service, severity, first_seen, pl = 1 AS group_first, CASE WHEN pl = 1 THEN gn ELSE 0 END AS group_size FROM z""")

view("summ", f"""
  SELECT *, safe_name AS user_safe, safe_name OR {_IS_VENDOR_NET} AS benign FROM (
    SELECT *, {first_label_sql('dest', C.BENIGN_VENDORS)} IS NOT NULL OR coalesce(org, '') IN {SAFE} AS safe_name FROM (
      SELECT f.*, org, city, cc, {annotated(_DEST)} AS dest FROM findings f LEFT JOIN fgeo USING (dst)
      WHERE src <> '::' AND src NOT IN (SELECT ip FROM fp_devices) AND NOT {service_hit('service')} AND NOT {glob_hit('(' + _DEST + ')', 'domains')}))""",
     "findings", "fgeo", "fp_devices", "l_rules")
_summ = lambda v: D.summary_rows(v.findings, v.geo, v.registry)
query("summary_severity", lambda v: D.summary_severity(_summ(v)), with_views("SELECT severity, count(*) AS n FROM summ WHERE NOT benign GROUP BY 1", "summ"))
query("summary_hotlist", lambda v: D.summary_hotlist(_summ(v)),
      with_views("""SELECT src, count(*) FILTER (severity IN ('Critical', 'High')) AS high, count(*) FILTER (severity = 'Medium') AS med, count(*) AS total,
  max(score) AS max_score, arg_max(dest, (score, dest)) AS top_dest FROM summ WHERE NOT benign GROUP BY src""", "summ"))
query("summary_top", lambda v: D.summary_top(_summ(v)).select("finding_id", "line_no", "src", "dest", "score"),
      with_views("""SELECT finding_id, line_no, src, dest, score FROM (SELECT *, max(score) OVER (PARTITION BY src) AS sb FROM summ WHERE NOT benign AND score >= 0.8)
ORDER BY sb DESC, src, score DESC, dest, finding_id, line_no LIMIT 30""", "summ"))
query("summary_signals", lambda v: D.summary_signals(_summ(v)).select("signal", "finding_id", "line_no", "src", "dest"),
      with_views("""SELECT 'strobe' AS signal, finding_id, line_no, src, dest FROM summ WHERE strobe AND NOT benign
UNION ALL SELECT 'threat_intel', finding_id, line_no, src, dest FROM summ WHERE threat_intel AND NOT user_safe""", "summ"))
_KEYWORD = "(CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(dest, '{w}')" for w in words) + f" THEN {i}" for i, (words, _) in enumerate(C.DEVICE_KEYWORDS)) + " END)"
_KEYNAMES = "[" + ", ".join(f"'{label}'" for _, label in C.DEVICE_KEYWORDS) + "]"
# DNS names stand in for destinations here, because the finding names carry no device keywords.
_named = lambda v: v.dns.select("src", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id") % 9, F.lit(".icloud.com")))
                                .when(F.col("event_id") % 7 == 0, "eu.garmin.com").otherwise(F.col("query")).alias("dest"))
query("likely_benign", lambda v: D.likely_benign(_named(v)),
      with_views("", "dns").rstrip() + f""",
  d AS (SELECT DISTINCT src, CASE WHEN event_id % 5 = 0 THEN 'x' || (event_id % 9) || '.icloud.com' WHEN event_id % 7 = 0 THEN 'eu.garmin.com' ELSE query END AS dest FROM dns),
  e AS (SELECT src, string_agg(dest, ', ' ORDER BY dest) AS ev FROM (SELECT * FROM d WHERE {first_label_sql('dest', C.BENIGN_VENDORS)} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY dest) <= 3) GROUP BY src)
SELECT d.src, {_KEYNAMES}[min({_KEYWORD}) + 1] AS label, coalesce(any_value(ev), '') AS evidence FROM d LEFT JOIN e USING (src) GROUP BY d.src HAVING min({_KEYWORD}) IS NOT NULL""")

_HYP = _sql_rx("|".join(t.replace(".", r"\.") for t in C.HYPERSCALER_TOKENS))
_GATED = f"""
  tk AS (SELECT dst, dst_port, count(DISTINCT src) AS t FROM egress GROUP BY ALL),
  nt AS (SELECT fqdn, count(DISTINCT src) AS nt FROM summ WHERE NOT benign AND fqdn <> '' GROUP BY 1),
  ga AS (SELECT unnest(list_filter([CASE WHEN score >= 1 THEN 'high_score_beacon' END, CASE WHEN strobe THEN 'persistent_beacon' END], lambda x: x IS NOT NULL)) AS type,
    CASE WHEN (s.dst <> '::' AND regexp_matches(lower(coalesce(org, '')), {_HYP})) OR regexp_matches(lower(s.fqdn), {_suffix_rx(C.HYPERSCALER_SUFFIXES)}) THEN 'hyperscaler'
      WHEN CASE WHEN s.dst <> '::' THEN coalesce(t, 1) ELSE coalesce(nt, 0) END > 1 THEN 'shared_lan' ELSE 'fire' END AS reason, src AS device, dest
    FROM summ s LEFT JOIN tk ON tk.dst = s.dst AND tk.dst_port = coalesce(TRY_CAST(split_part(service, ':', 1) AS INTEGER), 0) LEFT JOIN nt ON nt.fqdn = s.fqdn
    WHERE NOT benign AND (score >= 1 OR strobe))"""
_ALERT_SQL = """
SELECT type, reason, device, CASE type WHEN 'high_score_beacon' THEN 'Score-1.0 beacon → ' ELSE 'Strobe → ' END || substring(dest, 1, 80) AS detail FROM ga
UNION ALL SELECT 'threat_intel_hit', 'fire', src, 'Threat intel hit → ' || substring(dest, 1, 80) FROM summ WHERE threat_intel AND NOT user_safe"""
_alerts = lambda v: G.summary_alerts(_summ(v), K.lan_talkers(v.conn, None))
query("gate_alerts", lambda v: _alerts(v), with_views("", "summ", "egress").rstrip() + "," + _GATED + _ALERT_SQL)
query("gate_reasons", lambda v: G.gate_stats(_alerts(v), "type"),
      with_views("", "summ", "egress").rstrip() + "," + _GATED + f" SELECT type AS component, reason, count(*) AS n FROM ({_ALERT_SQL}) GROUP BY 1, 2")
query("gate_talkers_down", lambda v: G.gate_stats(G.summary_alerts(_summ(v), None), "type"),
      with_views("", "summ", "egress").rstrip() + "," + _GATED + f""" SELECT type AS component,
  CASE WHEN type = 'threat_intel_hit' OR reason = 'hyperscaler' THEN reason ELSE 'talkers_unknown' END AS reason, count(*) AS n FROM ({_ALERT_SQL}) GROUP BY 1, 2""")
view("sflagged", flag_sql(True).replace("SOURCE", "(SELECT * FROM summ WHERE NOT benign)"), "summ")
query("exit_contacts", lambda v: G.exit_contacts(D.flagged(_summ(v).where(~F.col("benign")), True)),
      with_views("""SELECT 'tor_contact' AS type, 'fire' AS reason, src AS device, 'Tor exit contact → ' || substring(arg_max(dest, (score, dest)), 1, 80) AS detail
FROM sflagged WHERE flag = 'tor' GROUP BY src""", "sflagged"))
query("toggled_alerts",
      lambda v: G.enabled_only(_alerts(v), v.spark.sql("SELECT * FROM VALUES ('persistent_beacon', false), ('new_device', true) AS t(type, enabled)"))
      .groupBy("type").agg(F.count("*").alias("n")),
      with_views("", "summ", "egress").rstrip() + "," + _GATED + f" SELECT type, count(*) AS n FROM ({_ALERT_SQL}) WHERE type <> 'persistent_beacon' GROUP BY 1")
_by_device = lambda v: v.flows.select(
    F.col("event_type").alias("type"), F.when(F.col("k") % 3 == 0, "high").otherwise("medium").alias("severity"), F.lit("gw").alias("device"), F.lit("busy").alias("detail"), "ts")
query("alert_dedup_batch", lambda v: Q.dedup_alerts(_by_device(v)).select("type", "severity", "fingerprint", "sec"),
      with_views("""SELECT event_type AS type, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'medium' END AS severity, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM flows""", "flows")
      .replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT event_type AS type, CASE WHEN k % 3", ", a AS (SELECT event_type AS type, CASE WHEN k % 3", 1)
      + """),
  s AS (SELECT type, severity, min(sec) AS sec FROM a GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT s.type, s.severity, (SELECT min(a.sec) FROM a WHERE a.type = s.type AND a.severity = s.severity
      AND a.sec >= s.sec + CASE WHEN s.severity = 'high' THEN 21600 ELSE 3600 END) AS sec FROM s) WHERE sec IS NOT NULL)
SELECT type, severity, substring(sha256(type || ':' || severity || ':gw:busy'), 1, 32) AS fingerprint, sec FROM s""")
