"""The views of ``adapters`` stated as SQL, for checking results with a second engine."""

from __future__ import annotations

from . import reference_lists as L

_OCTETS = "('10.' || (({k} // 50000) % 256) || '.' || (({k} // 200) % 250) || '.' || ({k} % 200 + 1))"


def octets(key: str) -> str:
    return _OCTETS.format(k=f"({key})")


def mac(key: str) -> str:
    k = f"({key})"
    tail = f"lpad(lower(to_hex({k})), 6, '0')"
    return (
        f"(CASE {k} % 5 WHEN 3 THEN 'd8:3a:dd' WHEN 4 THEN '00:1a:2b' WHEN 0 THEN '3c:22:fb' WHEN 1 THEN 'a2:11:22' "
        f"ELSE 'dc:a6:32' END || ':' || {tail}[1:2] || ':' || {tail}[3:4] || ':' || {tail}[5:6])"
    )


def lan(c: str) -> str:
    return f"regexp_matches({c}, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')"


def v4num(c: str) -> str:
    part = lambda i: f"CAST(split_part({c}, '.', {i}) AS BIGINT)"
    return f"({part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)})"


_AGENTS = "[" + ", ".join(L.literal(a) for a in L.USER_AGENTS) + "]"
_GW = L.GATEWAY_IP

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


for _name, (_columns, _rows) in L.LISTS.items():
    view(f"l_{_name}", L.values_sql(_columns, _rows))

view("flows", f"""
  SELECT event_id, user_id, event_type, value, k, ts, CAST(ts AS DATE) AS day, {octets('user_id')} AS src,
    CASE WHEN k = 99 THEN '10.0.0.254' ELSE net || '.' ||
      CASE WHEN user_id % 2 = 0 THEN (user_id // 250) % 250 ELSE 101 END || '.' ||
      CASE WHEN user_id % 2 = 0 THEN user_id % 250 + 1 ELSE 7 END END AS dst,
    CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'purchase' THEN 53 WHEN 'signup' THEN 3478 ELSE 8443 END AS dst_port,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'udp' ELSE 'tcp' END AS proto,
    CASE event_type WHEN 'view' THEN 'ssl' WHEN 'click' THEN 'http' WHEN 'purchase' THEN 'dns' WHEN 'signup' THEN 'stun' ELSE 'ssl' END AS service
  FROM (
    SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CASE WHEN user_id % 10 = 0
        THEN date_trunc('day', ts) + to_seconds((user_id % 24) * 3600 + event_id % 1800) ELSE ts END AS ts,
      CASE event_type
        WHEN 'view' THEN ['17.5', '93.184', '52.113'] WHEN 'click' THEN ['151.101', '93.184', '104.18']
        WHEN 'purchase' THEN ['8.8', '77.88', '8.8'] WHEN 'signup' THEN ['52.114', '45.155', '185.220']
        ELSE ['91.198', '45.155', '77.88'] END[user_id % 3 + 1] AS net
    FROM events)""")
view("conn", f"""
  SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sec, day, src, dst, dst_port, proto, service,
    {lan('src')} AS src_local, {lan('dst')} AS dst_local,
    CAST(floor(value * 1000) AS BIGINT) AS orig_ip_bytes, CAST(k * 1000 AS BIGINT) AS resp_ip_bytes, value * 20 AS duration
  FROM flows""", "flows")
view("sites", """
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site,
    regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
view("ssl", """
  SELECT event_id, ts, day, src, dst, dst_port,
    CASE WHEN k % 10 = 7 THEN NULL
      WHEN dst LIKE '52.11%' AND k % 4 = 0 THEN 'a1.trouter.teams.microsoft.com'
      WHEN dst LIKE '52.11%' AND k % 4 = 1 THEN 'teams.microsoft.com'
      WHEN k % 17 = 3 THEN dst ELSE site END AS server_name,
    'O=Example, CN=' || site || ',C=US' AS server_subject,
    CASE WHEN k < 5 THEN 'self signed certificate' WHEN k < 8 THEN 'certificate has expired' ELSE 'ok' END AS validation_status,
    k % 13 <> 0 AS established,
    ['t13d1516h2', 't12d190800', 'q13d0312h3', 't13d1517h1'][user_id % 4 + 1] || '_' ||
      CASE WHEN event_id % 7 = 0 THEN 'badc0ffee' ELSE ['aaaa0000', 'dddd1111', 'bbbb2222', 'cccc3333'][user_id % 4 + 1] END
      || CASE WHEN user_id % 20 = 7 AND k % 10 = 3 THEN '_u' || user_id ELSE '_e' || (event_id % 3) END AS ja4
  FROM flows JOIN sites ON page_id = event_id % (SELECT count(*) FROM pages)
  WHERE service = 'ssl'""", "flows", "sites")
view("dns", """
  SELECT event_id, ts, day, src,
    CASE WHEN k % 9 = 0 THEN substring(md5(CAST(event_id AS VARCHAR)), 1, 24) || '.biz'
      WHEN k % 11 = 0 THEN '7.101.220.185.in-addr.arpa'
      WHEN k % 19 = 5 THEN 't' || (event_id % 400) || '.tunnel.example.co.uk' ELSE site END AS query,
    CASE event_id % 4 WHEN 1 THEN 'AAAA' WHEN 2 THEN 'TXT' ELSE 'A' END AS qtype_name,
    CASE WHEN k % 3 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode_name,
    CASE WHEN k % 3 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 2 = 0 THEN ['cname.example.net', dst] ELSE [dst] END AS answers
  FROM flows JOIN sites ON page_id = event_id % (SELECT count(*) FROM pages)""", "flows", "sites")
view("http", f"""
  SELECT event_id, ts, day, src, dst, dst_port, CASE WHEN k % 23 = 0 THEN '' ELSE site END AS host, path AS uri,
    CASE WHEN k < 70 THEN 'GET' WHEN k < 90 THEN 'POST' ELSE 'PUT' END AS method,
    {_AGENTS}[user_id % {len(L.USER_AGENTS)} + 1] AS user_agent,
    CASE k % 5 WHEN 0 THEN 'text/css' WHEN 1 THEN 'text/csv' ELSE 'text/html' END AS mime
  FROM flows JOIN sites ON page_id = event_id % (SELECT count(*) FROM pages) WHERE service = 'http'""", "flows", "sites")
view("weird", """
  SELECT event_id, ts, src, CASE WHEN k % 20 = 19 THEN '-' ELSE 'weird_' || (k % 40) END AS name,
    'seen by event ' || event_id AS addl FROM flows""", "flows")
view("arp", f"""
  SELECT event_id, ts, day, CASE WHEN k = 98 THEN 'bad' WHEN k % 2 = 0 THEN 'reply' ELSE 'request' END AS operation,
    CASE WHEN k = 1 AND user_id % 2 = 0 THEN '{L.GATEWAY_MACS[0].upper()}' WHEN k = 2 THEN {mac('user_id + 1')}
      WHEN k = 3 AND user_id % 7 = 0 THEN '{L.GATEWAY_MACS[1]}' ELSE {mac('user_id')} END AS src_mac,
    CASE WHEN k = 1 THEN '{_GW}' ELSE src END AS src_ip,
    CASE WHEN k = 98 THEN 'short packet ' || (event_id % 9) ELSE '' END AS info
  FROM flows""", "flows")
view("findings", f"""
  SELECT o_orderkey AS finding_id, l_linenumber AS line_no,
    CAST(DATE '2024-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INTEGER) AS DATE) AS day,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
      WHEN '4-NOT SPECIFIED' THEN 'Low' ELSE 'None' END AS severity,
    CASE WHEN l_partkey % 97 = 5 THEN '::' ELSE {octets('o_custkey // 10')} END AS src,
    CASE WHEN l_partkey % 4 <> 0 AND l_suppkey % 11 = 0 THEN '::' ELSE
      ['93.184', '17.5', '185.220', '45.155', '91.198'][l_suppkey % 5 + 1] || '.' || (101 + l_suppkey // 250) || '.' || (l_suppkey % 250) END AS dst,
    CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 = 1 THEN 'h' || l_suppkey || '.example.com'
      WHEN l_partkey % 4 = 2 AND l_suppkey % 10 = 3 THEN 'cdn' || l_suppkey || '.baidu.com'
      WHEN l_partkey % 4 = 2 THEN 'api' || l_suppkey || '.knock.app'
      WHEN l_suppkey % 7 = 0 THEN 'update.microsoft.com' ELSE 's' || l_suppkey || '.example.org' END AS fqdn,
    round(l_discount * 10, 2) AS score, l_quantity >= 49 AS strobe, (l_tax = 0.08 AND l_linenumber = 1) AS threat_intel,
    CAST(l_quantity * 10 AS BIGINT) AS conns, CAST(floor(l_extendedprice) AS BIGINT) AS total_bytes,
    CASE l_linenumber WHEN 2 THEN '80:tcp:http,3478:udp:' WHEN 3 THEN '53:udp:dns' WHEN 4 THEN 'icmp:0:'
      WHEN 5 THEN '8443:tcp:ssl' WHEN 6 THEN '123:udp:ntp' ELSE '443:tcp:ssl' END AS service,
    CAST(l_quantity AS INTEGER) || CASE WHEN l_linestatus = 'O' THEN ' hours ago' ELSE ' minutes ago' END AS first_seen
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
view("alerts", """
  SELECT event_id, ts, day, CAST(2000000 + k % 50 AS VARCHAR) AS sid,
    CASE WHEN k % 10 = 0 THEN 'SURICATA STREAM ' || event_type ELSE 'ET ' || upper(event_type) || ' pattern ' || (k % 50) END AS rule,
    k % 4 + 1 AS priority, proto,
    CASE WHEN k % 7 = 0 THEN '198.41.0.' || (k + 1) WHEN k % 2 = 0 THEN src ELSE dst END AS src_ip,
    CASE WHEN k % 35 = 0 THEN '198.41.1.' || (k + 1) WHEN k % 7 = 0 THEN dst WHEN k % 2 = 0 THEN dst ELSE src END AS dst_ip
  FROM flows""", "flows")
view("telemetry", """
  SELECT event_id, 'host' || (user_id % 20) AS host, ts AS time, CAST(40 + k % 40 AS DOUBLE) AS temp_c, value % 100 AS cpu_pct,
    CAST(k AS DOUBLE) AS mem_pct, CASE WHEN k % 6 <> 0 THEN event_type END AS top_cpu_name, event_type AS top_mem_name,
    k > 60 AS fan_1, k > 80 AS fan_2
  FROM flows""", "flows")
view("leases", f"""
  SELECT {mac('c_custkey')} AS mac, {octets('c_custkey')} AS ip,
    CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'iPhone-' || c_custkey WHEN 2 THEN 'DESKTOP-' || c_custkey
      WHEN 3 THEN 'mac-mini-' || c_custkey ELSE 'dev-' || c_custkey END AS hostname FROM customer""")
view("dhcp_log", f"""
  SELECT CAST(DATE '2024-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INTEGER) AS DATE) AS day,
    {mac('o_custkey + 40')} AS mac,
    CASE WHEN o_orderkey % 5 = 0 THEN {octets('o_custkey + 40 + 100000')} ELSE {octets('o_custkey + 40')} END AS ip,
    CASE WHEN o_orderkey % 4 = 0 THEN '-' ELSE 'node-' || (o_custkey + 40) END AS hostname FROM orders""")
view("arp_table", f"SELECT {octets('s_suppkey * 17 + 3')} AS ip, {mac('s_suppkey * 17 + 3')} AS mac FROM supplier")
view("old_assets", f"""
  SELECT {octets('c_custkey * 2')} AS ip, {mac('c_custkey * 2')} AS mac, 'old-' || (c_custkey * 2) AS hostname,
    CASE WHEN (c_custkey * 2) % 8 = 0 THEN 'Linux' ELSE '' END AS os,
    CASE WHEN (c_custkey * 2) % 6 = 0 THEN ['22/tcp:ssh', '80/tcp'] ELSE CAST([] AS VARCHAR[]) END AS open_ports FROM customer""")
view("intel", """
  SELECT ['93.184', '17.5', '185.220', '45.155', '91.198'][s_suppkey % 5 + 1] || '.' || (101 + s_suppkey // 250) || '.' || (s_suppkey % 250) AS ip,
    CASE WHEN s_suppkey % 3 = 0 THEN CAST(floor(abs(s_acctbal) / 100) AS INTEGER) END AS abuse_score,
    CASE WHEN s_suppkey % 13 = 0 THEN ['honeypot'] WHEN s_suppkey % 4 = 0 THEN ['cdn'] ELSE CAST([] AS VARCHAR[]) END AS tags,
    CASE WHEN s_suppkey % 17 = 0 THEN 2 ELSE 0 END AS n_vulns, CAST(s_suppkey % 60 AS INTEGER) AS n_ports,
    CAST(DATE '2024-01-30' - CAST(s_suppkey % 75 AS INTEGER) AS DATE) AS fetched,
    s_suppkey % 9 <> 0 AS has_scan, s_suppkey % 8 <> 0 AS has_abuse FROM supplier""")

# -- derived helpers ---------------------------------------------------------------------------
view("fp_devices", """
  SELECT s.ip, min(r.reason) AS reason FROM (SELECT mac, ip FROM leases UNION SELECT mac, ip FROM dhcp_log) s
  JOIN l_rules r ON r.kind = 'devices' AND lower(s.mac) = lower(r.pattern) GROUP BY s.ip""", "leases", "dhcp_log", "l_rules")
view("egress", """
  SELECT * FROM conn WHERE src_local AND NOT dst_local AND proto IN ('tcp', 'udp') AND service NOT IN ('dns', 'ntp')""", "conn")


def geo_of(ip: str, field: str) -> str:
    """Owner or place of an address: the narrowest listed range that holds it."""
    return (
        f"(SELECT g.{field} FROM l_geo g WHERE regexp_matches({ip}, '^[0-9.]+$') AND "
        f"{v4num(ip)} BETWEEN g.lo AND g.hi ORDER BY g.hi - g.lo, g.ord LIMIT 1)"
    )


def glob_hit(value: str, kind: str) -> str:
    """Does the value match one of the registry's globs of this kind?"""
    return (
        f"EXISTS (SELECT 1 FROM l_rules r WHERE r.kind = '{kind}' AND {value} IS NOT NULL AND "
        f"({value} GLOB r.pattern OR (r.pattern LIKE '*.%' AND {value} = substring(r.pattern, 3))))"
    )


def service_hit(value: str) -> str:
    return (
        f"EXISTS (SELECT 1 FROM l_rules r, unnest(string_split({value}, ',')) AS u(comp) WHERE r.kind = 'protocols' "
        f"AND (trim(u.comp) = r.pattern OR starts_with(trim(u.comp), r.pattern || ':')))"
    )


def with_views(sql: str, *names: str) -> str:
    """``sql`` preceded by the views it uses and those they use."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for need in VIEWS[name][0]:
            add(need)
        done.append(name)

    for name in names:
        add(name)
    # The shared flow shape is used many times per query; keep it computed once.
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ('flows', 'findings') else ''}({VIEWS[n][1]})" for n in done)
    return f"WITH {head}\n{sql}" if head else sql
