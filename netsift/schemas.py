"""Fixed column types of the logs and documents this package reads."""

CONN = "ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, `id.resp_p` int, proto string, service string, duration double, orig_ip_bytes bigint, resp_ip_bytes bigint"
SSL = "ts double, `id.orig_h` string, `id.resp_h` string, `id.resp_p` int, server_name string, subject string, validation_status string, established string, ja4 string"
DNS = "ts double, `id.orig_h` string, query string, qtype_name string, rcode_name string, answers array<string>"
HTTP = "ts double, `id.orig_h` string, `id.resp_h` string, host string, uri string, method string, user_agent string"
WEIRD = "ts double, `id.orig_h` string, name string, addl string"
DHCP = "ts double, mac string, client_addr string, assigned_addr string, host_name string"
ARP = "ts double, operation string, src_mac string, src_ip string, dst_mac string, dst_ip string, info string, sha string, mismatch string"
LOGS = {"conn": CONN, "ssl": SSL, "dns": DNS, "http": HTTP, "weird": WEIRD, "dhcp": DHCP, "arp": ARP}

EVE = (
    "timestamp string, event_type string, src_ip string, dest_ip string, "
    "alert struct<signature: string, signature_id: bigint, severity: int>, "
    "http struct<hostname: string, url: string, http_user_agent: string, http_method: string>, "
    "dns struct<rrname: string>, tls struct<sni: string>"
)
REGISTRY = (
    "version int, devices map<string, string>, domains map<string, string>, protocols map<string, string>, orgs map<string, string>"
)
TELEMETRY = (
    "date string, records array<struct<time: string, temp_c: double, cpu_pct: double, mem_pct: double, "
    "top_cpu: array<struct<name: string, pct: double>>, top_mem: array<struct<name: string, pct: double>>, fan_1: boolean, fan_2: boolean>>"
)
# The finding report's columns, in file order.
REPORT = [
    "severity", "src", "dst", "fqdn", "score", "strobe", "total_duration", "long_connection_score", "subdomains", "c2_dns_score",
    "threat_intel", "prevalence", "first_seen", "missing_host_header", "conns", "total_bytes", "service", "modifiers",
]
