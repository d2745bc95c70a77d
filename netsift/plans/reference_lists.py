"""Small lists both engines read: networks, suppression rules, labels. Plain test values."""

GEO = [  # lo, hi, country, city, owner
    ("17.0.0.0", "17.255.255.255", "US", "Cupertino", "Apple Inc."),
    ("93.184.0.0", "93.184.255.255", "US", "", "Edgecast Example"),
    ("52.112.0.0", "52.115.255.255", "IE", "Dublin", "Microsoft Corporation"),
    ("151.101.0.0", "151.101.255.255", "US", "San Francisco", "Fastly, Inc."),
    ("104.18.0.0", "104.18.255.255", "", "", "Cloudflare, Inc."),
    ("8.8.0.0", "8.8.255.255", "US", "", "Google LLC"),
    ("45.155.0.5", "45.155.200.9", "RU", "Moscow", "Example Hosting"),
    ("45.155.100.0", "45.155.101.255", "NL", "Amsterdam", "Nested Colo"),
    ("185.220.101.0", "185.220.101.255", "DE", "", "Exit Relay Org"),
    ("91.198.0.0", "91.198.255.255", "FR", "Paris", "Lonely Servers"),
    ("77.88.3.1", "77.88.140.77", "RU", "Moscow", "Oddly Shaped Net"),
]
BLOCKLIST = [  # cidr, list id
    ("45.155.0.0/17", "SBL1"), ("45.155.0.0/20", "SBL2"), ("185.220.101.0/24", "SBL3"),
    ("91.198.101.0/26", "SBL4"), ("203.0.113.9/15", "SBL5"), ("not-a-net", "SBL6"), ("2001:db8::/32", "SBL7"),
]
EXIT_IPS = ["185.220.101.7", "45.155.101.7", "91.198.0.5"]
THREAT_FEED = ["45.155.101.7", "77.88.101.7", "91.198.0.21"]
RULES = [  # kind, order, pattern, reason
    ("devices", 0, "d8:3a:dd:00:00:03", "kitchen display"),
    ("devices", 1, "00:1a:2b:00:00:09", "printer"),
    ("domains", 0, "*.knock.app", "push service"),
    ("domains", 1, "91.198.0.1*", "monitoring range"),
    ("domains", 2, "ththen.example.org", "own site"),
    ("domains", 3, "h[1-3]?.example.com", "lab hosts"),
    ("domains", 4, "*.therha.example.com", "test host"),
    ("domains", 5, "m.th*.example.net", "mobile hosts"),
    ("domains", 6, "*.lan", "local zone"),
    ("protocols", 0, "3478:udp", "STUN"),
    ("protocols", 1, "123:udp", "time"),
    ("orgs", 0, "Fastly*", "CDN"),
    ("orgs", 1, "*Colo", "own racks"),
]
JA4_LABELS = [  # order, application, library, device, os, fingerprint
    (0, "Chromium Browser", "", "", "", "t13d1516h2_aaaa0000_e0"),
    (1, "Sliver Agent", "GoLang", "", "", "t13d1517h1_cccc3333_e1"),
    (2, "Cobalt Strike", "", "", "Windows", "t13d1516h2_badc0ffee_e1"),
    (3, "IcedID", "", "", "", "t12d190800_badc0ffee_e2"),
    (4, "Safari", "", "", "macOS", "q13d0312h3_bbbb2222_e0"),
    (5, "Safari", "", "", "macOS", "q13d0312h3_bbbb2222_e9"),
    (6, "", "", "", "", "t12d190800_dddd1111_e0"),
    (7, "Lumma Stealer", "", "", "", "t13d1516h2_aaaa0000_e2"),
]
USER_AGENTS = [
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X)",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)",
    "Dalvik/2.1.0 (Linux; U; Android 13; Pixel 7)",
    "Mozilla/5.0 (X11; Linux x86_64)",
    "",
    "Linux UPnP/1.0 Sonos/70.3",
]
GATEWAY_IP = "10.0.0.1"
GATEWAY_MACS = ["dc:a6:32:00:00:01", "dc:a6:32:00:00:02"]
WATCHED_DOMAIN = "example.org"


def literal(value) -> str:
    """A value as SQL text both engines understand."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(columns: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def v4_number(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


LISTS = {
    "geo": (
        ["ord", "lo", "hi", "cc", "city", "org"],
        [(i, v4_number(lo), v4_number(hi), cc, city, org) for i, (lo, hi, cc, city, org) in enumerate(GEO)],
    ),
    "blocklist": (["ord", "cidr", "sbl"], [(i, c, s) for i, (c, s) in enumerate(BLOCKLIST)]),
    "exit_ips": (["ip"], [(x,) for x in EXIT_IPS]),
    "threat_feed": (["ip"], [(x,) for x in THREAT_FEED]),
    "rules": (["kind", "ord", "pattern", "reason"], RULES),
    "ja4_labels": (["ord", "app", "lib", "device", "os", "ja4"], JA4_LABELS),
}
