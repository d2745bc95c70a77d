"""Per-row rules against their golden cases."""

import fnmatch
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netsift.functions import catalogues as C
from netsift.functions import devices as V
from netsift.functions import flags as G
from netsift.functions import ip as IP
from netsift.functions import ja4 as J
from netsift.functions import names as N


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def table(spark, expr, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr.alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_addresses_match_the_standard_library(spark):
    rng = random.Random(1)
    v4 = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    v4 += ["10.0.0.1", "172.31.255.255", "172.32.0.0", "192.168.1.1", "127.0.0.1", "224.0.0.1", "255.255.255.255", "192.0.0.9",
           "192.0.0.8", "198.19.0.1", "203.0.113.5", "169.254.1.1", "0.0.0.0", "100.64.0.1"]
    assert table(spark, IP.ip_num("v"), v4) == [int(ipaddress.IPv4Address(x)) for x in v4]
    public = [not (a.is_private or a.is_loopback or a.is_multicast or a.is_link_local or a.is_reserved or a.is_unspecified)
              for a in map(ipaddress.IPv4Address, v4)]
    assert table(spark, IP.is_public_v4("v"), v4) == public
    lan = [any(ipaddress.ip_address(x) in ipaddress.ip_network(n) for n in C.LAN_CIDRS) for x in v4]
    assert table(spark, IP.is_lan("v"), v4) == lan


def test_bits_of_both_families(spark):
    rng = random.Random(2)
    v6 = [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(50)] + ["::1", "2001:db8::", "fe80::1:2", "::"]
    assert table(spark, IP.ip_bits("v"), v6) == [format(int(ipaddress.IPv6Address(x)), "0128b") for x in v6]
    bad = ["", "1.2.3", "1.2.3.256", "1:2:3", "12345::1", "01.2.3.4", "abc", "1::2::3:4:5:6:7:8:9"]
    assert table(spark, IP.ip_bits("v"), bad) == [None] * len(bad)
    assert one(spark, IP.ip_bits("v"), "::ffff:1.2.3.4") == format(0x01020304, "032b")


def test_cidr_prefix_ignores_host_bits(spark):
    values = ["10.1.2.3/8", "1.2.3.4", "1.2.3.0/33", "x/8", "2001:db8::/32", "0.0.0.0/0"]
    got = table(spark, IP.cidr_prefix("v"), values)
    assert got == ["00001010", format(0x01020304, "032b"), None, None, format(0x20010DB8, "032b"), ""]


def test_host_and_port(spark):
    host, port = IP.split_host_port("v")
    values = ["10.0.0.1:80", "[2001:db8::1]:443", "10.0.0.1", "name:x"]
    assert table(spark, host, values) == ["10.0.0.1", "2001:db8::1", "10.0.0.1", "name:x"]
    assert table(spark, port, values) == [80, 443, None, None]


@pytest.mark.parametrize("pattern", ["*.foo.com", "foo?.com", "1.2.3.*", "h[1-3].x", "h[!1-3].x", "[x", "a.b", "*", "a+b*", "[]]x"])
def test_globs_follow_shell_rules(spark, pattern):
    hosts = ["foo.com", "sub.foo.com", "xfoo.com", "foo1.com", "1.2.3.4", "h1.x", "h9.x", "[x", "axb", "a.b", "FOO.com", "a+bc", "]x"]
    want = [fnmatch.fnmatchcase(h, pattern) or (pattern.startswith("*.") and h == pattern[2:]) for h in hosts]
    assert table(spark, N.glob_matches("v", pattern), hosts) == want


def test_registrable_pattern(spark):
    cases = {
        "krebsonsecurity.com": "*.krebsonsecurity.com", "bbc.co.uk": "*.bbc.co.uk", "www.bbc.co.uk.": "*.bbc.co.uk",
        "a.b.Example.NET": "*.example.net", "10.0.0.1": "10.0.0.1", "host": "host", "co.uk": "co.uk", "": "",
    }
    assert table(spark, N.registrable_pattern("v"), list(cases)) == list(cases.values())


def test_entropy(spark):
    got = table(spark, N.sld_entropy("v"), ["short.com", "aaaaaaaa.com", "www.abcdefgh.com", "nodots", None, "abababab.x."])
    assert got == pytest.approx([0.0, 0.0, 3.0, 0.0, 0.0, 1.0])


def test_names(spark):
    assert table(spark, N.clean_name("v"), ["foo.com.", " a ", "b"]) == ["foo.com", "a", "b"]
    assert table(spark, N.subject_cn("v"), ["O=x, cn= a.b ,C=US", "O=x", "CN=q"]) == ["a.b", "O=x", "q"]
    assert table(spark, N.hours_ago("v"), ["3 hours ago", "1 hour ago", "30 minutes ago", "2 days ago", ""]) == [3.0, 1.0, 0.5, None, None]
    assert table(spark, N.first_port("v"), ["443:tcp:ssl", "icmp:0:", ""]) == [443, 0, 0]
    assert table(spark, N.rule_category("v"), ["ET MALWARE thing x", "One", " A  B C"]) == ["ET MALWARE", "One", "A B"]
    assert table(spark, N.is_infra_noise("v"), ["SURICATA STREAM x", "SURICATA QUIC y", "SURICATA HTTP", None]) == [True, True, False, False]
    assert table(spark, N.is_safe_name("v"), ["apple.com", "x.Apple.com", "notapple.com", "dns.google", "x.apple", None]) == [True, True, False, True, True, False]
    assert table(spark, N.is_hyperscaler_org("v"), ["Amazon.com, Inc.", "AT&T Services", "Tiny Host", None]) == [True, True, False, False]
    sni = N.sni_matches("v", C.RELAY_SNI_EXACT, C.RELAY_SNI_SUFFIXES)
    assert table(spark, sni, ["AKA.ms", "x.teams.microsoft.com", "-", "teams.microsoft.com.evil.org"]) == [True, True, False, False]


def test_longpoll_needs_every_name(spark):
    df = spark.createDataFrame([(0, []), (1, ["a.trouter.teams.microsoft.com"]), (2, ["a.trouter.teams.microsoft.com", "b.com"])], "i int, v array<string>")
    assert [r["r"] for r in sorted(df.select("i", N.longpoll_only("v").alias("r")).collect())] == [False, True, False]


def test_user_agents_and_devices(spark):
    agents = ["Mozilla/5.0 (iPad; CPU OS 16_5 like Mac OS X)", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X)",
              "Dalvik (Linux; U; Android 13)", "Mozilla (Macintosh; Intel Mac OS X 10_15_7)", "x Darwin/22", "Windows NT 6.1", "Windows NT 9.9",
              "(X11; Linux x86_64)", "CrOS", "Sonos/70", "curl"]
    assert table(spark, V.os_from_user_agent("v"), agents) == [
        "iPadOS 16.5", "iOS 17.2", "Android 13", "macOS 10.15", "macOS/iOS", "Windows 7", "Windows NT 9.9", "Linux", "Chrome OS", "Sonos", None]
    assert table(spark, V.is_local_mac("v"), ["a2:00:00:00:00:00", "dc:a6:32:00:00:00", "zz:1", ""]) == [True, False, False, False]
    assert one(spark, V.mac_prefix("v"), "dc-a6:32:00:00:00") == "DCA632"
    os_, sure = V.os_from_device(F.lit("Apple, Inc."), "v")
    assert table(spark, os_, ["toms-macbook", "iphone-x", "echo-1f", "thing"]) == ["macOS", "iOS", "Fire OS (Echo)", None]
    assert table(spark, sure, ["toms-macbook", "iphone-x"]) == [False, True]


def test_fingerprint_rules(spark):
    shapes = {"t12d190800_a_b": "TLS 1.2 / no-ALPN (IoT-likely)", "q13d0312h3_a_b": "QUIC client (Chrome / Apple-family)",
              "t13d1517h1_a_b": "TLS 1.3 / h1 client (system service or app)", "t13d1516h2_a_b": "TLS 1.3 / h2 client", "t10d_a_b": "TLS client", "nope": None}
    assert table(spark, J.shape_label("v"), list(shapes)) == list(shapes.values())
    assert table(spark, J.is_threat_label("v"), ["Cobalt Strike", "Sliver Agent / GoLang", "Safari", None]) == [True, False, False, False]


def test_finding_flags(spark):
    cols = "dst string, fqdn string, score double, conns bigint, total_bytes bigint, service string, first_seen string, dest string"
    rows = [
        ("185.220.101.7", "", 0.1, 3, 2_500_000, "", "", "d"), ("1.1.1.1", "x.BAIDU.com", 0.1, 3, 0, "", "", "d"),
        ("9.9.9.9", "n", 0.95, 60, 0, "icmp:0:", "2 hours ago", "d"), ("9.9.9.9", "n", 0.95, 400, 0, "53:udp:dns", "2 hours ago", "n"),
        ("9.9.9.9", "", 0.98, 1, 0, "", "", "d"), ("17.1.1.1", "", 0.98, 1, 0, "", "", "d"), ("9.9.9.9", "n", 0.98, 1, 0, "", "", "d"),
    ]
    got = [r["f"] for r in spark.createDataFrame(rows, cols).select(G.finding_flag().alias("f")).collect()]
    assert [tuple(f) if f else None for f in got] == [
        ("tor", "Tor Project IP (3 conns, 2.5 MB)"), ("vendor-telemetry", "Baidu"), ("icmp", "ICMP beacon: 60 pings, ~1 every 2.0 min"),
        ("dns", "Excessive DNS: 400 queries, ~200/hr → n"), ("unknown", "Score 0.980 beacon to unnamed IP (no FQDN)"), None, None]


def test_intel_badges_and_alert_keys(spark):
    rows = [(50, ["cdn"], "med"), (75, [], "high"), (0, ["cdn"], "med"), (0, ["honeypot"], "high"), (0, [], "none")]
    df = spark.createDataFrame(rows, "s int, t array<string>, want string")
    level = G.intel_severity("s", "t", F.lit(0), F.lit(0), F.lit(False), F.lit(False))
    assert [r["want"] for r in df.collect()] == [r["l"] for r in df.select(level.alias("l")).collect()]
    key = lambda sev: one(spark, G.alert_fingerprint(F.lit("t"), F.lit(sev), F.lit("d"), "v"), "x")
    import hashlib
    assert key("high") == hashlib.sha256(b"t:high:d:x").hexdigest()[:32] != key("medium")


def test_v6_addresses(spark):
    good = ["::", "::1", "fe80::1", "1:2:3:4:5:6:7:8", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::8", "2001:DB8::"]
    bad = [":::", "fe80:::1", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::8:9", "1:2:3:4:5:6:7", "::g", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:", "::1.2.3", ""]
    import ipaddress

    want = [format(int(ipaddress.ip_address(a)), "0128b") for a in good]
    assert table(spark, IP.ip_bits("v"), good) == want
    assert table(spark, IP.ip_bits("v"), bad) == [None] * len(bad)
