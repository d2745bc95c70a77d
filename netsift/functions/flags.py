"""Finding flags, intel severity and alert fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogues as C
from . import ip as IP
from . import names as N
from .ip import col


def _fixed(number: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", number.cast("double"))


def finding_flag(
    dst="dst", fqdn="fqdn", score="score", conns="conns", total_bytes="total_bytes",
    service="service", first_seen="first_seen", dest="dest", skip_benign_names: bool = False,
) -> Column:
    """Why a finding deserves a look, as ``struct(type, msg)``; null when nothing stands out.

    Rules in order: exit node, telemetry vendor, ICMP beacon, excessive DNS, unnamed destination.
    The text summary (``skip_benign_names``) also spares addresses with a benign name.
    """
    name = F.when(F.trim(col(fqdn)) != "", col(fqdn)).otherwise(col(dst))
    svc = F.lower(F.coalesce(col(service), F.lit("")))
    score_ = F.coalesce(col(score).cast("double"), F.lit(0.0))
    n = F.coalesce(col(conns).cast("bigint"), F.lit(0))
    hours = N.hours_ago(first_seen)
    vendor = N.telemetry_vendor(name)
    n_text = n.cast("string")

    exit_msg = F.concat(
        F.lit("Tor Project IP ("), n_text, F.lit(" conns, "),
        _fixed(F.coalesce(col(total_bytes).cast("double"), F.lit(0.0)) / 1e6, 1), F.lit(" MB)"),
    )
    ping = F.concat(F.lit("ICMP beacon: "), n_text, F.lit(" pings"))
    ping_msg = F.when(
        (hours > 0) & (n > 0),
        F.concat(ping, F.lit(", ~1 every "), _fixed(hours * 60 / F.greatest(n, F.lit(1)), 1), F.lit(" min")),
    ).otherwise(ping)
    query = F.concat(F.lit("Excessive DNS: "), n_text, F.lit(" queries"))
    dns_msg = F.when(
        hours > 0,
        F.concat(query, F.lit(", ~"), _fixed(n / F.greatest(hours, F.lit(1e-9)), 0), F.lit("/hr → "), col(dest)),
    ).otherwise(F.concat(query, F.lit(" → "), col(dest)))
    unnamed = (score_ >= 0.97) & (F.coalesce(F.trim(col(fqdn)), F.lit("")) == "") & IP.vendor_net(dst).isNull()
    if skip_benign_names:
        unnamed = unnamed & ~N.is_benign_name(dst)
    unnamed_msg = F.concat(F.lit("Score "), _fixed(score_, 3), F.lit(" beacon to unnamed IP (no FQDN)"))

    def flag(kind: str, msg: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), msg.alias("msg"))

    return (
        F.when(IP.is_exit_net(dst), flag("tor", exit_msg))
        .when(vendor.isNotNull(), flag("vendor-telemetry", vendor))
        .when(svc.contains("icmp") & (score_ >= 0.90), flag("icmp", ping_msg))
        .when(svc.contains("53:udp:dns") & (n >= 200) & (score_ >= 0.90), flag("dns", dns_msg))
        .when(unnamed, flag("unknown", unnamed_msg))
    )


def intel_severity(abuse_score, tags, n_vulns, n_ports, listed, exit_node, known=None) -> Column:
    """Badge of an address: high, med or none; null without a record."""
    score = F.coalesce(col(abuse_score).cast("int"), F.lit(0))
    tags = F.coalesce(col(tags), F.array().cast("array<string>"))
    yes = lambda c: F.coalesce(col(c), F.lit(False))
    num = lambda c: F.coalesce(col(c), F.lit(0))
    hot = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in C.HOT_SCAN_TAGS]))
    level = (
        F.when((score >= 75) | hot | (num(n_vulns) > 0) | yes(listed) | yes(exit_node), "high")
        .when((score > 0) | (F.size(tags) > 0) | (num(n_ports) >= 50), "med")
        .otherwise("none")
    )
    return level if known is None else F.when(col(known), level)


def alert_fingerprint(kind, severity, device, detail) -> Column:
    """Key of one logical alert. Severity is part of it, so an escalation is a new alert."""
    text = F.concat_ws(":", *[F.coalesce(col(c), F.lit("")) for c in (kind, severity, device, detail)])
    return F.substring(F.sha2(text, 256), 1, 32)


def alert_ttl_seconds(severity) -> Column:
    return F.when(F.lower(col(severity)) == "high", F.lit(C.ALERT_TTL_HIGH_HOURS * 3600)).otherwise(
        F.lit(C.ALERT_TTL_OTHER_HOURS * 3600)
    )


def level_of(value, levels: dict) -> Column:
    """Name of the highest level reached; ``none`` below ``base``."""
    value = col(value)
    return (
        F.when(value >= levels["high"], "high").when(value >= levels["medium"], "medium")
        .when(value >= levels["low"], "low").when(value >= levels["base"], "base").otherwise("none")
    )
