"""IDS alerts: signatures, LAN attribution, trend, offenders, priority-one pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import ip as IP
from ..functions import names as N
from .network import top_per
from .suppress import Registry, drop_devices


def relevant(alerts: DataFrame, registry: Registry) -> DataFrame:
    """Without sensor noise and without alerts that touch a listed device."""
    rows = alerts.where(~N.is_infra_noise("rule"))
    return drop_devices(drop_devices(rows, registry, "src_ip"), registry, "dst_ip")


def signatures(alerts: DataFrame) -> DataFrame:
    """Per rule: count, priority of its first alert, distinct sources, last time."""
    per = alerts.groupBy("rule", "src_ip").agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "event_id", "priority")).alias("_f"), F.max("ts").alias("last"))
    return per.groupBy("rule").agg(
        F.sum("n").alias("count"), F.min("_f")["priority"].alias("priority"), F.count("*").alias("unique_srcs"),
        F.max("last").alias("last_seen"),
    ).orderBy("priority", F.desc("count"), "rule")


def lan_peers(alerts: DataFrame, conn: DataFrame) -> DataFrame:
    """(ext_ip, lan_ip): inside hosts that exchanged flows with an outside address named in an alert."""
    ext = alerts.select(F.explode(F.array("src_ip", "dst_ip")).alias("ext_ip")).where(
        ~IP.is_lan("ext_ip") & ~F.col("ext_ip").isin("", "unknown")).distinct()
    pairs = conn.select("src", "dst").distinct()
    outward = pairs.where(IP.is_lan("src")).select(F.col("dst").alias("ext_ip"), F.col("src").alias("lan_ip"))
    inward = pairs.where(IP.is_lan("dst")).select(F.col("src").alias("ext_ip"), F.col("dst").alias("lan_ip"))
    return outward.unionByName(inward).join(ext, "ext_ip", "left_semi").distinct()


def _folded(alerts: DataFrame) -> DataFrame:
    """Counts per (src, dst, rule) with the first alert, whose priority is the one shown."""
    return alerts.groupBy("src_ip", "dst_ip", "rule").agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "event_id", "priority")).alias("first"))


def lan_rows(alerts: DataFrame, conn: DataFrame, registry: Registry) -> DataFrame:
    """Alerts by inside host: source side first, then destination, else the hosts flows connect.

    One row per (lan_ip, ext_ip, rule) with its count. Alerts are folded before they meet the peers.
    """
    folded = _folded(alerts)
    src_lan, dst_lan = IP.is_lan("src_ip"), IP.is_lan("dst_ip")
    direct = folded.where(src_lan | dst_lan).select(
        F.when(src_lan, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("lan_ip"),
        F.when(src_lan, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("ext_ip"), "rule", "first", "n")
    peers = drop_devices(lan_peers(alerts, conn), registry, "lan_ip")
    outside = folded.where(~src_lan & ~dst_lan).select(
        F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ext_ip"), "rule", "first", "n")
    traced = outside.join(peers, "ext_ip").select("lan_ip", "ext_ip", "rule", "first", "n")
    return direct.unionByName(traced).groupBy("lan_ip", "ext_ip", "rule").agg(
        F.sum("n").alias("count"), F.min("first")["priority"].alias("priority"))


def unresolved(alerts: DataFrame, conn: DataFrame) -> DataFrame:
    """Alerts between outside addresses none of which any inside host talked to."""
    known = lan_peers(alerts, conn).select("ext_ip").distinct()
    outside = _folded(alerts).where(~IP.is_lan("src_ip") & ~IP.is_lan("dst_ip"))
    for side in ("src_ip", "dst_ip"):
        outside = outside.join(known.select(F.col("ext_ip").alias(side)), side, "left_anti")
    return outside.select("src_ip", "dst_ip", "rule", F.col("first.priority").alias("priority"), F.col("n").alias("count"))


def categories(alerts: DataFrame, top: int = 20) -> DataFrame:
    per = alerts.groupBy(N.rule_category("rule").alias("category")).agg(F.count("*").alias("count"))
    return per.orderBy(F.desc("count"), "category").limit(top)


def hours(alerts: DataFrame) -> DataFrame:
    """24 rows, zero where nothing fired."""
    found = alerts.groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("count"))
    return alerts.sparkSession.range(24).select(F.col("id").alias("hour")).join(found, "hour", "left").fillna(0, ["count"])


def priorities(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("priority").agg(F.count("*").alias("count"))


def trend(alerts: DataFrame, today, days: int = 7) -> DataFrame:
    """Per day: count and whether there was no data at all (today always counts as covered)."""
    today = F.lit(today).cast("date")
    window = alerts.where((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today))
    found = window.groupBy("day").agg(F.count("*").alias("n"))
    axis = alerts.sparkSession.range(days).select(F.date_sub(today, F.col("id").cast("int")).alias("day"))
    return axis.join(found, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).alias("count"), (F.col("n").isNull() & (F.col("day") != today)).alias("no_data"))


def trend_details(alerts: DataFrame) -> DataFrame:
    """The rows behind a day's bar, newest first within the day."""
    return alerts.select("day", "ts", "priority", "rule", "src_ip", "dst_ip").orderBy("day", F.desc("ts"))


def offenders(alerts: DataFrame, top: int = 20) -> DataFrame:
    """Outside addresses that tripped at least two rules, three of them named."""
    pairs = alerts.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "rule").where(
        ~IP.is_lan("ip") & ~F.col("ip").isin("", "unknown")).distinct()
    counts = pairs.groupBy("ip").agg(F.count("*").alias("rule_count")).where("rule_count >= 2")
    best = counts.orderBy(F.desc("rule_count"), "ip").limit(top)
    shown = top_per(pairs.join(best.select("ip"), "ip", "left_semi"), ["ip"], ["rule"], 3).groupBy("ip").agg(
        F.array_join(F.sort_array(F.collect_list("rule")), " | ").alias("rules"))
    return best.join(shown, "ip")


def rule_context(events: DataFrame) -> DataFrame:
    """First HTTP, DNS and TLS context seen per rule."""
    at = lambda c, *fields: F.min(F.when(F.col(c).isNotNull(), F.struct("ts", "event_id", *[F.col(f"{c}.{f}").alias(f) for f in fields])))
    found = events.where("event_type = 'alert'").groupBy(F.col("alert.signature").alias("rule")).agg(
        at("http", "hostname", "url", "http_user_agent", "http_method").alias("h"), at("dns", "rrname").alias("d"), at("tls", "sni").alias("t"))
    return found.select(
        "rule", F.col("h.hostname").alias("http_host"), F.col("h.url").alias("http_url"), F.col("h.http_user_agent").alias("http_agent"),
        F.col("h.http_method").alias("http_method"), F.col("d.rrname").alias("dns_query"), F.col("t.sni").alias("tls_sni"))


def beacon_overlap(alerts: DataFrame, findings: DataFrame, registry: Registry) -> DataFrame:
    """Inside hosts that both beacon and trip alerts."""
    lan = alerts.where(IP.is_lan("src_ip")).select(F.col("src_ip").alias("ip"))
    beacons = drop_devices(findings.where(IP.looks_v4("src")).select("src"), registry).select(F.col("src").alias("ip"))
    return lan.intersect(beacons)


def p1_fold(alerts: DataFrame) -> DataFrame:
    """Priority-one alerts per (day, sid, source): count and first; folds of parts add up by sum and minimum."""
    return alerts.where("priority = 1").groupBy("day", "sid", "src_ip").agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "event_id", "rule", "proto", "dst_ip")).alias("f"))


def p1_alerts(alerts: DataFrame, repeat: int = C.P1_REPEAT_MIN) -> DataFrame:
    """Pages for priority one: each (sid, inside source) once per day, and sids that keep firing."""
    return p1_pages(p1_fold(alerts), repeat)


def p1_pages(p1: DataFrame, repeat: int = C.P1_REPEAT_MIN) -> DataFrame:
    lan = p1.where(IP.is_lan("src_ip")).select(
        "day", F.lit("suricata_p1_lan").alias("type"), F.col("src_ip").alias("device"),
        F.concat(F.lit("SID "), "sid", F.lit(" — "), F.substring("f.rule", 1, 80), F.lit(" ("), "f.proto", F.lit(" "), "src_ip",
                 F.lit(" → "), "f.dst_ip", F.lit(")")).alias("detail"))
    again = p1.groupBy("day", "sid").agg(F.sum("n").alias("n"), F.min("f").alias("f")).where(F.col("n") >= repeat).select(
        "day", F.lit("suricata_p1_repeated").alias("type"), F.lit("sensor").alias("device"),
        F.concat(F.lit("SID "), "sid", F.lit(f" fired ≥{repeat}× today — "), F.substring("f.rule", 1, 80)).alias("detail"))
    return lan.unionByName(again)


def with_rules(alerts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Alerts per (sid, rule) with what the catalogue says of the sid; ``known`` tells sids it lacks.

    Alerts are counted before the join; of a sid that is listed twice the enabled rule counts, then the smaller text.
    A logged id ``gid:sid:rev`` is joined by its middle part.
    """
    parts = F.split("sid", ":")
    sid = F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).otherwise(F.col("sid"))
    counts = alerts.groupBy(sid.alias("sid"), "rule").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    best = catalogue.groupBy("sid").agg(F.min(F.struct((~F.col("enabled")).alias("off"), "msg", "action", "classtype")).alias("_r"))
    j = counts.join(best, "sid", "left")
    return j.select(
        "sid", "rule", "n", "last_seen", F.col("_r").isNotNull().alias("known"), (~F.col("_r.off")).alias("enabled"), F.col("_r.action").alias("action"),
        F.col("_r.classtype").alias("classtype"), F.col("_r.msg").alias("msg"))
