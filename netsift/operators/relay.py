"""Tunnels hidden in conferencing relays: flow assembly, signals, per-device baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import ip as IP
from ..functions import ja4 as J
from ..functions import names as N
from .suppress import Registry, drop_devices

FLOW = ["day", "src", "dst", "dst_port"]


def relay_flows(
    conn: DataFrame, ssl: DataFrame, registry: Registry, cidrs: list[str] = C.RELAY_CIDRS,
    exact: list[str] = C.RELAY_SNI_EXACT, suffixes: list[str] = C.RELAY_SNI_SUFFIXES,
) -> DataFrame:
    """Relay-bound flows per (day, src, dst, port, proto): total duration and bytes, names, fingerprints.

    A flow is relay-bound by TLS server name or by address. TCP and UDP to the same port stay apart;
    names and fingerprints belong to TCP. Both sides are folded before they are joined.
    """
    tls = ssl.where(IP.is_lan("src") & (N.sni_matches("server_name", exact, suffixes) | IP.in_cidrs("dst", cidrs)))
    tls = tls.select(*FLOW, N.blank_to_null("server_name").alias("sni"), N.blank_to_null("ja4").alias("ja4"))
    # Distinct first: a set then holds a client's few names and fingerprints, not its connections.
    tls = tls.distinct().groupBy(*FLOW).agg(
        F.sort_array(F.collect_set("sni")).alias("snis"), F.sort_array(F.collect_set("ja4")).alias("ja4s"))
    flows = conn.where(IP.is_lan("src")).groupBy(*FLOW, F.lower("proto").alias("proto")).agg(
        F.sum(F.coalesce("duration", F.lit(0.0))).alias("duration_sec"),
        F.sum(F.coalesce("orig_ip_bytes", F.lit(0)) + F.coalesce("resp_ip_bytes", F.lit(0))).alias("ip_bytes"))
    j = flows.join(tls.withColumn("_tls", F.lit(True)), FLOW, "left")
    by_name = F.coalesce("_tls", F.lit(False))
    j = drop_devices(j.where(by_name | IP.in_cidrs("dst", cidrs)), registry)
    none = F.array().cast("array<string>")
    tcp = F.col("proto") == "tcp"
    return j.select(
        *FLOW, "proto", "duration_sec", "ip_bytes", F.coalesce(F.when(tcp, F.col("snis")), none).alias("snis"),
        F.coalesce(F.when(tcp, F.col("ja4s")), none).alias("ja4s"), F.when(by_name, "sni").otherwise("cidr").alias("via"))


def signals(
    flows: DataFrame, baseline: DataFrame, max_hours: float = C.RELAY_MAX_HOURS, min_kbps: float = C.RELAY_MIN_KBPS,
    min_seconds: float = C.RELAY_MIN_SECONDS,
) -> DataFrame:
    """Flows of known devices with at least one signal: new-JA4, long-flow, low-bw.

    ``baseline(src, ja4s, first_seen, last_seen, seeded)``; a device's first day only seeds.
    """
    known = baseline.select("src", F.col("ja4s").alias("_known"), "seeded")
    j = flows.join(known, "src").where(F.col("seeded"))
    hashes = F.filter(F.transform("_known", J.cipher_hash), lambda h: h != "")
    j = j.withColumn("_hashes", hashes).withColumn(
        "new_ja4s", F.filter("ja4s", lambda x: ~F.array_contains("_known", x) & ~F.array_contains("_hashes", J.cipher_hash(x))))
    long_flow = (F.col("duration_sec") > max_hours * 3600) & ~N.longpoll_only("snis")
    rate = F.col("ip_bytes") / F.greatest("duration_sec", F.lit(1.0))
    low_bw = (F.col("proto") == "udp") & (F.col("duration_sec") >= min_seconds) & (rate < min_kbps * 1000 / 8)
    fired = F.array_compact(F.array(
        F.when(long_flow, F.lit("long-flow")), F.when(low_bw, F.lit("low-bw")), F.when(F.size("new_ja4s") > 0, F.lit("new-JA4"))))
    j = j.withColumn("signals", fired).where(F.size("signals") > 0)
    n = F.size("signals")
    return j.withColumn("severity", F.when(n >= 3, "high").when(n >= 2, "medium").otherwise("low")).withColumn(
        "kbps", rate * 8 / 1000).drop("_known", "_hashes", "seeded")


def alerts(found: DataFrame, cap: int = C.RELAY_ALERTS_PER_DEVICE) -> DataFrame:
    """Alert events: an unknown TLS stack plus another signal, at most ``cap`` per device and day.

    The cap limits pages only; all findings stay in the report. Strongest first.
    """
    strong = found.where(F.array_contains("signals", "new-JA4") & (F.size("signals") >= 2))
    order = [F.desc(F.size("signals")), F.desc("duration_sec"), "dst", "dst_port", "proto"]
    capped = strong.withColumn("_n", F.row_number().over(Window.partitionBy("day", "src").orderBy(*order))).where(F.col("_n") <= cap)
    detail = F.concat(
        F.lit("Relay anomaly on "), "dst", F.lit(":"), F.col("dst_port").cast("string"), F.lit("/"), "proto", F.lit(": "),
        F.array_join("signals", "+"), F.lit(" (via "), "via", F.lit(")"))
    return capped.select("day", F.lit("teams_relay_anomaly").alias("type"), "severity", F.col("src").alias("device"), detail.alias("detail"))


def update_baseline(flows: DataFrame, baseline: DataFrame | None, today) -> DataFrame:
    """Per device: union of fingerprints, first and last day; seeded once first seen before ``today``.

    Devices without any fingerprint are recorded as well.
    """
    today = F.lit(today).cast("date")
    now = flows.select("src", F.explode_outer("ja4s").alias("ja4"), today.alias("first_seen"), today.alias("last_seen"), F.lit(False).alias("seeded"))
    if baseline is not None:
        old = baseline.select("src", F.explode_outer("ja4s").alias("ja4"), "first_seen", "last_seen", "seeded")
        now = now.unionByName(old)
    merged = now.distinct().groupBy("src").agg(
        F.sort_array(F.collect_set("ja4")).alias("ja4s"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.max("seeded").alias("_s"))
    return merged.select("src", "ja4s", "first_seen", "last_seen", (F.col("_s") | (F.col("first_seen") < today)).alias("seeded"))
