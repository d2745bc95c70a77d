"""Daily panels over flow, TLS, DNS, ARP and anomaly logs.

Every panel is keyed by ``day``: one day's rows give that day's panel, a longer table gives a
panel per day in one job. Per-day top lists are ranked with a limit Spark applies before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import ip as IP
from ..functions import names as N
from .ranges import with_ranges
from .suppress import Registry, drop_devices, keep_unsuppressed


def top_per(df: DataFrame, by: list[str], order: list, k: int, rank: str = "place") -> DataFrame:
    """First ``k`` rows per group in the given (total) order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def exfil(conn: DataFrame, geo: DataFrame, registry: Registry, min_mb: float = C.EXFIL_MIN_MB, top: int = 20) -> DataFrame:
    """Devices that sent much to owners not known as safe, with the destination of the largest flow."""
    flows = conn.where(F.col("src_local") & ~F.col("dst_local") & (F.col("orig_ip_bytes") > 0))
    pairs = flows.groupBy("day", "src", "dst").agg(
        F.sum("orig_ip_bytes").alias("bytes"), F.count("*").alias("conns"), F.max("orig_ip_bytes").alias("largest")
    )
    pairs = drop_devices(with_ranges(pairs, "dst", geo, ["org"], ips=flows), registry).where(~N.is_safe_org("org"))
    devices = pairs.groupBy("day", "src").agg(
        F.sum("bytes").alias("total_bytes"), F.sum("conns").alias("conns"),
        F.max(F.struct("largest", "dst")).alias("_top"),
    ).where(F.col("total_bytes") >= int(min_mb * 1_000_000))
    return top_per(devices, ["day"], [F.desc("total_bytes"), "src"], top).select(
        "day", "src", "total_bytes", "conns", F.col("_top.dst").alias("top_dst")
    )


def night(conn: DataFrame, registry: Registry, zone: str = "UTC", min_conns: int = C.NIGHT_MIN_CONNS, top: int = 20) -> DataFrame:
    """Devices active between 01:00 and 05:59 local time."""
    hour = F.hour(F.from_utc_timestamp("ts", zone))
    flows = conn.where(
        F.col("src_local") & ~F.col("dst_local") & hour.between(C.NIGHT_FIRST_HOUR, C.NIGHT_LAST_HOUR)
    )
    bytes_ = F.greatest(F.coalesce("orig_ip_bytes", F.lit(0)), F.lit(0))
    pairs = flows.groupBy("day", "src", "dst").agg(F.count("*").alias("conns"), F.sum(bytes_).alias("bytes"))
    devices = drop_devices(pairs, registry).groupBy("day", "src").agg(
        F.sum("conns").alias("conns"), F.sum("bytes").alias("bytes"), F.count("*").alias("unique_dsts")
    ).where(F.col("conns") >= min_conns)
    return top_per(devices, ["day"], [F.desc("conns"), "src"], top).drop("place")


def dns_anomalies(dns: DataFrame, registry: Registry, top: int = 20) -> DataFrame:
    """Devices with many failed look-ups or random-looking names, with up to five examples."""
    q = dns.where(IP.is_lan("src") & (F.coalesce(F.col("query"), F.lit("-")) != "-") & (F.col("query") != ""))
    q = drop_devices(q.where(~N.is_lookup_noise("query")), registry)
    forward = F.col("qtype_name").isin("A", "AAAA")
    names = q.groupBy("day", "src", "query").agg(
        F.count("*").alias("n"), F.count_if(F.upper("rcode_name") == "NXDOMAIN").alias("nx"),
        F.min(F.when(forward, F.col("ts"))).alias("first_ts"),
    )
    totals = names.groupBy("day", "src").agg(F.sum("n").alias("total"), F.sum("nx").alias("nxdomain"))
    random_ = names.where(F.col("first_ts").isNotNull() & ~N.is_safe_name("query")).withColumn(
        "entropy", N.sld_entropy("query")
    ).where(F.col("entropy") >= C.ENTROPY_MIN_BITS)
    random_ = keep_unsuppressed(random_, registry, domains=["query"])
    examples = top_per(random_, ["day", "src"], ["first_ts", "query"], 5).groupBy("day", "src").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "query"))), lambda x: x["query"]), ", ").alias("examples")
    )
    joined = totals.join(examples, ["day", "src"], "left")
    share = F.col("nxdomain") / F.col("total")
    failing = (F.col("total") >= C.NXDOMAIN_MIN_QUERIES) & (share >= C.NXDOMAIN_MIN_SHARE)
    looks_random = F.col("examples").isNotNull()
    flag = F.when(failing & looks_random, "both").when(failing, "nxdomain").otherwise("entropy")
    found = joined.where(failing | looks_random).select(
        "day", "src", "total", "nxdomain", (share * 100).alias("nxdomain_pct"), flag.alias("flag"),
        F.coalesce("examples", F.lit("")).alias("examples"),
    )
    return top_per(found, ["day"], [F.desc("nxdomain_pct"), F.desc("total"), "src"], top).drop("place")


def tls_issues(ssl: DataFrame, geo: DataFrame, registry: Registry) -> DataFrame:
    """Issue counts per (day, src, dst, issue) with the destination's owner."""
    rows = ssl.where(IP.is_lan("src") & ~IP.is_lan("dst") & F.col("established"))
    name = N.blank_to_null("server_name")
    status = F.lower(F.coalesce("validation_status", F.lit("")))
    issues = F.array_compact(F.array(
        F.when(name.isNull(), F.lit("no-sni")),
        F.when(status.contains("self signed"), F.lit("self-signed")), F.when(status.contains("expired"), F.lit("expired")),
    ))
    counted = (
        rows.withColumn("server_name", name).withColumn("issue", F.explode(issues))
        .groupBy("day", "src", "dst", "server_name", "issue").agg(F.count("*").alias("n"))
    )
    kept = keep_unsuppressed(drop_devices(counted, registry), registry, domains=["dst", "server_name"])
    owned = with_ranges(kept.groupBy("day", "src", "dst", "issue").agg(F.sum("n").alias("n")), "dst", geo, ["org"], ips=rows)
    owned = owned.where((F.col("issue") != "no-sni") | ~N.is_safe_org("org"))
    return owned.withColumn("org", F.when(F.col("org") != "", F.col("org")).otherwise("Unknown"))


def _issue_rank() -> Column:
    rank = F.create_map(*[F.lit(x) for kv in C.TLS_ISSUE_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(rank, F.col("issue")), F.lit(9))


def tls_anomalies(issues: DataFrame, top: int = 50) -> DataFrame:
    """Per source the (owner, issue) entries; sources with the worst issue and most rows first."""
    entries = issues.groupBy("day", "src", "org", "issue").agg(
        F.sum("n").alias("count"), F.count("*").alias("n_ips"),
        F.max(F.struct("n", "dst")).alias("_top"),
    ).withColumn("rank", _issue_rank())
    source = Window.partitionBy("day", "src")
    ranked = entries.withColumn("worst", F.min("rank").over(source)).withColumn("src_total", F.sum("count").over(source))
    place = F.dense_rank().over(Window.partitionBy("day").orderBy("worst", F.desc("src_total"), "src"))
    return ranked.withColumn("src_place", place).where(F.col("src_place") <= top).select(
        "day", "src", "src_place", "org", "issue", "count", "n_ips", F.col("_top.dst").alias("top_ip")
    )


def weird(events: DataFrame, registry: Registry, top: int = 30) -> DataFrame:
    """Protocol oddities by name: count, inside sources (three shown), first detail."""
    rows = events.where(F.coalesce(F.col("name"), F.lit("-")).isin("-", "") == F.lit(False))
    per_src = rows.groupBy("name", "src").agg(F.count("*").alias("n"), F.min(F.struct("ts", "addl")).alias("first"))
    inside = drop_devices(per_src.where(IP.is_lan("src")), registry).select("name", "src")
    shown = top_per(inside, ["name"], ["src"], 3).groupBy("name").agg(
        F.array_join(F.sort_array(F.collect_list("src")), ", ").alias("srcs")
    )
    counts = inside.groupBy("name").agg(F.count("*").alias("src_count"))
    names = per_src.groupBy("name").agg(F.sum("n").alias("count"), F.min("first").alias("_f"))
    best = names.orderBy(F.desc("count"), "name").limit(top)
    return best.join(counts, "name", "left").join(shown, "name", "left").select(
        "name", "count", F.coalesce("src_count", F.lit(0)).alias("src_count"), F.coalesce("srcs", F.lit("—")).alias("srcs"),
        F.substring(F.when(F.coalesce("_f.addl", F.lit("")) != "", F.col("_f.addl")).otherwise("—"), 1, 60).alias("addl"),
    )


def l2_anomalies(arp: DataFrame, fp_macs: DataFrame, gateway_ip: str, own_macs: list[str], last_bad: int = 20) -> DataFrame:
    """Foreign gateway claims (critical), addresses claimed by several MACs (warning), malformed ARP (info)."""
    own = [m.lower() for m in own_macs]
    a = arp.select("event_id", "ts", "day", "operation", F.lower("src_mac").alias("mac"), F.trim("src_ip").alias("ip"), "info")
    claims = a.where(
        (F.col("operation") != "bad") & (F.coalesce(F.col("mac"), F.lit("")) != "") & IP.is_lan("ip")
    ).select("day", "ip", "mac").distinct()
    rogue = claims.where((F.col("ip") == gateway_ip) & ~F.col("mac").isin(own)).select(
        "day", F.lit("gateway_impersonation").alias("kind"), F.lit("critical").alias("severity"), "ip", "mac",
        F.format_string("MAC %s announced as gateway %s", "mac", "ip").alias("detail"),
    )
    listed = fp_macs.select(F.lower("mac").alias("mac")).distinct().withColumn("_fp", F.lit(True))
    shared = (
        claims.where(F.col("ip") != gateway_ip).join(listed, "mac", "left")
        .groupBy("day", "ip").agg(
            F.count("*").alias("n"), F.count_if(~F.col("mac").isin(own)).alias("foreign"), F.count("_fp").alias("listed"),
            F.min("mac").alias("mac"),
        ).where("n >= 2 and foreign > 0 and listed = 0")
        .select("day", F.lit("mac_change").alias("kind"), F.lit("warning").alias("severity"), "ip", "mac",
                F.format_string("%d distinct MACs claiming %s today", "n", "ip").alias("detail"))
    )
    bad = top_per(a.where("operation = 'bad'"), ["day"], [F.desc("ts"), F.desc("event_id")], last_bad).select(
        "day", F.lit("bad_arp").alias("kind"), F.lit("info").alias("severity"), "ip", "mac",
        F.when(F.coalesce("info", F.lit("")) != "", F.col("info")).otherwise("malformed ARP").alias("detail"),
    )
    return rogue.unionByName(shared).unionByName(bad)


def intel_counts(panels: dict[str, DataFrame]) -> DataFrame:
    """Sizes of the panels and their total, as ``(panel, n)``."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("panel"), "n") for name, df in panels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(out.agg(F.sum("n").alias("n")).select(F.lit("total").alias("panel"), "n"))
