"""Low-rate beacons that keep to a time of day over many days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import names as N
from ..session import checkpoint
from ..sources.windows import in_last_existing_days
from .ranges import lookup
from .skew import salted_semi
from .suppress import Registry, drop_devices, glob_lookup

PAIR = ["src", "dst", "dst_port"]


def egress(conn: DataFrame) -> DataFrame:
    """Flows from inside to outside that are worth profiling."""
    return conn.where(
        F.col("src_local") & ~F.col("dst_local") & F.col("proto").isin("tcp", "udp")
        & ~F.coalesce(F.col("service"), F.lit("")).isin("dns", "ntp")
    )


def pair_profile(conn: DataFrame, window_days: int | None = C.CADENCE_WINDOW_DAYS) -> DataFrame:
    """Per (src, dst, port): flows, distinct days and a 24-bin hour histogram over the window (None: every day).

    Two levels for a window of any length: first per pair and day, where flows are folded before the
    shuffle (so a pair with a third of all flows is one row a day and task), then days are counted.
    """
    flows = in_last_existing_days(egress(conn), window_days, of=conn).withColumn("hour", F.hour("ts"))
    hours = [F.count_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)]
    daily = flows.groupBy(*PAIR, "day").agg(F.count("*").alias("n"), *hours)
    return daily.groupBy(*PAIR).agg(
        F.sum("n").alias("total_conns"), F.count("day").alias("days_seen"), *[F.sum(f"h{h}").alias(f"h{h}") for h in range(24)]
    )


def slow_pairs(
    conn: DataFrame, window_days: int | None = C.CADENCE_WINDOW_DAYS, min_days: int = C.CADENCE_MIN_DAYS,
    max_per_day: int = C.CADENCE_MAX_PER_DAY,
) -> DataFrame:
    """Pairs seen on enough days at a low enough rate, with their hour consistency.

    ``hour_consistency`` is the share of flows within one hour (mod 24) of the modal hour, the
    earliest hour on ties.
    """
    profile = pair_profile(conn, window_days).where(
        (F.col("days_seen") >= min_days) & (F.col("total_conns") <= F.col("days_seen") * max_per_day)
    )
    bins = F.array(*[F.col(f"h{h}") for h in range(24)])
    mode = F.array_position(bins, F.array_max(bins)).cast("int") - 1
    near = sum(
        (F.get(F.col("_bins"), F.pmod(F.col("modal_hour") + d, F.lit(24))) for d in (0, 1)),
        F.get(F.col("_bins"), F.pmod(F.col("modal_hour") + 23, F.lit(24))),
    )
    return (
        profile.withColumn("_bins", bins)
        .withColumn("modal_hour", mode)
        .withColumn("hour_consistency", near / F.col("total_conns"))
        .select(*PAIR, "total_conns", "days_seen", "modal_hour", "hour_consistency")
    )


def interval_cv(conn: DataFrame, pairs: DataFrame, window_days: int | None = C.CADENCE_WINDOW_DAYS) -> DataFrame:
    """Coefficient of variation of the gaps between flows, for the pairs given.

    ``pairs`` comes out of :func:`slow_pairs`, so a pair has at most ``max_per_day`` flows per day
    and its sort is small. Busy pairs leave in the salted semi join.
    """
    flows = in_last_existing_days(egress(conn), window_days, of=conn)
    flows = flows.select(*PAIR, F.unix_timestamp("ts").alias("sec"))
    flows = salted_semi(flows, pairs, PAIR, F.col("sec"))
    previous = F.lag("sec").over(Window.partitionBy(*PAIR).orderBy("sec"))
    gaps = flows.withColumn("gap", F.col("sec") - previous)
    mean = F.avg("gap")
    cv = F.when((F.count("gap") >= 2) & (mean != 0), F.stddev_pop("gap") / mean)
    return gaps.groupBy(*PAIR).agg(cv.alias("interval_cv"))


def latest_sni(ssl: DataFrame) -> DataFrame:
    """Newest non-empty server name per destination (greatest name on equal times)."""
    return (
        ssl.where(F.coalesce(F.col("server_name"), F.lit("")) != "")
        .groupBy("dst").agg(F.max(F.struct("ts", "server_name")).alias("_m"))
        .select("dst", F.col("_m.server_name").alias("sni"))
    )


def http_profile(http: DataFrame) -> DataFrame:
    """Per destination: newest host, number of hosts, top user agent, top URI prefix, method mix.

    Every attribute becomes a ``(dst, kind, value)`` count first, so no destination's rows meet in
    one task before they are counted.
    """
    rows = http.where(F.coalesce(F.col("host"), F.lit("")) != "")
    method = F.when(F.col("method").isin("GET", "POST"), F.col("method")).otherwise("other")
    kinds = F.array(
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")),
        F.struct(F.lit("ua").alias("kind"), F.coalesce(F.col("user_agent"), F.lit("")).alias("value")),
        F.struct(F.lit("uri").alias("kind"), F.substring(F.coalesce(F.col("uri"), F.lit("")), 1, 60).alias("value")),
        F.struct(F.lit("method").alias("kind"), method.alias("value")),
    )
    counts = (
        rows.select("dst", "ts", F.explode(kinds).alias("_x"))
        .select("dst", "ts", "_x.kind", "_x.value")
        .groupBy("dst", "kind", "value").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    )
    is_kind = lambda k: F.col("kind") == k
    of_method = lambda m: F.sum(F.when(is_kind("method") & (F.col("value") == m), F.col("n")).otherwise(0))
    top = lambda k, cond: F.max(F.when(is_kind(k) & cond, F.struct("n", "value")))
    per_dst = counts.groupBy("dst").agg(
        F.max(F.when(is_kind("host"), F.struct("last_ts", "value"))).alias("_host"),
        F.count_if(is_kind("host")).alias("n_hosts"),
        top("ua", F.col("value") != "").alias("_ua"),
        top("uri", F.lit(True)).alias("_uri"),
        of_method("GET").alias("_get"), of_method("POST").alias("_post"), of_method("other").alias("_other"),
    )
    total = F.col("_get") + F.col("_post") + F.col("_other")
    share = lambda label, c: F.when(
        F.col(c) > 0, F.concat(F.lit(label + " "), F.floor(F.col(c) * 100 / total).cast("string"), F.lit("%"))
    )
    return per_dst.select(
        "dst", F.col("_host.value").alias("http_host"), "n_hosts",
        F.substring(F.coalesce(F.col("_ua.value"), F.lit("")), 1, 120).alias("http_useragent"),
        F.col("_uri.value").alias("http_uri_sample"),
        F.concat_ws(" · ", share("GET", "_get"), share("POST", "_post"), share("other", "_other")).alias("http_method_mix"),
    )


def lan_talkers(conn: DataFrame, window_days: int | None = C.CADENCE_WINDOW_DAYS) -> DataFrame:
    """Distinct inside sources per (dst, port). Counted distinct-first, so a popular service is spread by source."""
    flows = in_last_existing_days(egress(conn), window_days, of=conn)
    return flows.groupBy("dst", "dst_port").agg(F.countDistinct("src").alias("lan_talkers"))


def slow_candidates(
    conn: DataFrame, ssl: DataFrame, http: DataFrame, geo: DataFrame, registry: Registry,
    window_days: int | None = C.CADENCE_WINDOW_DAYS, min_consistency: float = C.CADENCE_MIN_CONSISTENCY, own_days: bool = True,
) -> DataFrame:
    """The full detector: regular pairs, named, owned, filtered and rated for paging.

    Names and web profiles come from the same days as the flows, or from the whole logs (not ``own_days``).
    """
    if own_days:
        ssl, http = (in_last_existing_days(log, window_days, of=conn) for log in (ssl, http))
    # The few regular pairs steer every later step, so they are computed once and written down.
    pairs = checkpoint(slow_pairs(conn, window_days).where(F.col("hour_consistency") >= min_consistency))
    dsts = pairs.select("dst").distinct()
    sni, owners = latest_sni(ssl), lookup(dsts, "dst", geo, ["org", "cc"])
    # Suppression is a property of the destination: its address, its newest server name, any host it
    # serves, or its owner. Each kind of name is tested on distinct values, then one anti join.
    hosts = http.where(F.coalesce(F.col("host"), F.lit("")) != "").select("dst", F.col("host").alias("name")).distinct()
    names = hosts.unionByName(sni.select("dst", F.col("sni").alias("name"))).unionByName(dsts.select("dst", F.col("dst").alias("name")))
    owner_names = owners.select("dst", F.col("org").alias("name"))
    bad = (
        glob_lookup(names, "name", registry.domains, ["dst"]).select("dst")
        .unionByName(glob_lookup(owner_names, "name", registry.orgs, ["dst"]).select("dst")).distinct()
    )
    kept = (
        drop_devices(pairs, registry).join(bad, "dst", "left_anti")
        .join(sni, "dst", "left").join(http_profile(http), "dst", "left").join(owners, "dst", "left")
        .join(lan_talkers(conn, window_days), ["dst", "dst_port"], "left")
    )
    talkers = F.coalesce(F.col("lan_talkers"), F.lit(1))
    hyper = N.is_hyperscaler_org("org")
    return (
        kept.join(interval_cv(conn, pairs, window_days), PAIR, "left")
        .select(
            *PAIR, F.coalesce("sni", F.lit("")).alias("sni"), F.coalesce("http_host", F.lit("")).alias("http_host"),
            F.coalesce("http_useragent", F.lit("")).alias("http_useragent"),
            F.coalesce("http_uri_sample", F.lit("")).alias("http_uri_sample"),
            F.coalesce("http_method_mix", F.lit("")).alias("http_method_mix"),
            "days_seen", "total_conns", (F.col("total_conns") / F.col("days_seen")).alias("conns_per_active_day"),
            "modal_hour", "hour_consistency", "interval_cv",
            F.coalesce("org", F.lit("")).alias("dst_org"), F.coalesce("cc", F.lit("")).alias("dst_cc"),
            hyper.alias("is_hyperscaler"), talkers.alias("lan_talkers"),
            ((talkers == 1) & ~hyper).alias("alert_eligible"),
        )
    )


def suspicion_order():
    """Longest persistence first, then the tightest cadence."""
    return [F.desc("days_seen"), F.asc_nulls_last("interval_cv"), *PAIR]


def pair_key():
    return F.concat_ws("|", "src", "dst", F.col("dst_port").cast("string"))


def new_pairs(candidates: DataFrame, known: DataFrame | None) -> DataFrame:
    """Candidates never seen before, with the gate's verdict; a run without state only seeds.

    ``known(pair)`` may carry old ``::ffff:`` keys.
    """
    keyed = candidates.withColumn("pair", pair_key())
    if known is None:
        keyed = keyed.limit(0)
    else:
        old = known.select(F.regexp_replace("pair", "::ffff:", "").alias("pair")).distinct()
        keyed = keyed.join(old, "pair", "left_anti")
    reason = F.when(F.col("alert_eligible"), "fire").when(F.col("is_hyperscaler"), "hyperscaler").otherwise("shared_lan")
    return keyed.withColumn("verdict", reason)


def pair_alerts(fresh: DataFrame) -> DataFrame:
    """Alert events for the new pairs that pass the gate."""
    target = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("sni", "http_host")], F.col("dst"))
    org = F.when(F.col("dst_org") != "", F.col("dst_org")).otherwise("unknown ASN")
    detail = F.concat(
        F.lit("Slow-cadence beacon: "), target, F.lit(":"), F.col("dst_port").cast("string"), F.lit(", "),
        F.col("days_seen").cast("string"), F.lit(" days, ~"), F.round("conns_per_active_day", 2).cast("string"),
        F.lit("/day at "), F.lpad(F.col("modal_hour").cast("string"), 2, "0"), F.lit(":00 UTC (hour-cons "),
        F.floor(F.round("hour_consistency", 3) * 100).cast("string"), F.lit("%) — sole LAN talker, ASN: "), org,
    )
    return fresh.where(F.col("verdict") == "fire").select(
        F.lit("slow_cadence_beacon").alias("type"), F.lit("medium").alias("severity"),
        F.col("src").alias("device"), F.substring(detail, 1, 240).alias("detail"),
    )


def remember_pairs(candidates: DataFrame, known: DataFrame | None) -> DataFrame:
    """The known-pair state after a run: the union, never smaller than before."""
    keys = candidates.select(pair_key().alias("pair"))
    if known is not None:
        keys = keys.unionByName(known.select(F.regexp_replace("pair", "::ffff:", "").alias("pair")))
    return keys.distinct()


def source_groups(candidates: DataFrame) -> DataFrame:
    """Candidates per source; most eligible first, then most candidates."""
    return candidates.groupBy("src").agg(
        F.count("*").alias("n_candidates"), F.countDistinct("dst").alias("n_dsts"),
        F.count_if("alert_eligible").alias("n_eligible"),
    ).orderBy(F.desc("n_eligible"), F.desc("n_candidates"), "src")


def source_rows(candidates: DataFrame) -> DataFrame:
    """Candidates source by source, eligible rows first (a range sort, so a busy source is split)."""
    return candidates.orderBy("src", F.desc("alert_eligible"), F.desc("days_seen"), F.asc_nulls_last("interval_cv"), "dst", "dst_port")


def hunt_digest(candidates: DataFrame, top: int = 10) -> DataFrame:
    """The day's reading list: candidates that do not page, longest and steadiest first."""
    return (
        candidates.where(~F.col("alert_eligible"))
        .orderBy(F.desc("days_seen"), F.desc("hour_consistency"), *PAIR).limit(top)
    )


def tile(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("total"), F.count_if("alert_eligible").alias("eligible"))
