"""Per-day beacon scoring. Weights and thresholds are fixed; the formulas are this package's own.

beacon score = weighted mean of four parts in [0, 1]:
  timing     1 - min(1, MAD(gaps) / median(gaps)) averaged with 1 - |Bowley skew of the gaps|
  size       the same two terms over the bytes sent per connection
  duration   min(1, hours between first and last connection / 12); 0 below 6 hours
  histogram  1 - min(1, coefficient of variation of the connections per active hour)
Gaps are taken between distinct seconds, so a pair has at most 86,400 points per day however many
flows it owns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import names as N
from ..functions.flags import level_of
from .quantiles import with_quantiles

PAIR = ["day", "src", "dst"]


def scored_flows(conn: DataFrame) -> DataFrame:
    """Inside-to-outside flows; outside-to-inside is never scored."""
    return conn.where(F.col("src_local") & ~F.col("dst_local"))


def _regularity(median: Column, q1: Column, q3: Column, mad: Column) -> Column:
    spread = F.when(median > 0, F.least(mad / median, F.lit(1.0))).otherwise(F.when(mad > 0, 1.0).otherwise(0.0))
    skew = F.when(q3 != q1, F.abs((q1 + q3 - 2 * median) / (q3 - q1))).otherwise(0.0)
    return ((1 - spread) + (1 - skew)) / 2


def _quartiles(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """Median, quartiles and median absolute deviation of ``value`` (weighted by ``n``) per pair."""
    mid = with_quantiles(df, PAIR, value, {"med": 0.5, "q1": 0.25, "q3": 0.75})
    dev = mid.withColumn("_d", F.abs(F.col(value) - F.col("med")))  # the rows of a pair are together already
    per = with_quantiles(dev, PAIR, "_d", {"mad": 0.5}).groupBy(*PAIR).agg(*[F.max(c).alias(c) for c in ("med", "q1", "q3", "mad")])
    return per.select(*PAIR, _regularity(F.col("med"), F.col("q1"), F.col("q3"), F.col("mad")).alias(prefix))


def beacon_scores(conn: DataFrame) -> DataFrame:
    """Score, its four parts and its severity per (day, src, dst) with at least four distinct seconds."""
    flows = scored_flows(conn).select(*PAIR, F.unix_timestamp("ts").alias("sec"), F.col("orig_ip_bytes").alias("size"))
    seconds = flows.groupBy(*PAIR, "sec").agg(F.count("*").alias("n"))
    span = seconds.groupBy(*PAIR).agg(
        F.count("*").alias("points"), F.sum("n").alias("conns"), ((F.max("sec") - F.min("sec")) / 3600.0).alias("hours"))
    span = span.where(F.col("points") >= C.SCORE_MIN_UNIQUE)
    gap = F.col("sec") - F.lag("sec").over(Window.partitionBy(*PAIR).orderBy("sec"))
    gaps = seconds.withColumn("gap", gap).where("gap is not null").groupBy(*PAIR, "gap").agg(F.count("*").alias("n"))
    sizes = flows.groupBy(*PAIR, "size").agg(F.count("*").alias("n"))
    per_hour = seconds.groupBy(*PAIR, F.floor(F.col("sec") / 3600).alias("hour")).agg(F.sum("n").alias("n"))
    histogram = per_hour.groupBy(*PAIR).agg((1 - F.least(F.stddev_pop("n") / F.avg("n"), F.lit(1.0))).alias("histogram"))
    duration = F.when(F.col("hours") >= C.SCORE_MIN_HOURS, F.least(F.col("hours") / C.SCORE_IDEAL_HOURS, F.lit(1.0))).otherwise(0.0)
    j = (
        span.withColumn("duration", duration).join(_quartiles(gaps, "gap", "timing"), PAIR)
        .join(_quartiles(sizes, "size", "size"), PAIR).join(histogram, PAIR)
    )
    score = sum((F.col(part) * w for part, w in C.SCORE_WEIGHTS.items()), F.lit(0.0))
    return j.withColumn("score", score).withColumn("severity", level_of(F.round(score * 100, 6), C.SCORE_LEVELS)).select(
        *PAIR, "conns", *C.SCORE_WEIGHTS, "score", "severity")


def long_connections(conn: DataFrame) -> DataFrame:
    """Total connection time per pair and its level."""
    total = scored_flows(conn).groupBy(*PAIR).agg(F.sum("duration").alias("seconds"), F.max("duration").alias("longest"))
    return total.withColumn("level", level_of("seconds", C.LONG_CONN_LEVELS)).where("level <> 'none'")


def c2_over_dns(dns: DataFrame, levels: dict = C.C2_DNS_LEVELS) -> DataFrame:
    """Distinct subdomains per registrable domain and day, with the level."""
    names = dns.where(~N.is_lookup_noise("query")).select("day", F.lower("query").alias("query")).distinct()
    per = names.groupBy("day", N.registrable_domain("query").alias("domain")).agg(F.count("*").alias("subdomains"))
    return per.withColumn("level", level_of("subdomains", levels))


def strobes(conn: DataFrame, threshold: int = C.STROBE_MIN_CONNS) -> DataFrame:
    """Pairs with very many connections in a day."""
    return scored_flows(conn).groupBy(*PAIR).agg(F.count("*").alias("conns")).where(F.col("conns") >= threshold)


def threat_hits(conn: DataFrame, feed: DataFrame) -> DataFrame:
    """Pairs whose destination is on the feed; +0.15 from 25 MB."""
    totals = scored_flows(conn).groupBy(*PAIR).agg(F.sum(F.col("orig_ip_bytes") + F.col("resp_ip_bytes")).alias("bytes"))
    hits = totals.join(feed.select(F.col("ip").alias("dst")).distinct(), "dst", "left_semi")
    return hits.select(*PAIR, "bytes", F.when(F.col("bytes") >= C.THREAT_BYTES, C.THREAT_INCREASE).otherwise(0.0).alias("modifier"))


def prevalence(conn: DataFrame) -> DataFrame:
    """Share of the day's inside hosts that contact a destination; rare +0.15, common -0.15."""
    pairs = scored_flows(conn).select(*PAIR).distinct()
    hosts = pairs.select("day", "src").distinct().groupBy("day").agg(F.count("*").alias("hosts"))
    share = pairs.groupBy("day", "dst").agg(F.count("*").alias("srcs")).join(hosts, "day")
    value = F.col("srcs") / F.col("hosts")
    step = F.when(value <= C.PREVALENCE_LOW, C.PREVALENCE_STEP).when(value >= C.PREVALENCE_HIGH, -C.PREVALENCE_STEP).otherwise(0.0)
    return share.select("day", "dst", value.alias("prevalence"), step.alias("modifier"))


def first_seen(conn: DataFrame, today) -> DataFrame:
    """Days since a destination was first seen; new +0.15, old -0.15."""
    first = scored_flows(conn).groupBy("dst").agg(F.min("day").alias("first_day"))
    age = F.datediff(F.lit(today).cast("date"), F.col("first_day"))
    step = F.when(age <= C.FIRST_SEEN_NEW_DAYS, C.FIRST_SEEN_STEP).when(age >= C.FIRST_SEEN_OLD_DAYS, -C.FIRST_SEEN_STEP).otherwise(0.0)
    return first.select("dst", age.alias("age_days"), step.alias("modifier"))


def http_modifiers(http: DataFrame, mime_types: DataFrame) -> DataFrame:
    """Per pair: requests without host (+0.10), a user agent only one source uses (+0.15), a path whose
    extension belongs to another MIME type than the one answered (+0.15). ``mime_types(mime, ext)``."""
    ext = F.lower(F.regexp_extract("uri", r"(\.[A-Za-z0-9]+)$", 1))
    rows = http.withColumn("ext", ext)
    known = mime_types.groupBy("ext").agg(F.collect_set("mime").alias("_mimes"))
    agents = http.where("user_agent <> ''").select("user_agent", "src").distinct().groupBy("user_agent").agg(F.count("*").alias("users"))
    per = rows.groupBy(*PAIR, "user_agent", "ext", "mime").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("host", F.lit("")) == "").alias("no_host"))
    per = per.join(known, "ext", "left").join(agents, "user_agent", "left")
    mismatch = F.col("_mimes").isNotNull() & ~F.array_contains("_mimes", F.col("mime"))
    folded = per.groupBy(*PAIR).agg(
        F.sum("no_host").alias("no_host"), F.max(F.coalesce(F.col("users") == 1, F.lit(False))).alias("rare_agent"),
        F.max(F.coalesce(mismatch, F.lit(False))).alias("mime_mismatch"))
    step = lambda c, v: F.when(c, v).otherwise(0.0)
    modifier = step(F.col("no_host") > 0, C.MISSING_HOST_STEP) + step(F.col("rare_agent"), C.RARE_SIGNATURE_STEP) + step(
        F.col("mime_mismatch"), C.MIME_MISMATCH_STEP)
    return folded.withColumn("modifier", modifier)


def rare_signatures(ssl: DataFrame) -> DataFrame:
    """Pairs whose TLS fingerprint only one inside host uses (+0.15)."""
    users = ssl.select("ja4", "src").distinct().groupBy("ja4").agg(F.count("*").alias("users")).where("users = 1")
    return ssl.select(*PAIR, "ja4").distinct().join(users, "ja4", "left_semi").select(
        *PAIR, F.lit(C.RARE_SIGNATURE_STEP).alias("modifier")).distinct()


def direct_to_c2(conn: DataFrame, dns: DataFrame, suspects: DataFrame) -> DataFrame:
    """Pairs that connect straight to an address a C2-over-DNS domain resolved to (+0.15). ``suspects(domain)``."""
    answers = dns.select(N.registrable_domain("query").alias("domain"), F.explode("answers").alias("dst")).distinct()
    bad = answers.join(suspects.select("domain").distinct(), "domain", "left_semi").select("dst").distinct()
    return scored_flows(conn).select(*PAIR).distinct().join(bad, "dst", "left_semi").select(
        *PAIR, F.lit(C.C2_DIRECT_STEP).alias("modifier"))


def apply_modifiers(scores: DataFrame, *modifiers: tuple[DataFrame, list[str]]) -> DataFrame:
    """Final score: the beacon score plus all modifiers, kept in [0, 1]. Each modifier names its keys."""
    out, total = scores, F.col("score")
    for i, (table, keys) in enumerate(modifiers):
        name = f"_m{i}"
        per_key = table.groupBy(*keys).agg(F.sum("modifier").alias(name))
        out = out.join(per_key, keys, "left")
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    final = F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))
    drop = [f"_m{i}" for i in range(len(modifiers))]
    return out.withColumn("final_score", final).withColumn(
        "final_severity", level_of(F.round(F.col("final_score") * 100, 6), C.SCORE_LEVELS)).drop(*drop)


