"""Which outside addresses to look up, and what the lists say about the cached ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import ip as IP
from ..functions.flags import intel_severity
from .ranges import lookup


def targets(findings: DataFrame, alerts: DataFrame, today, days: int = C.INTEL_LOOKBACK_DAYS) -> DataFrame:
    """Public destinations of the last days: age of the newest sighting and the largest daily count.

    An address only alerts know counts as seen today, once.
    """
    today = F.lit(today).cast("date")
    recent = lambda df: df.where((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today))
    daily = recent(findings).where(IP.is_public_v4("dst")).groupBy(F.col("dst").alias("ip"), "day").agg(F.count("*").alias("n"))
    found = daily.groupBy("ip").agg(F.datediff(today, F.max("day")).alias("age"), F.max("n").alias("n"))
    hits = recent(alerts).select(F.col("dst_ip").alias("ip")).where(IP.is_public_v4("ip")).distinct().join(found, "ip", "left_anti")
    return found.unionByName(hits.select("ip", F.lit(0).alias("age"), F.lit(1).cast("bigint").alias("n")))


def stale(ranked: DataFrame, cache: DataFrame, today, cap: int = C.INTEL_MAX_PER_RUN) -> DataFrame:
    """The next look-ups: no record, an old or a partial one; newest and busiest first.

    The cap is the run's request budget; what is left over stays stale and leads the next run.
    """
    cutoff = F.date_sub(F.lit(today).cast("date"), C.INTEL_TTL_DAYS)
    fresh = cache.where((F.col("fetched") >= cutoff) & F.col("has_scan") & F.col("has_abuse")).select("ip")
    return ranked.join(fresh, "ip", "left_anti").orderBy("age", F.desc("n"), "ip").limit(cap)


def restamp(cache: DataFrame, blocklist: DataFrame, exits: DataFrame) -> DataFrame:
    """Every cached address with today's blocklist entry (first in list order) and exit status."""
    sbl = F.when(F.col("sbl") != "", F.col("sbl")).otherwise("DROP")
    listed = lookup(cache, "ip", blocklist, ["sbl"], "first").select("ip", sbl.alias("sbl"))
    exit_ = exits.select("ip").distinct().withColumn("exit_node", F.lit(True))
    return cache.join(listed, "ip", "left").join(exit_, "ip", "left").withColumn(
        "exit_node", F.coalesce("exit_node", F.lit(False))).withColumn("listed", F.col("sbl").isNotNull())


def badges(stamped: DataFrame) -> DataFrame:
    level = intel_severity("abuse_score", "tags", "n_vulns", "n_ports", "listed", "exit_node")
    return stamped.select("ip", level.alias("badge"))


def evidence() -> Column:
    """What a badge rests on, as one line; the columns are those of :func:`restamp`."""
    num = lambda c, text: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, text)
    told = F.concat_ws(
        "; ", F.when(F.col("listed"), F.concat(F.lit("block list "), "sbl")), F.when(F.col("exit_node"), "exit node"),
        num("abuse_score", F.concat(F.lit("abuse "), F.col("abuse_score").cast("string"), F.lit("/100"))),
        F.when(F.size("tags") > 0, F.concat(F.lit("tags "), F.array_join("tags", ", "))),
        num("n_vulns", F.concat(F.lit("known flaws "), F.col("n_vulns").cast("string"))),
        num("n_ports", F.concat(F.lit("open ports "), F.col("n_ports").cast("string"))))
    return F.when(told == "", "nothing known").otherwise(told)


def rated(rows: DataFrame, stamped: DataFrame, **sides: str) -> DataFrame:
    """``rows`` (findings, alerts, candidates) with what the cache says about their outside addresses.

    ``sides`` names the new columns by the column of the address: ``rated(alerts, stamped, dst_ip="dst")`` adds
    ``dst_badge`` and ``dst_evidence``. Both are null for inside addresses, for addresses that were never looked up, and
    where a record has neither look-up nor list entry. Of several records of an address the newest counts.
    """
    newest = stamped.groupBy("ip").agg(F.max(F.struct("fetched", *[c for c in stamped.columns if c not in ("ip", "fetched")])).alias("_r")).select("ip", "_r.*")
    known = F.coalesce("has_scan", F.lit(False)) | F.coalesce("has_abuse", F.lit(False)) | F.col("listed") | F.col("exit_node")
    level = intel_severity("abuse_score", "tags", "n_vulns", "n_ports", "listed", "exit_node")
    told = newest.where(known).where(~IP.is_lan("ip")).select("ip", level.alias("_badge"), evidence().alias("_evidence"))
    for address, name in sides.items():
        side = told.select(F.col("ip").alias("_ip"), F.col("_badge").alias(f"{name}_badge"), F.col("_evidence").alias(f"{name}_evidence"))
        rows = rows.join(side, F.trim(F.col(address)) == F.col("_ip"), "left").drop("_ip")
    return rows


def collect_garbage(cache: DataFrame, ranked: DataFrame, today, days: int = C.INTEL_GC_DAYS) -> DataFrame:
    """The cache without records that are old and no longer wanted."""
    cutoff = F.date_sub(F.lit(today).cast("date"), days)
    wanted = ranked.select("ip", F.lit(True).alias("_w"))
    return cache.join(wanted, "ip", "left").where((F.col("fetched") >= cutoff) | F.col("_w")).drop("_w")
