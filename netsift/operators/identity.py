"""Who a destination is, and what was looked up around a watched domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ip as IP
from ..functions import names as N
from .network import top_per
from .ranges import with_ranges

# source name -> priority, best first
_PRIORITY = {"SNI": 1, "DNS": 2, "cert": 3, "HTTP": 4}


def identify(ssl: DataFrame, dns: DataFrame, http: DataFrame, today) -> DataFrame:
    """Name per destination: newest SNI, else DNS answer, else certificate CN, else HTTP host.

    A source whose newest name is an address literal gives nothing (the next source decides). One
    shuffle: all four sources are folded by (dst, source) together.
    """
    pick = lambda df, dst, name, kind: df.select(
        F.col(dst).alias("dst") if isinstance(dst, str) else dst.alias("dst"), F.lit(kind).alias("source"), "ts", name.alias("name")
    ).where(F.coalesce("name", F.lit("")) != "")
    answers = dns.select("ts", "query", F.explode("answers").alias("answer"))
    rows = reduce(DataFrame.unionByName, [
        pick(ssl, "dst", F.col("server_name"), "SNI"), pick(answers, "answer", F.col("query"), "DNS"),
        pick(ssl, "dst", F.col("server_subject"), "cert"), pick(http, "dst", F.col("host"), "HTTP"),
    ])
    newest = rows.groupBy("dst", "source").agg(F.max(F.struct("ts", "name")).alias("_n"), F.max("ts").alias("seen"))
    name = F.when(F.col("source") == "cert", N.subject_cn("_n.name")).otherwise(F.col("_n.name"))
    rank = F.create_map(*[F.lit(x) for kv in _PRIORITY.items() for x in kv])[F.col("source")]
    usable = newest.select("dst", "source", name.alias("name"), "seen", rank.alias("rank")).where(
        (F.col("name") != "") & ~IP.looks_v4("name") & (F.col("name") != F.col("dst"))
    )
    best = usable.groupBy("dst").agg(F.min(F.struct("rank", "name", "source", "seen")).alias("_b"))
    return best.select(
        "dst", "_b.name", "_b.source", F.datediff(F.lit(today).cast("date"), F.to_date("_b.seen")).alias("when_days")
    )


def watched_events(ssl: DataFrame, dns: DataFrame, domain: str) -> DataFrame:
    """Distinct (second, src, kind) at which a source touched the domain (substring match)."""
    domain = domain.lower()
    hit = lambda df, c, kind: df.where(F.lower(c).contains(domain)).select(
        F.unix_timestamp("ts").alias("sec"), "src", F.lit(kind).alias("kind")
    )
    return hit(ssl, "server_name", "ssl").unionByName(hit(dns, "query", "dns")).distinct()


def domain_minutes(ssl: DataFrame, dns: DataFrame, domain: str) -> DataFrame:
    """Events per minute and source; a minute's count is the sum over its sources."""
    minute = (F.floor(F.col("sec") / 60) * 60).cast("bigint")
    return watched_events(ssl, dns, domain).groupBy(minute.alias("minute"), "src").agg(F.count("*").alias("n"))


def domain_pairs(ssl: DataFrame, dns: DataFrame, domain: str, top: int = 8) -> DataFrame:
    """Other names the same source looked up within one second of an event, top eight per minute.

    The interval is three whole seconds, so it is an equality join on (src, second).
    """
    events = watched_events(ssl, dns, domain).withColumn("near", F.explode(F.array(F.col("sec") - 1, F.col("sec"), F.col("sec") + 1)))
    lookups = dns.where(~F.lower("query").contains(domain.lower()) & (F.col("query") != "")).select(
        "src", F.unix_timestamp("ts").alias("near"), F.col("query").alias("host")
    ).distinct()
    return top_hosts(events.join(lookups, ["src", "near"]).select("sec", "src", "kind", "host").distinct(), top)


def top_hosts(hosts: DataFrame, top: int) -> DataFrame:
    """The names most often seen near an event, per minute; ``hosts(sec, src, kind, host)``, distinct."""
    minute = (F.floor(F.col("sec") / 60) * 60).cast("bigint")
    counts = hosts.groupBy(minute.alias("minute"), "host").agg(F.count("*").alias("n"))
    return top_per(counts, ["minute"], [F.desc("n"), "host"], top).drop("place")


def domain_addresses(dns: DataFrame, domain: str, since) -> DataFrame:
    """Addresses recent answers gave for the domain; non-addresses are dropped."""
    rows = dns.where(F.lower("query").contains(domain.lower()) & (F.col("ts") >= F.lit(since).cast("timestamp")))
    return rows.select(F.explode("answers").alias("ip")).where(IP.ip_bits("ip").isNotNull()).distinct()


def annotate(df: DataFrame, dest: str, geo: DataFrame) -> DataFrame:
    """``dest_label``: bare addresses with owner, city and country."""
    wide = with_ranges(df, dest, geo, ["org", "city", "cc"])
    return wide.withColumn("dest_label", N.annotate_dest(dest, "org", "city", "cc")).drop("org", "city", "cc")
