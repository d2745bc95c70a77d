"""TLS client fingerprints: label look-up, inventory, history, threats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import ip as IP
from ..functions import ja4 as J
from ..sources.windows import in_calendar_window
from .network import top_per
from .suppress import Registry, drop_devices


def label_tables(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact, by cipher). The last row wins per fingerprint; a cipher hash counts only where all its rows agree."""
    rows = labels.where(F.col("ja4").contains("_")).withColumn("label", J.compose_label("app", "lib", "os"))
    exact = rows.groupBy("ja4").agg(F.max_by("label", "ord").alias("exact_label"))
    by_cipher = (
        rows.where(J.has_three_parts("ja4")).groupBy(J.cipher_hash("ja4").alias("cipher"))
        .agg(F.min("label").alias("cipher_label"), F.max("label").alias("_max"))
        .where(F.col("cipher_label") == F.col("_max")).drop("_max")
    )
    return exact, by_cipher


def classify(prints: DataFrame, labels: DataFrame) -> DataFrame:
    """``label``, ``source`` and ``is_threat`` per distinct fingerprint: exact, cipher family, shape, unknown."""
    exact, by_cipher = label_tables(labels)
    d = prints.select("ja4").distinct().withColumn(
        "cipher", F.when(J.has_three_parts("ja4"), J.cipher_hash("ja4"))
    )
    d = d.join(exact, "ja4", "left").join(by_cipher, "cipher", "left").withColumn("_shape", J.shape_label("ja4"))
    label = F.coalesce("exact_label", F.concat("cipher_label", F.lit(" (cipher-family)")), "_shape", F.lit("Unknown TLS client"))
    source = (
        F.when(F.col("exact_label").isNotNull(), "ja4db").when(F.col("cipher_label").isNotNull(), "ja4db-cipher")
        .when(F.col("_shape").isNotNull(), "heuristic").otherwise("unknown")
    )
    threat = F.when(F.col("exact_label").isNotNull(), J.is_threat_label("exact_label")).when(
        F.col("cipher_label").isNotNull(), J.is_threat_label("cipher_label")
    ).otherwise(False)
    return d.select("ja4", label.alias("label"), source.alias("source"), threat.alias("is_threat"))


def wan_prints(ssl: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Fingerprint counts per (day, src, ja4) from inside to outside."""
    rows = ssl.where(
        IP.is_lan("src") & ~IP.is_lan("dst") & ~F.coalesce(F.trim("ja4"), F.lit("")).isin("", "-")
    )
    counts = rows.groupBy("day", "src", "ja4").agg(F.count("*").alias("n"))
    return drop_devices(counts, registry) if registry else counts


def modal_print(ssl: DataFrame, pairs: DataFrame, today=None, days: int = C.JA4_LOOKBACK_DAYS) -> DataFrame:
    """Most common fingerprint per (src, flag) over the destinations in ``pairs(src, flag, dst)``.

    With ``today`` only the last ``days`` days of the log count.
    """
    if today is not None:
        ssl = in_calendar_window(ssl, days, today)
    counts = ssl.where(~F.coalesce("ja4", F.lit("")).isin("", "-")).groupBy("src", "dst", "ja4").agg(F.count("*").alias("n"))
    merged = pairs.select("src", "flag", "dst").distinct().join(counts, ["src", "dst"]).groupBy("src", "flag", "ja4").agg(F.sum("n").alias("n"))
    return merged.groupBy("src", "flag").agg(F.max(F.struct("n", "ja4")).alias("_m")).select(
        "src", "flag", F.col("_m.ja4").alias("ja4"), F.col("_m.n").alias("ja4_count")
    )


def daily_counts(ssl: DataFrame) -> DataFrame:
    """The fold's input: (ip, ja4, day, count) of inside sources. Keyed by day, so a re-run replaces a day."""
    rows = ssl.where(IP.is_lan("src") & ~F.coalesce("ja4", F.lit("")).isin("", "-"))
    return rows.groupBy(F.col("src").alias("ip"), "ja4", "day").agg(F.count("*").alias("count"))


def fold_history(daily: DataFrame) -> DataFrame:
    """History per (ip, ja4): first and last day, total count."""
    return daily.groupBy("ip", "ja4").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.sum("count").alias("count")
    )


def nested_history(history: DataFrame) -> DataFrame:
    """The document form, one map of fingerprints per device (for export)."""
    entry = F.struct("first_seen", "last_seen", "count")
    return history.groupBy("ip").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.map_from_entries(F.collect_list(F.struct("ja4", entry))).alias("fingerprints"),
    )


def inventory(prints: DataFrame, history: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (day, device): distinct and total, new that day, top three, outlier, threats over all hashes."""
    first = history.select(F.col("ip").alias("src"), "ja4", "first_seen")
    marked = (
        prints.join(first, ["src", "ja4"], "left").join(classify(prints, labels), "ja4")
        .withColumn("is_new", F.coalesce(F.col("first_seen") >= F.col("day"), F.lit(True)))
        .withColumn("threat", F.col("is_threat") & (F.col("source") == "ja4db"))
    )
    top = top_per(marked, ["day", "src"], [F.desc("n"), "ja4"], 3).groupBy("day", "src").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("place", "ja4", "n"))),
            lambda x: F.concat(x["ja4"], F.lit("="), x["n"].cast("string"))), ", ").alias("top")
    )
    per = marked.groupBy("day", "src").agg(
        F.count("*").alias("n_unique"), F.sum("n").alias("n_total"), F.count_if("is_new").alias("n_new"),
        F.count_if("threat").alias("n_threats"),
    )
    return per.join(top, ["day", "src"]).select(
        "day", "src", "n_unique", "n_total", "n_new", "top", F.greatest(F.col("n_unique") - 3, F.lit(0)).alias("more"),
        ((F.col("n_unique") == 1) & (F.col("n_total") >= 5)).alias("outlier"), "n_threats",
    )


def threats(prints: DataFrame, labels: DataFrame) -> DataFrame:
    """Exact matches with a malware label, per (day, device, fingerprint)."""
    known = classify(prints, labels).where(F.col("is_threat") & (F.col("source") == "ja4db"))
    return prints.join(known, "ja4").select("day", F.col("src").alias("ip"), "ja4", F.col("label").alias("match"), F.col("n").alias("count"))


def threat_alerts(prints: DataFrame, labels: DataFrame) -> DataFrame:
    """The pager's form: one alert event per (day, device, label)."""
    per = threats(prints, labels).groupBy("day", "ip", "match").agg(F.sum("count").alias("count"))
    return per.select(
        "day", F.lit("threat_intel_hit").alias("type"), F.lit("high").alias("severity"), F.col("ip").alias("device"),
        F.concat(F.lit("JA4 match: "), "match").alias("detail"),
    )


def device_summary(today: DataFrame, history: DataFrame, labels: DataFrame, registry: Registry, day) -> DataFrame:
    """Per device, history and today together: totals, new today, modal print, threat with 14-day fade."""
    day = F.lit(day).cast("date")
    now = today.groupBy(F.col("src").alias("ip"), "ja4").agg(F.sum("n").alias("n_now"))
    both = history.join(now, ["ip", "ja4"], "full_outer")
    both = both.join(classify(both, labels), "ja4").join(
        registry.devices.select("ip", F.lit(True).alias("_fp")), "ip", "left"
    )
    fresh = F.col("n_now").isNotNull() | (F.col("last_seen") >= F.date_sub(day, C.JA4_FADE_DAYS))
    n = F.coalesce("count", F.lit(0)) + F.coalesce("n_now", F.lit(0))
    threat = F.col("is_threat") & (F.col("source") == "ja4db") & fresh & F.col("_fp").isNull()
    new = F.col("n_now").isNotNull() & F.coalesce(F.col("first_seen") >= day, F.lit(True))
    return both.withColumn("n", n).groupBy("ip").agg(
        F.count("*").alias("n_total"), F.count("n_now").alias("n_today"), F.count_if(new).alias("n_new_today"),
        F.max(F.struct("n", "ja4")).alias("_m"), F.min("first_seen").alias("first_seen"),
        F.max(threat).alias("any_threat"), F.count_if(threat).alias("n_threat_hashes"),
    ).select(
        "ip", "n_total", "n_today", "n_new_today", F.col("_m.ja4").alias("modal"), F.col("_m.n").alias("modal_count"),
        "first_seen", "any_threat", "n_threat_hashes",
    )
