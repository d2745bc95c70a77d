"""Scored findings: one row per beacon, suppression, device views, news and persistence.

``findings`` has the columns finding_id, line_no, day, severity, src, dst, fqdn, score, strobe,
threat_intel, conns, total_bytes, service, first_seen. (finding_id, line_no) only settles ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import ip as IP
from ..functions import names as N
from ..functions.flags import finding_flag
from ..session import checkpoint
from ..sources.windows import last_existing_days
from .fingerprints import classify, modal_print
from .network import top_per
from .ranges import with_ranges
from .skew import left_lookup
from .suppress import Registry, drop_devices, keep_unsuppressed, mark_suppressed

_TIES = ["finding_id", "line_no"]


def dest_key():
    return F.when(F.trim("fqdn") != "", F.trim("fqdn")).otherwise(F.trim("dst"))


def dedup(findings: DataFrame, recent_sections: int = C.RECENT_SECTIONS) -> DataFrame:
    """One row per (src, dst, fqdn): best score, the later day on ties; recent when any row was."""
    recent = last_existing_days(findings, recent_sections).select("day", F.lit(True).alias("_recent"))
    rows = findings.join(recent, "day", "left")
    rest = [c for c in findings.columns if c not in ("src", "dst", "fqdn", "score", "day", *_TIES)]
    best = F.max(F.struct("score", "day", *_TIES, *rest)).alias("_b")
    out = rows.groupBy("src", "dst", "fqdn").agg(best, F.coalesce(F.max("_recent"), F.lit(False)).alias("is_recent"))
    return out.select("src", "dst", "fqdn", "_b.*", "is_recent")


def _values(findings: DataFrame) -> DataFrame:
    """The distinct (dst, fqdn, service), written down: what look-ups need to know of the findings, read once for all."""
    return checkpoint(findings.select("dst", "fqdn", "service").distinct())


def _all_names(values: DataFrame, names: DataFrame) -> DataFrame:
    return values.select(F.explode(F.array("fqdn", "dst")).alias("name")).unionByName(names.select("name"))


def _recovered(rows: DataFrame, names: DataFrame, unnamed) -> DataFrame:
    """``enrich_name``: what is known elsewhere (``names(dst, name)``) of addresses without a name."""
    rows = left_lookup(rows, F.col("dst"), names.select(F.col("dst").alias("_ip"), F.col("name").alias("_name")), "_ip")
    return rows.withColumn("enrich_name", F.when(unnamed & IP.looks_v4("dst"), F.col("_name"))).drop("_name")


def page_rows(findings: DataFrame, geo: DataFrame, identity: DataFrame, registry: Registry) -> DataFrame:
    """Deduplicated rows from v4 sources to destinations not known as safe, with owner, recovered
    name and ``suppressed_by`` (device, then domain - address and recovered name included -, then service)."""
    values, names = _values(findings), checkpoint(identity.select("dst", "name"))
    rows = dedup(findings).where(IP.looks_v4(F.trim("src")))
    rows = with_ranges(rows, "dst", geo, ["org", "city", "cc"], ips=values)
    rows = rows.where(~N.is_safe_dest("dst", "fqdn", "org"))
    rows = _recovered(rows, names, F.trim("fqdn") == "")
    rows = rows.withColumn("dest", N.annotate_dest(F.when(F.col("fqdn") != "", F.col("fqdn")).otherwise(F.col("dst")), "org", "city", "cc"))
    return mark_suppressed(
        rows, registry, device="src", domains=["fqdn", "dst", "enrich_name"], service="service",
        names=_all_names(values, names), services=values.select("service"),
    )


def kept(page: DataFrame) -> DataFrame:
    """Rows that count: not suppressed and with a beacon score."""
    return page.where(F.col("suppressed_by").isNull() & (F.col("score") != 0))


def severity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count("*").alias("n"))


def suppressed_groups(page: DataFrame) -> DataFrame:
    """Per rule: how many rows it hides, biggest first."""
    hidden = page.where(F.col("suppressed_by").isNotNull())
    return hidden.groupBy("suppressed_by.rule_type", "suppressed_by.rule").agg(
        F.count("*").alias("n_rows"), F.max("suppressed_by.reason").alias("reason"), F.max("score").alias("max_score"),
    ).orderBy(F.desc("n_rows"), "rule_type", "rule")


def hotlist(rows: DataFrame) -> DataFrame:
    """Per device: rows by severity (Critical counts as High), best score, three best destinations."""
    per_dest = rows.groupBy("src", "dest").agg(
        F.max("score").alias("score"), F.count("*").alias("n"),
        *[F.count_if(F.col("severity").isin(*s)).alias(a) for a, s in
          (("high", ("Critical", "High")), ("med", ("Medium",)), ("low", ("Low",)))],
    )
    top = top_per(per_dest, ["src"], [F.desc("score"), "dest"], 3).groupBy("src").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "dest"))), lambda x: x["dest"]), ", ").alias("top_dests")
    )
    totals = per_dest.groupBy("src").agg(
        *[F.sum(c).alias(c) for c in ("high", "med", "low")], F.sum("n").alias("total"), F.max("score").alias("max_score")
    )
    return totals.join(top, "src")


def device_beacons(rows: DataFrame) -> DataFrame:
    """Drill-down list: every row by device, severity class and score (a range sort, so a busy device is split)."""
    bucket = F.when(F.col("severity").isin("Critical", "High"), "high").when(F.col("severity") == "Medium", "med").when(
        F.col("severity") == "Low", "low").otherwise("other")
    return rows.withColumn("bucket", bucket).select(
        "src", "bucket", "dst", "fqdn", "score", "conns", "service", "severity"
    ).orderBy("src", "bucket", F.desc("score"), "dst", "fqdn")


def top_beacons(rows: DataFrame, min_score: float = C.TOP_BEACON_SCORE) -> DataFrame:
    """Recent rows with a high score, one per (src, name or address)."""
    best = rows.where((F.col("score") >= min_score) & F.col("is_recent")).groupBy("src", dest_key().alias("dest_key")).agg(
        F.max(F.struct("score", "day", "dst", "conns", "service", "severity")).alias("_b")
    )
    return best.select("src", "dest_key", "_b.score", "_b.dst", "_b.conns", "_b.service", "_b.severity")


def flagged(rows: DataFrame, skip_benign_names: bool = False) -> DataFrame:
    out = rows.withColumn("flag", finding_flag(skip_benign_names=skip_benign_names)).where(F.col("flag").isNotNull())
    return out.withColumn("msg", F.col("flag.msg")).withColumn("flag", F.col("flag.type"))


def investigate(marked: DataFrame) -> DataFrame:
    """Per (src, flag): best score, destinations (three, or two and a count) and what was seen.

    ``marked`` comes from :func:`flagged`; it feeds several folds, so it is written down once.
    """
    marked = checkpoint(marked.select("src", "flag", "dest", "score", "conns", "msg"))
    dests = marked.groupBy("src", "flag", "dest").agg(F.max("score").alias("score"), F.sum("conns").alias("conns"), F.min("msg").alias("msg"))
    msgs = marked.groupBy("src", "flag", "msg").agg(F.max("score").alias("score"))
    n_msgs = msgs.groupBy("src", "flag").agg(F.count("*").alias("n_msgs"), F.max(F.struct("score", "msg"))["msg"].alias("first_msg"))
    vendors = msgs.where("flag = 'vendor-telemetry'").groupBy("src", "flag").agg(
        F.array_join(F.sort_array(F.collect_set("msg")), " + ").alias("vendors"))
    first = top_per(dests, ["src", "flag"], [F.desc("score"), "dest"], 3).groupBy("src", "flag").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "dest"))), lambda x: x["dest"]).alias("first"))
    total = dests.groupBy("src", "flag").agg(F.count("*").alias("n_dests"), F.sum("conns").alias("conns"), F.max("score").alias("score"))
    keys = ["src", "flag"]
    j = total.join(first, keys).join(n_msgs, keys).join(vendors, keys, "left")
    shown = F.when(F.col("n_dests") <= 3, F.array_join("first", ", ")).otherwise(
        F.concat(F.array_join(F.slice("first", 1, 2), ", "), F.lit(", +"), (F.col("n_dests") - 2).cast("string"), F.lit(" more")))
    text = (
        F.when(F.col("flag") == "vendor-telemetry", F.concat("vendors", F.lit(" telemetry ("), F.col("conns").cast("string"), F.lit(" conns)")))
        .when((F.col("flag") == "dns") & (F.col("n_msgs") > 1),
              F.concat(F.lit("Excessive DNS: "), F.col("conns").cast("string"), F.lit(" total queries")))
        .otherwise(F.col("first_msg"))
    )
    return j.select("src", "flag", "score", "n_dests", shown.alias("dests"), text.alias("flag_str"))


def investigate_details(marked: DataFrame, ssl: DataFrame, labels: DataFrame, ident: DataFrame, today) -> DataFrame:
    """What stands beside a row of :func:`investigate`, per (src, flag): the usual TLS client and recovered names.

    The client is the most common fingerprint of the source towards the group's addresses, today and yesterday, with its
    label, where that comes from, and whether it names malware; nulls where none was seen. ``recovered`` lists the shown
    destinations that are bare addresses and have a name elsewhere (``ident``), as ``address: name (source)``.
    """
    marked = checkpoint(marked.select("src", "flag", "dest", "dst", "fqdn", "score"))
    prints = checkpoint(modal_print(ssl, marked.where("dst <> ''").select("src", "flag", "dst"), today))
    known = classify(prints, labels).select("ja4", F.col("label").alias("ja4_label"), F.col("source").alias("ja4_source"), F.col("is_threat").alias("ja4_threat"))
    keys = ["src", "flag"]
    bare = F.when(F.coalesce("fqdn", F.lit("")) == "", F.col("dst"))
    dests = marked.groupBy(*keys, "dest").agg(F.max("score").alias("score"), F.max(bare).alias("address"))
    total = dests.groupBy(*keys).agg(F.count("*").alias("n_dests"))
    shown = top_per(dests, keys, [F.desc("score"), "dest"], 3).join(total, keys).where("place <= 2 or n_dests <= 3")
    named = shown.join(ident.select(F.col("dst").alias("address"), "name", "source"), "address")
    text = F.concat("address", F.lit(": "), "name", F.lit(" ("), "source", F.lit(")"))
    recovered = named.groupBy(*keys).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "; ").alias("recovered"))
    out = total.join(prints, keys, "left").join(known, "ja4", "left").join(recovered, keys, "left")
    return out.select(*keys, "ja4", "ja4_count", "ja4_label", "ja4_source", "ja4_threat", F.coalesce("recovered", F.lit("")).alias("recovered"))


def beaconing_devices(rows: DataFrame) -> DataFrame:
    """The tile: devices on the hotlist."""
    return rows.agg(F.countDistinct("src").alias("devices"))


def _listed(findings: DataFrame, geo: DataFrame, ips: DataFrame | None = None) -> DataFrame:
    rows = findings.where(IP.looks_v4(F.trim("src"))).withColumn("dest_key", dest_key())
    rows = with_ranges(rows, "dst", geo, ["org"], ips=findings if ips is None else ips)
    return rows.where(~N.is_safe_dest("dst", "fqdn", "org"))


def persistence(
    findings: DataFrame, geo: DataFrame, registry: Registry, reports: int = C.REPORT_FILES_PERSIST, min_days: int = 3, top: int = 30
) -> DataFrame:
    """Beacons on several distinct days of the last reports; the newest address is kept per pair."""
    rows = _listed(findings.join(last_existing_days(findings, reports).select("day"), "day"), geo)
    days = rows.groupBy("src", "dest_key", "day").agg(F.max("score").alias("score"), F.max("dst").alias("dst"))
    pairs = days.groupBy("src", "dest_key").agg(
        F.count("*").alias("days"), F.max("day").alias("latest"), F.max("score").alias("score"),
        F.max(F.struct("day", "dst"))["dst"].alias("dst"),
    ).where(F.col("days") >= min_days)
    pairs = keep_unsuppressed(drop_devices(pairs, registry), registry, domains=["dest_key"])
    return pairs.orderBy(F.desc("days"), F.desc("score"), "src", "dest_key").limit(top)


def new_beacons(
    findings: DataFrame, geo: DataFrame, identity: DataFrame, registry: Registry, before: int = C.REPORT_FILES_BEFORE, top: int = 30
) -> DataFrame:
    """Pairs of the latest report that the reports before it did not have, grouped by source.

    Sources with the best row (severity, then score) come first; a source's rows stay together.
    """
    days = last_existing_days(findings, before + 1)
    numbered = findings.join(days, "day")
    latest = numbered.withColumn("_last", days.agg(F.max("day_no")).scalar())
    values, names = _values(findings), checkpoint(identity.select("dst", "name"))
    now = _listed(latest.where("day_no = _last"), geo, values)
    past = latest.where("day_no < _last").select("src", dest_key().alias("dest_key")).distinct()
    best = now.groupBy("src", "dest_key").agg(
        F.max(F.struct("score", *_TIES, "dst", "fqdn", "service", "severity", "first_seen")).alias("_b")
    ).select("src", "dest_key", "_b.*").join(past, ["src", "dest_key"], "left_anti")
    best = _recovered(best, names, F.col("fqdn") == "")
    rows = keep_unsuppressed(
        drop_devices(best, registry), registry, domains=["fqdn", "dst", "enrich_name"], service="service",
        names=_all_names(values, names), services=values.select("service"),
    )
    rank_map = F.create_map(*[F.lit(x) for kv in C.SEVERITY_RANK.items() for x in kv])
    rows = rows.withColumn("rank", F.coalesce(F.try_element_at(rank_map, F.col("severity")), F.lit(0)))
    rows = checkpoint(rows.select("src", "dest_key", "dst", "score", "service", "severity", "first_seen", "rank"))
    # Only the first `top` sources can contribute to the first `top` rows.
    lead = rows.groupBy("src").agg(F.max(F.struct("rank", "score")).alias("_g")).orderBy(F.desc("_g"), "src").limit(top)
    ordered = rows.join(lead, "src").orderBy(F.desc("_g"), "src", F.desc("rank"), F.desc("score"), "dest_key").limit(top)
    w = Window.partitionBy("src")
    place = F.row_number().over(w.orderBy(F.desc("rank"), F.desc("score"), "dest_key"))
    return ordered.withColumn("_place", place).withColumn("group_first", F.col("_place") == 1).withColumn(
        "group_size", F.when(F.col("_place") == 1, F.count("*").over(w)).otherwise(0)
    ).select("src", "dest_key", "dst", "score", "service", "severity", "first_seen", "group_first", "group_size")


# -- text summary --------------------------------------------------------------------------------

def summary_rows(findings: DataFrame, geo: DataFrame, registry: Registry) -> DataFrame:
    """The summary's input: unsuppressed rows of strict v4 sources, with owner, name shown and benign mark.

    Here the suppression target is the name, or the address where there is no name.
    """
    values = _values(findings)
    rows = findings.withColumn("target", dest_key())
    rows = keep_unsuppressed(
        drop_devices(rows, registry), registry, domains=["target"], service="service",
        names=values.select(dest_key()), services=values.select("service"),
    )
    rows = with_ranges(rows.where(IP.is_v4(F.trim("src"))), "dst", geo, ["org", "city", "cc"], ips=values)
    rows = rows.withColumn("dest", N.annotate_dest("target", "org", "city", "cc"))
    rows = rows.withColumn("user_safe", N.is_benign_name("dest") | N.is_safe_org("org"))
    return rows.withColumn("benign", F.col("user_safe") | IP.in_cidrs("dst", [c for c, _ in C.VENDOR_NETS]))


def summary_severity(rows: DataFrame) -> DataFrame:
    return severity_counts(rows.where(~F.col("benign")))


def summary_hotlist(rows: DataFrame) -> DataFrame:
    """Per device: high, medium, total, best score and its destination."""
    per = rows.where(~F.col("benign")).groupBy("src").agg(
        F.count_if(F.col("severity").isin("Critical", "High")).alias("high"), F.count_if(F.col("severity") == "Medium").alias("med"),
        F.count("*").alias("total"), F.max(F.struct("score", "dest")).alias("_t"),
    )
    return per.select("src", "high", "med", "total", F.col("_t.score").alias("max_score"), F.col("_t.dest").alias("top_dest"))


def summary_top(rows: DataFrame, min_score: float = C.TOP_BEACON_SCORE, top: int = 30) -> DataFrame:
    """Best rows grouped by source, sources by their best score, at most ``top`` rows."""
    high = rows.where(~F.col("benign") & (F.col("score") >= min_score))
    best = high.groupBy("src").agg(F.max("score").alias("src_best"))
    # Only the first `top` sources can contribute to the first `top` rows.
    lead = best.orderBy(F.desc("src_best"), "src").limit(top)
    return high.join(lead, "src").orderBy(F.desc("src_best"), "src", F.desc("score"), "dest", *_TIES).limit(top)


def summary_signals(rows: DataFrame) -> DataFrame:
    """Strobes (benign destinations left out) and intel hits (only user-made exceptions left out)."""
    strobes = rows.where(F.col("strobe") & ~F.col("benign")).withColumn("signal", F.lit("strobe"))
    hits = rows.where(F.col("threat_intel") & ~F.col("user_safe")).withColumn("signal", F.lit("threat_intel"))
    return strobes.unionByName(hits)


def likely_benign(rows: DataFrame) -> DataFrame:
    """Devices recognised by what they talk to: first matching label and up to three vendor destinations."""
    dests = rows.groupBy("src", "dest").agg(F.lit(1).alias("one"))
    order = F.coalesce(*[
        F.when(F.col("dest").rlike("|".join(k.replace(".", r"\.") for k in words)), F.lit(i))
        for i, (words, _) in enumerate(C.DEVICE_KEYWORDS)
    ])
    first = dests.groupBy("src").agg(F.min(order).alias("label_no")).where(F.col("label_no").isNotNull())
    names = F.array(*[F.lit(label) for _, label in C.DEVICE_KEYWORDS])
    vendor = top_per(dests.where(N.is_benign_name("dest")), ["src"], ["dest"], 3).groupBy("src").agg(
        F.array_join(F.sort_array(F.collect_list("dest")), ", ").alias("evidence"))
    return first.join(vendor, "src", "left").select(
        "src", F.get(names, F.col("label_no")).alias("label"), F.coalesce("evidence", F.lit("")).alias("evidence"))
