"""Which findings page someone: lonely, non-hyperscaler destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def gate_reason(dst, org, fqdn, ip_talkers, name_talkers, talkers_known=True) -> Column:
    """``fire`` or why not: hyperscaler, talkers_unknown (the count's source was down), shared_lan."""
    usable = F.col(dst).isNotNull() & ~F.col(dst).isin("", "::")
    hyper = (usable & N.is_hyperscaler_org(org)) | N.is_hyperscaler_name(fqdn)
    shared = F.when(usable, F.coalesce(F.col(ip_talkers), F.lit(1)) > 1).otherwise(F.coalesce(F.col(name_talkers), F.lit(0)) > 1)
    known = talkers_known if isinstance(talkers_known, Column) else F.lit(talkers_known)
    return F.when(hyper, "hyperscaler").when(~known, "talkers_unknown").when(shared, "shared_lan").otherwise("fire")


def summary_alerts(rows: DataFrame, talkers: DataFrame | None) -> DataFrame:
    """Alert candidates of the daily summary with the gate's verdict.

    ``rows`` from ``findings.summary_rows``; ``talkers(dst, dst_port, lan_talkers)`` or None when it
    could not be computed. Intel hits and exit-node contacts are not gated.
    """
    base = rows.where(~F.col("benign")).withColumn("dst_port", N.first_port("service"))
    by_name = base.where(F.col("fqdn") != "").groupBy("fqdn").agg(F.countDistinct("src").alias("name_talkers"))
    base = base.where((F.col("score") >= 1.0) | F.col("strobe")).join(by_name, "fqdn", "left")
    if talkers is None:
        base = base.withColumn("lan_talkers", F.lit(None).cast("bigint"))
    else:
        base = base.join(talkers, ["dst", "dst_port"], "left")
    reason = gate_reason("dst", "org", "fqdn", "lan_talkers", "name_talkers", talkers is not None)
    kinds = F.array_compact(F.array(
        F.when(F.col("score") >= 1.0, F.lit("high_score_beacon")), F.when(F.col("strobe"), F.lit("persistent_beacon"))))
    text = F.when(F.col("type") == "high_score_beacon", "Score-1.0 beacon → ").otherwise("Strobe → ")
    gated = base.withColumn("reason", reason).withColumn("type", F.explode(kinds)).select(
        "type", "reason", F.col("src").alias("device"), F.concat(text, F.substring("dest", 1, 80)).alias("detail"))
    hits = rows.where(F.col("threat_intel") & ~F.col("user_safe")).select(
        F.lit("threat_intel_hit").alias("type"), F.lit("fire").alias("reason"), F.col("src").alias("device"),
        F.concat(F.lit("Threat intel hit → "), F.substring("dest", 1, 80)).alias("detail"))
    return gated.unionByName(hits)


def exit_contacts(marked: DataFrame) -> DataFrame:
    """One ungated alert per device that talked to an exit node (best-scored destination named)."""
    best = marked.where("flag = 'tor'").groupBy("src").agg(F.max(F.struct("score", "dest")).alias("_b"))
    return best.select(
        F.lit("tor_contact").alias("type"), F.lit("fire").alias("reason"), F.col("src").alias("device"),
        F.concat(F.lit("Tor exit contact → "), F.substring("_b.dest", 1, 80)).alias("detail"))


def gate_stats(verdicts: DataFrame, component) -> DataFrame:
    """Fired and gated counts per component and reason."""
    component = F.col(component) if isinstance(component, str) else component
    return verdicts.groupBy(component.alias("component"), "reason").agg(F.count("*").alias("n"))


def enabled_only(alerts: DataFrame, toggles: DataFrame) -> DataFrame:
    """Alerts whose type is not switched off; a type without a toggle is on. ``toggles(type, enabled)``."""
    off = toggles.where(~F.coalesce(F.col("enabled"), F.lit(True))).select("type").distinct()
    return alerts.join(off, "type", "left_anti")
