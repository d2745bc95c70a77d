"""False-positive suppression: device, name glob, service component and owner glob.

All four tests are look-ups on distinct values. The usual pattern shapes (a literal name, or
``*.`` + literal) are equality joins on the name's label suffixes. Up to ``_CHUNK`` irregular globs, what a hand-kept
registry has, are one chain of regular expressions; more are indexed by a rare piece of their literal text, which
values are looked up by, and only the patterns found there are tested.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import checkpoint
from .skew import left_lookup

_CHUNK = 200
_GRAM = 8


@dataclass
class Registry:
    """Suppression rules. ``devices(ip, reason)``; the others ``(ord, pattern, reason)``."""

    devices: DataFrame
    domains: DataFrame
    protocols: DataFrame
    orgs: DataFrame
    _written: tuple[DataFrame, DataFrame] | None = None

    def addresses(self) -> DataFrame:
        """``devices``, written down once: few addresses that come out of whole logs, their size known to the planner."""
        if self._written is None or self._written[0] is not self.devices:
            self._written = (self.devices, checkpoint(self.devices))
        return self._written[1]


def device_ips(fp_macs: DataFrame, *sightings: DataFrame) -> DataFrame:
    """Every address a listed MAC has held: leases, DHCP log and asset history together.

    ``fp_macs(mac, reason)``, each of ``sightings(mac, ip)``.
    """
    macs = fp_macs.select(F.lower("mac").alias("mac"), "reason")
    # The listed MACs are few: meeting them first keeps the sightings from being shuffled whole.
    seen = reduce(
        DataFrame.unionByName,
        [s.where("mac <> '' and ip <> ''").select(F.lower("mac").alias("mac"), "ip").join(macs, "mac") for s in sightings],
    )
    return seen.groupBy("ip").agg(F.min("reason").alias("reason"))


def make_registry(
    rules: DataFrame, *sightings: DataFrame
) -> Registry:
    """Split the flat rule table ``(kind, ord, pattern, reason)`` by kind."""
    part = lambda kind: rules.where(F.col("kind") == kind).select("ord", "pattern", "reason")
    macs = part("devices").select(F.col("pattern").alias("mac"), "reason")
    if sightings:
        devices = device_ips(macs, *sightings)
    else:
        devices = macs.select(F.col("mac").alias("ip"), "reason").limit(0)
    return Registry(devices, part("domains"), part("protocols"), part("orgs"))


def _glob_shape():
    """0 literal, 1 ``*.literal``, 2 anything else."""
    wild = r"[*?\[]"
    p = F.col("pattern")
    return (
        F.when(~p.rlike(wild), 0)
        .when(p.startswith("*.") & ~F.expr("substring(pattern, 3)").rlike(wild), 1)
        .otherwise(2)
    )


def glob_index(patterns: DataFrame) -> DataFrame:
    """``(ord, gram, regex)``: each glob under the piece of its literal text (``_GRAM`` characters at most) that fewest share.

    A glob without literal text stands under the empty piece, which every value has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ord_, pattern in zip(batch["ord"].tolist(), batch["pattern"].tolist()):
                grams = {r[i : i + _GRAM] for r in N.glob_literals(pattern) for i in range(max(1, len(r) - _GRAM + 1))}
                regex = N.glob_to_regex(pattern)
                if pattern.startswith("*."):  # the text after it stands for itself as well, wildcards and all
                    grams = {r[i : i + _GRAM] for r in N.glob_literals(pattern[2:]) for i in range(max(1, len(r) - _GRAM + 1))}
                    regex = f"{regex}|\\A{N.literal_regex(pattern[2:])}\\z"
                rows += [(ord_, g, regex) for g in grams or {""}]
            yield pd.DataFrame(rows, columns=["ord", "gram", "regex"])

    grams = patterns.select(F.col("ord").cast("int").alias("ord"), "pattern").mapInPandas(run, "ord int, gram string, regex string")
    shared = grams.groupBy("gram").agg(F.count("*").alias("_n"))
    best = grams.join(shared, "gram").groupBy("ord", "regex").agg(F.min(F.struct("_n", (-F.length("gram")).alias("_l"), "gram")).alias("_g"))
    return checkpoint(best.select("ord", F.col("_g.gram").alias("gram"), "regex"))  # its size decides how it is joined


def _indexed_lookup(distinct: DataFrame, keep: list[str], value: str, patterns: DataFrame) -> DataFrame:
    """``(*keep, value, _regex_ord)`` of the first indexed glob that matches; a plan of one size for any number of globs."""
    index = glob_index(patterns)
    lengths = index.agg(F.collect_set(F.length("gram"))).scalar()  # at most _GRAM + 1 of them
    v, n = F.col(value), F.length(value)
    pieces = lambda k: F.when(k == 0, F.array(F.lit(""))).when(k <= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(v, i, k))))
    probes = distinct.withColumn("_lens", lengths).withColumn("gram", F.explode(F.flatten(F.array_compact(F.transform("_lens", pieces)))))
    hits = probes.join(index, "gram").where(F.rlike(v, F.col("regex")))
    return hits.groupBy(*keep, value).agg(F.min("ord").alias("_regex_ord"))


def glob_lookup(values: DataFrame, value: str, patterns: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``(*keep, value, ord)`` of the first pattern, in registry order, that each distinct value matches.

    ``keep`` carries key columns along, which saves joining the hits back to ``values``.
    """
    distinct = values.select(*keep, value).where(F.col(value) != "").distinct()
    shaped = patterns.withColumn("_shape", _glob_shape())
    keys = (
        shaped.where("_shape < 2")
        .select(
            F.col("_shape").alias("_kind"),
            F.when(F.col("_shape") == 1, F.expr("substring(pattern, 3)")).otherwise(F.col("pattern")).alias("_key"),
            "ord",
        )
        .groupBy("_kind", "_key").agg(F.min("ord").alias("ord"))
    )
    irregular = shaped.where("_shape = 2").select("ord", "pattern")
    few = irregular.orderBy("ord").limit(_CHUNK + 1).collect()
    if len(few) > _CHUNK:
        found = _indexed_lookup(distinct, keep, value, irregular).withColumnsRenamed({c: f"_f{i}" for i, c in enumerate([*keep, value])})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate([*keep, value])])
        distinct, by_regex = distinct.join(found, same, "left"), F.col("_regex_ord")
    else:
        by_regex = F.coalesce(F.lit(None).cast("int"), *[F.when(N.glob_matches(value, r["pattern"]), F.lit(r["ord"])) for r in few])
    probes = distinct.select(
        *keep, value, by_regex.alias("_regex_ord"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(0).alias("_kind"), F.col(value).alias("_key"))),
                F.transform(N.label_suffixes(value), lambda s: F.struct(F.lit(1).alias("_kind"), s.alias("_key"))),
            )
        ).alias("_probe"),
    ).select(*keep, value, "_regex_ord", "_probe._kind", "_probe._key")
    hits = probes.join(keys, ["_kind", "_key"], "left").select(*keep, value, F.least("ord", "_regex_ord").alias("ord"))
    return hits.where(F.col("ord").isNotNull()).groupBy(*keep, value).agg(F.min("ord").alias("ord"))


def service_lookup(values: DataFrame, value: str, patterns: DataFrame) -> DataFrame:
    """``(value, ord)`` of the first hit: components left to right, then patterns in order.

    ``comp = pattern or comp starts with pattern + ':'`` means the pattern is the component cut at
    one of its colons, so this is an equality join as well.
    """
    comps = values.select(value).where(F.col(value) != "").distinct().select(
        value, F.posexplode(F.split(F.trim(F.col(value)), ",")).alias("_pos", "_comp")
    )
    parts = F.split(F.trim("_comp"), ":")
    cuts = comps.select(
        value, "_pos",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))
        ).alias("pattern"),
    )
    hits = cuts.where("pattern <> ''").join(patterns.select("pattern", "ord"), "pattern")
    best = hits.groupBy(value).agg(F.min(F.col("_pos") * F.lit(1 << 32) + F.col("ord")).alias("_best"))
    return best.select(value, F.pmod("_best", F.lit(1 << 32)).cast("int").alias("ord"))


def _attach(df: DataFrame, column: str, found: DataFrame, key: str, name: str) -> DataFrame:
    value = F.nullif(F.col(column), F.lit(""))  # no rule stands for an empty value
    return left_lookup(df, value, found.select(F.col(key).alias("_k"), F.col("ord").alias(name)), "_k")


def _first_glob(
    df: DataFrame, columns: list[str], patterns: DataFrame, name: str, values: DataFrame | None
) -> DataFrame:
    if values is None:
        values = df.select(F.explode(F.array_compact(F.array(*columns))).alias("_v"))
    else:
        values = values.toDF("_v")
    found = checkpoint(glob_lookup(values, "_v", patterns))  # read once per column
    marks = []
    for i, column in enumerate(columns):
        marks.append(f"_{name}{i}")
        df = _attach(df, column, found, "_v", marks[-1])
    best = F.least(*marks) if len(marks) > 1 else F.col(marks[0])
    return df.withColumn(f"_{name}", best).drop(*marks)


def mark_suppressed(
    df: DataFrame, registry: Registry, device: str | None = None, domains: list[str] = (),
    service: str | None = None, org: str | None = None,
    names: DataFrame | None = None, services: DataFrame | None = None,
) -> DataFrame:
    """``df`` plus ``suppressed_by`` = struct(rule_type, rule, reason); null for rows that stay.

    Dimensions are tested in the order device, domain, protocol, org; the first hit is reported.
    ``names`` and ``services`` (one column each) may list all values of the domain and service
    columns from a simpler table, so that a long chain behind ``df`` is planned only once.
    """
    cases, rules = [], []
    if device:
        df = left_lookup(df, F.col(device), registry.addresses().select(F.col("ip").alias("_ip"), F.col("reason").alias("_device_reason")), "_ip")
        cases.append((F.col("_device_reason").isNotNull(), "device", F.col(device), F.col("_device_reason")))
    if domains:
        df = _first_glob(df, list(domains), registry.domains, "domain", names)
        rules.append(("domain", registry.domains))
    if service:
        listed = df.select(service) if services is None else services
        found = service_lookup(listed.toDF("_v"), "_v", registry.protocols)
        df = _attach(df, service, found, "_v", "_protocol")
        rules.append(("protocol", registry.protocols))
    if org:
        df = _first_glob(df, [org], registry.orgs, "org", None)
        rules.append(("org", registry.orgs))
    for kind, table in rules:
        text = table.select(
            F.col("ord").alias("_ord"), F.col("pattern").alias(f"_{kind}_rule"), F.col("reason").alias(f"_{kind}_reason")
        )
        df = left_lookup(df, F.col(f"_{kind}"), text, "_ord")
        cases.append((F.col(f"_{kind}").isNotNull(), kind, F.col(f"_{kind}_rule"), F.col(f"_{kind}_reason")))
    out = None
    for hit, kind, rule, reason in cases:
        value = F.struct(F.lit(kind).alias("rule_type"), rule.alias("rule"), reason.alias("reason"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    drop = [c for c in df.columns if c.startswith(("_device_reason", "_domain", "_protocol", "_org"))]
    return df.withColumn("suppressed_by", out).drop(*drop)


def keep_unsuppressed(df: DataFrame, registry: Registry, **dimensions) -> DataFrame:
    marked = mark_suppressed(df, registry, **dimensions)
    return marked.where(F.col("suppressed_by").isNull()).drop("suppressed_by")


def drop_devices(df: DataFrame, registry: Registry, device: str = "src") -> DataFrame:
    """Anti join on the listed devices' addresses."""
    return df.join(registry.addresses().select(F.col("ip").alias(device)), device, "left_anti")
