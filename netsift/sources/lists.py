"""Readers for registries, leases, labels, network lists, inventories and telemetry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as T
from ..operators.ranges import address_range_table, cidr_table


def _ordered_lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("ord"))


def _data_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines that are not empty and not comments (``#`` or ``;``), in file order."""
    return _ordered_lines(spark, paths).where("value <> '' and not startswith(value, '#') and not startswith(value, ';')")


class EmptyList(ValueError):
    """A list that must never replace a good one."""


def refuse_empty(entries: DataFrame, what: str) -> DataFrame:
    """``entries``, or an error where there are none: a damaged download must not clear a list that is in use."""
    if entries.isEmpty():
        raise EmptyList(f"{what}: no usable entry")
    return entries


def leases(spark: SparkSession, paths) -> DataFrame:
    """DHCP leases ``ts mac ip host clientid``; ``*`` means no name; shorter lines are dropped."""
    p = F.split("value", r"\s+")
    rows = _ordered_lines(spark, paths).where(F.size(p) >= 4)
    host = F.get(p, F.lit(3))
    return rows.select(
        F.lower(F.get(p, F.lit(1))).alias("mac"), F.get(p, F.lit(2)).alias("ip"), F.when(host == "*", "").otherwise(host).alias("hostname"))


def suppression_rules(spark: SparkSession, path: str) -> DataFrame:
    """The suppression document as ``(kind, ord, pattern, reason)``; an unversioned flat map lists devices."""
    text = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", F.lit(T.REGISTRY))
    flat = F.from_json("value", F.lit("map<string, string>"))
    has_version = F.get_json_object("value", "$.version").isNotNull()
    empty = F.create_map().cast("map<string, string>")
    out = None
    for kind in ("devices", "domains", "protocols", "orgs"):
        entries = F.coalesce(doc[kind], empty)
        if kind == "devices":
            entries = F.when(has_version, entries).otherwise(F.coalesce(flat, empty))
        else:
            entries = F.when(has_version, entries).otherwise(empty)
        part = text.select(F.posexplode(F.map_entries(entries)).alias("ord", "_e")).select(
            F.lit(kind).alias("kind"), "ord", F.col("_e.key").alias("pattern"), F.col("_e.value").alias("reason"))
        if kind == "devices":
            part = part.withColumn("pattern", F.lower("pattern"))
        out = part if out is None else out.unionByName(part)
    return out


def ja4_labels(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint label CSV; file order decides between repeated fingerprints."""
    df = spark.read.option("header", True).csv(path)
    cell = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    return df.select(
        F.monotonically_increasing_id().alias("ord"), cell("Application").alias("app"), cell("Library").alias("lib"),
        cell("Device").alias("device"), cell("OS").alias("os"), cell("ja4").alias("ja4"))


def service_endpoints(spark: SparkSession, path: str, area: str = "Skype") -> DataFrame:
    """Published endpoint list of one service area as ``(kind, value)``: cidr, suffix, exact. IPv4 only.

    A list without any entry of the area is refused."""
    schema = "serviceArea string, ips array<string>, urls array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where(F.col("serviceArea") == area)
    nets = rows.select(F.explode("ips").alias("value")).where("not contains(value, ':')").withColumn("kind", F.lit("cidr"))
    urls = rows.select(F.explode("urls").alias("u")).select(F.lower(F.trim("u")).alias("value")).where("value <> ''")
    wild = F.col("value").startswith("*.")
    names = urls.select(
        F.when(wild, F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("value"), F.when(wild, "suffix").otherwise("exact").alias("kind"))
    return refuse_empty(nets.unionByName(names).distinct(), f"endpoints of {area}")


def netblocks(spark: SparkSession, paths) -> DataFrame:
    """Blocklist lines ``CIDR ; id`` as prefixes; host bits are ignored, bad lines dropped."""
    p = F.split("value", ";", 2)
    rows = _data_lines(spark, paths).select(
        "ord", F.trim(F.get(p, F.lit(0))).alias("cidr"), F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("sbl"))
    return cidr_table(rows)


def exit_addresses(spark: SparkSession, paths) -> DataFrame:
    from ..functions.ip import ip_bits

    return _data_lines(spark, paths).select(F.col("value").alias("ip")).where(ip_bits("ip").isNotNull()).distinct()


def geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Range table CSV ``lo,hi,cc,city,org`` (addresses as numbers)."""
    df = spark.read.option("header", True).schema("lo bigint, hi bigint, cc string, city string, org string").csv(path)
    return df.withColumn("ord", F.monotonically_increasing_id())


def address_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Range table CSV ``lo,hi,cc,city,org`` with the ends as v4 or v6 addresses, as prefixes."""
    df = spark.read.option("header", True).schema("lo string, hi string, cc string, city string, org string").csv(path)
    return address_range_table(df.withColumns({"lo": F.trim("lo"), "hi": F.trim("hi"), "ord": F.monotonically_increasing_id()}))


def vendor_prefixes(spark: SparkSession, paths) -> DataFrame:
    """``PREFIX vendor name`` lines, six hex digits with or without separators."""
    rows = _data_lines(spark, paths)
    prefix = F.regexp_replace(F.upper(F.regexp_extract("value", r"^(\S+)", 1)), "[:-]", "")
    return rows.select(prefix.alias("prefix"), F.regexp_extract("value", r"^\S+\s+(.+)$", 1).alias("name")).where("name <> ''")


def scan_results(spark: SparkSession, paths) -> DataFrame:
    """Greppable port scan lines: address, name, hardware, operating system, open ports.

    A line is tab-separated ``key: value`` sections; names stand in parentheses after what they name.
    """
    rows = spark.read.text(paths).select(F.split("value", "\t").alias("_s"))
    cut = lambda s, mark: F.trim(F.substring(s, F.length(F.substring_index(s, mark, 1)) + 2, F.length(s)))
    section = lambda key: F.coalesce(F.get(F.transform(F.filter("_s", lambda s: s.startswith(key + ":")), lambda s: cut(s, ":")), F.lit(0)), F.lit(""))
    first = lambda text: F.substring_index(text, " ", 1)
    named = lambda text: F.when(text.contains("("), F.substring_index(F.substring_index(text, "(", -1), ")", 1)).otherwise("")
    rows = rows.select(*[section(k).alias(k) for k in ("Host", "MAC", "OS", "Ports")]).where(F.col("Host").contains("("))
    guess = F.substring(F.trim(F.substring_index("OS", ";", 1)), 1, 60)
    field = lambda port, i: F.coalesce(F.get(F.split(port, "/"), F.lit(i)), F.lit(""))
    label = lambda port: F.concat_ws(":", F.concat_ws("/", field(port, 0), field(port, 2)), F.when(field(port, 4) != "", field(port, 4)))
    open_ = F.filter(F.transform(F.split("Ports", ","), lambda p: F.trim(p)), lambda p: field(p, 1) == "open")
    mac = F.when(F.length(first(F.col("MAC"))) == 17, first(F.col("MAC"))).otherwise("")
    return rows.select(
        first(F.col("Host")).alias("ip"), named(F.col("Host")).alias("hostname"), mac.alias("mac"),
        F.when(mac != "", named(F.col("MAC"))).otherwise("").alias("mac_vendor"),
        F.when(guess.contains("|"), "").otherwise(guess).alias("os"), F.array_distinct(F.transform(open_, label)).alias("open_ports"))


def telemetry_days(spark: SparkSession, paths) -> DataFrame:
    """Telemetry files ``{date, records}`` or a bare list of records, one row per sample."""
    text = spark.read.text(paths, wholetext=True)
    records = _RECORDS
    doc = F.from_json("value", F.lit(T.TELEMETRY))["records"]
    bare = F.from_json("value", F.lit(records))
    is_list = F.trim("value").startswith("[")
    return text.select(F.explode(F.when(is_list, bare).otherwise(doc)).alias("r")).select("r.*").withColumn(
        "time", F.col("time").try_cast("timestamp"))


# the type of a bare record list: what follows "records " in the document schema
_RECORDS = T.TELEMETRY.split("records ", 1)[1]


def mime_extensions(spark: SparkSession, path: str) -> DataFrame:
    """MIME list CSV (name, template, extensions, reference) as one ``(mime, ext)`` row per extension."""
    df = spark.read.schema("name string, template string, extensions string, reference string").csv(path)
    rows = df.where("lower(extensions) <> 'none'").select("template", F.explode(F.split("extensions", r"[,\s]+")).alias("ext"))
    dotted = F.lower(F.regexp_replace("ext", r"^\.?", "."))
    return rows.where(F.col("ext").rlike("[A-Za-z0-9]")).select(F.col("template").alias("mime"), F.regexp_replace(dotted, r"\.$", "").alias("ext"))
