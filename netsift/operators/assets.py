"""Asset inventory: merging sources, operating systems, new devices, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalogues as C
from ..functions import devices as V
from ..functions.ip import looks_v4

# sources by precedence for hardware address and host name
LEASES, ARP, DHCP = 0, 1, 2
_SOURCE_NAMES = {LEASES: "leases", ARP: "arp", DHCP: "dhcp"}


def vendor_table(prefixes: DataFrame, extra: list[tuple[str, str]] = C.LOCAL_PREFIXES) -> DataFrame:
    """One vendor for each prefix (the first line for it), plus local additions, which never override the main list."""
    rows = ", ".join(f"('{p}', '{n}')" for p, n in extra)
    local = prefixes.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(prefix, name)")
    place = F.col("ord") if "ord" in prefixes.columns else F.lit(0)
    main = prefixes.groupBy("prefix").agg(F.min(F.struct(place.alias("ord"), "name")).alias("_m")).select("prefix", "_m.name")
    return main.unionByName(local.join(main, "prefix", "left_anti"))


def user_agent_votes(http: DataFrame) -> DataFrame:
    """Most frequent operating system per address by user agent."""
    votes = http.select(F.col("src").alias("ip"), V.os_from_user_agent("user_agent").alias("os")).where("os is not null")
    counted = votes.groupBy("ip", "os").agg(F.count("*").alias("n"))
    return counted.groupBy("ip").agg(F.max(F.struct("n", "os")).alias("_m")).select("ip", F.col("_m.os").alias("os"))


def _source(df: DataFrame, rank: int, hostname: bool) -> DataFrame:
    host = F.when(~F.col("hostname").isin("", "-", "*"), F.col("hostname")) if hostname else F.lit(None).cast("string")
    mac = F.when(~F.col("mac").isin("", "-"), F.lower("mac"))
    return df.where(looks_v4("ip")).select("ip", F.lit(rank).alias("rank"), mac.alias("mac"), host.alias("hostname"))


def merge_assets(
    leases: DataFrame, arp: DataFrame, dhcp: DataFrame, http: DataFrame, prefixes: DataFrame, previous: DataFrame
) -> DataFrame:
    """One row per address seen now.

    Hardware address and host name come from leases, then ARP, then the DHCP log. The operating
    system comes from user agents; the device knowledge base fills blanks and, where it is sure,
    replaces another family. What is still empty is carried forward from the previous inventory by
    hardware address, then by address.
    """
    seen = reduce(DataFrame.unionByName, [_source(leases, LEASES, True), _source(arp, ARP, False), _source(dhcp, DHCP, True)])
    pick = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("rank", c)))
    base = seen.groupBy("ip").agg(pick("mac").alias("_m"), pick("hostname").alias("_h")).select(
        "ip", F.coalesce("_m.mac", F.lit("")).alias("mac"), F.coalesce("_h.hostname", F.lit("")).alias("hostname"),
        F.coalesce("_m.rank", F.lit(DHCP)).alias("rank"))
    vendors = vendor_table(prefixes)
    base = base.withColumn("prefix", V.mac_prefix("mac")).join(vendors, "prefix", "left").withColumn(
        "mac_vendor", F.coalesce("name", F.lit(""))).drop("prefix", "name")
    base = base.join(user_agent_votes(http), "ip", "left")
    known_os, sure = V.os_from_device("mac_vendor", "hostname")
    base = base.withColumn("_k", known_os).withColumn("_sure", sure)
    same_family = F.lower(F.coalesce("os", F.lit(""))).startswith(F.lower("_k"))
    replace = F.col("_k").isNotNull() & ~same_family & (F.col("_sure") | F.col("os").isNull())
    base = base.withColumn("os", F.when(replace, F.col("_k")).otherwise(F.coalesce("os", F.lit("")))).drop("_k", "_sure")

    old = previous.select(F.col("ip").alias("_ip"), F.lower("mac").alias("_mac"), "hostname", "os", "open_ports")
    by_mac = old.where("_mac <> ''").groupBy("_mac").agg(F.min(F.struct("_ip", "hostname", "os", "open_ports")).alias("_bm"))
    by_ip = old.groupBy("_ip").agg(F.min(F.struct("hostname", "os", "open_ports")).alias("_bi"))
    j = base.join(by_mac, base["mac"] == by_mac["_mac"], "left").join(by_ip, base["ip"] == by_ip["_ip"], "left")
    fill = lambda c: F.coalesce(
        *[F.when(x != "", x) for x in (F.col(c), F.col(f"_bm.{c}"), F.col(f"_bi.{c}"))], F.lit(""))
    ports = F.coalesce(
        *[F.when(F.size(x) > 0, x) for x in (F.col("_bm.open_ports"), F.col("_bi.open_ports"))], F.array().cast("array<string>"))
    names = F.create_map(*[F.lit(x) for kv in _SOURCE_NAMES.items() for x in kv])
    return j.select(
        "ip", "mac", "mac_vendor", fill("hostname").alias("hostname"), fill("os").alias("os"), ports.alias("open_ports"),
        names[F.col("rank")].alias("source"))


def merge_scan(assets: DataFrame, scans: DataFrame) -> DataFrame:
    """The inventory after port scans (rows of :func:`netsift.sources.lists.scan_results`).

    Addresses that only a scan saw are new. A scan fills a blank name and system; a hardware address it saw replaces the
    known one with its vendor, and the source is the scan then; open ports are added behind the known ones. Several lines
    of an address count in the order of the column ``ord`` where there is one, else of their values: first name and
    system, last hardware address, each port where it came first.
    """
    seen = scans.where("ip <> ''").withColumn("_o", F.col("ord") if "ord" in scans.columns else F.lit(0))
    first = lambda c: F.min(F.when(F.col(c) != "", F.struct("_o", c)))[c]
    last_mac = F.max(F.when(F.col("mac") != "", F.struct("_o", F.lower("mac").alias("mac"), "mac_vendor")))
    hosts = seen.groupBy("ip").agg(first("hostname").alias("_host"), first("os").alias("_os"), last_mac.alias("_m"))
    ports = seen.select("ip", "_o", F.posexplode("open_ports").alias("_p", "port")).groupBy("ip", "port").agg(F.min(F.struct("_o", "_p")).alias("at"))
    ports = ports.groupBy("ip").agg(F.sort_array(F.collect_list(F.struct("at", "port")))["port"].alias("_ports"))  # port numbers bound the list
    j = assets.withColumn("_old", F.lit(True)).join(hosts.join(ports, "ip", "left"), "ip", "full_outer")
    blank = F.lit("")
    fill = lambda c, by: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(by), blank).alias(c)
    none = F.array().cast("array<string>")
    found = F.col("_m").isNotNull() | F.col("_old").isNull()
    return j.select(
        "ip", F.coalesce("_m.mac", "mac", blank).alias("mac"),
        F.when(F.col("_m").isNotNull(), F.coalesce("_m.mac_vendor", blank)).otherwise(F.coalesce("mac_vendor", blank)).alias("mac_vendor"),
        fill("hostname", "_host"), fill("os", "_os"),
        F.array_distinct(F.concat(F.coalesce("open_ports", none), F.coalesce("_ports", none))).alias("open_ports"),
        F.when(found, "scan").otherwise(F.col("source")).alias("source"))


def one_address_per_mac(assets: DataFrame) -> DataFrame:
    """Where a MAC sits on several addresses, keep the one a lease or the DHCP log vouches for."""
    order = F.when(F.col("source").isin("leases", "dhcp"), 0).otherwise(1)
    named = assets.where("mac <> ''")
    place = F.row_number().over(Window.partitionBy("mac").orderBy(order, "ip"))
    return named.withColumn("_p", place).where("_p = 1").drop("_p").unionByName(assets.where("mac = ''"))


def new_devices(assets: DataFrame, known: DataFrame, previous: DataFrame, fp_macs: DataFrame) -> DataFrame:
    """Devices whose MAC was never seen; randomised MACs are marked as gated. Nothing on an empty baseline."""
    low = lambda df: df.select(F.lower("mac").alias("mac")).where("mac <> ''")
    baseline = low(known).unionByName(low(previous)).distinct()
    has_baseline = baseline.limit(1).agg(F.count("*") > 0).scalar()
    fresh = assets.where("mac <> ''").withColumn("mac", F.lower("mac")).where(has_baseline)
    fresh = fresh.join(baseline, "mac", "left_anti").join(low(fp_macs).distinct(), "mac", "left_anti")
    return fresh.select("ip", "mac", "mac_vendor", "hostname", V.is_local_mac("mac").alias("gated"))


def remember_macs(assets: DataFrame, known: DataFrame) -> DataFrame:
    low = lambda df: df.select(F.lower("mac").alias("mac")).where("mac <> ''")
    return low(assets).unionByName(low(known)).distinct()


def device_alerts(fresh: DataFrame) -> DataFrame:
    """Alert events for new devices with a vendor-assigned MAC."""
    vendor = F.when(F.coalesce("mac_vendor", F.lit("")) != "", F.col("mac_vendor")).otherwise("unknown vendor")
    host = F.when(F.coalesce("hostname", F.lit("")) != "", F.concat(F.lit(" ("), "hostname", F.lit(")"))).otherwise("")
    return fresh.where(~F.col("gated")).select(
        F.lit("new_device").alias("type"), F.lit("medium").alias("severity"), F.col("ip").alias("device"),
        F.concat(F.lit("MAC "), "mac", F.lit(" — "), vendor, host).alias("detail"))


def fold_history(history: DataFrame, live: DataFrame, today, days: int = C.ASSET_HISTORY_DAYS) -> DataFrame:
    """History after today's inventory: live values win, first_seen stays, old entries leave."""
    today = F.lit(today).cast("date")
    h, a = history.alias("h"), live.alias("a")
    j = h.join(a, F.col("h.ip") == F.col("a.ip"), "full_outer")
    now = F.col("a.ip").isNotNull()
    take = lambda c: F.when(now, F.col(f"a.{c}")).otherwise(F.col(f"h.{c}")).alias(c)
    out = j.select(
        F.coalesce("a.ip", "h.ip").alias("ip"), *[take(c) for c in ("mac", "mac_vendor", "hostname", "os", "open_ports")],
        F.coalesce("h.first_seen", today).alias("first_seen"), F.when(now, today).otherwise(F.col("h.last_seen")).alias("last_seen"))
    return out.where(F.col("last_seen") >= F.date_sub(today, days))


def replay_dhcp(dhcp: DataFrame, today, days: int = C.ASSET_HISTORY_DAYS) -> DataFrame:
    """History rebuilt from the DHCP logs of the window: latest MAC and host name, first and last day."""
    today = F.lit(today).cast("date")
    rows = dhcp.where((F.col("day") >= F.date_sub(today, days)) & (F.col("day") <= today) & ~F.col("mac").isin("", "-"))
    host = F.when(~F.col("hostname").isin("", "-"), F.struct("day", "hostname"))
    return rows.groupBy("ip").agg(
        F.max(F.struct("day", F.lower("mac").alias("mac")))["mac"].alias("mac"),
        F.coalesce(F.max(host)["hostname"], F.lit("")).alias("hostname"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))


def ghosts(history: DataFrame, live: DataFrame, today, days: int = C.ASSET_HISTORY_DAYS) -> DataFrame:
    """Devices of the last days that are not here now, with their age."""
    age = F.datediff(F.lit(today).cast("date"), F.col("last_seen"))
    return history.join(live.select("ip"), "ip", "left_anti").withColumn("days_ago", age).where(F.col("days_ago").between(0, days))


def labels(ips: DataFrame, manual: DataFrame, leases: DataFrame, assets: DataFrame) -> DataFrame:
    """``ip (name)`` by precedence: manual name, DHCP host, asset host name or vendor."""
    one = lambda df, c, alias: df.where(F.col(c) != "").groupBy("ip").agg(F.min(c).alias(alias))
    asset = assets.select("ip", F.when(F.col("hostname") != "", F.col("hostname")).otherwise(F.col("mac_vendor")).alias("n"))
    j = ips.select("ip").distinct().join(one(manual, "name", "_man"), "ip", "left").join(one(leases, "hostname", "_dhcp"), "ip", "left")
    j = j.join(one(asset, "n", "_asset"), "ip", "left")
    return j.select("ip", V.device_label("ip", "_man", "_dhcp", "_asset").alias("label"))
