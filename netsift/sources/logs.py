"""Text log readers: self-describing sensor logs, IDS logs, finding reports."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, TimestampType

from .. import schemas as T
from ..functions import ip as IP
from ..functions import names as N
from ..session import checkpoint

_DAY_IN_PATH = r"/(\d{4}-\d{2}-\d{2})/"


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with file and position. Unreadable or vanished files are skipped.

    A position is (start of the file block, row number of the scan): it grows along a file, also
    when a large file is read by several tasks.
    """
    df = (
        spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        .text(paths)
    )
    return df.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"))


def _with_latest(lines: DataFrame, markers: DataFrame, value: str) -> DataFrame:
    """Each line with the ``value`` of the latest marker line above it in its file.

    A file has a handful of markers (usually one), so they travel as one small array per file, also to the later blocks of
    a large file. They are written out first: then their size is known, and up to the planner's broadcast limit the lines
    stay where they were read.
    """
    per_file = checkpoint(markers.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("_m")))
    above = F.filter("_m", lambda m: m["pos"] < F.col("pos"))
    return lines.join(per_file, "file").withColumn(value, F.try_element_at(above, F.lit(-1))[value]).drop("_m")


def _typed(cell: Column, dtype) -> Column:
    if isinstance(dtype, ArrayType):
        return F.when(cell.isNotNull(), F.split(cell, ",")).cast(dtype)
    return cell.try_cast(dtype)


def sensor_log(spark: SparkSession, paths, stem: str) -> DataFrame:
    """Tab-separated sensor log whose ``#fields`` line names the columns, per file and anew wherever it recurs.

    Rows shorter than their header are dropped; ``-``, ``(empty)`` and empty cells are null; missing
    columns are null. Adds ``day`` from the dated folder, or from ``ts`` for the live folder.
    """
    schema = StructType.fromDDL(T.LOGS[stem])
    lines = _lines(spark, paths)
    headers = lines.where(F.col("value").startswith("#fields\t")).select(
        "file", "pos", F.expr("slice(split(value, '\t'), 2, size(split(value, '\t')))").alias("fields"))
    rows = _with_latest(lines.where(~F.col("value").startswith("#") & (F.col("value") != "")), headers, "fields")
    cells = F.split("value", "\t")
    rows = rows.where(F.col("fields").isNotNull() & (F.size(cells) >= F.size("fields")))
    rows = rows.withColumn("_r", F.map_from_arrays("fields", F.slice(cells, F.lit(1), F.size("fields"))))
    out = rows.select(
        *[_typed(N.blank_to_null(F.try_element_at("_r", F.lit(f.name))), f.dataType).alias(f.name) for f in schema.fields],
        F.regexp_extract("file", _DAY_IN_PATH, 1).alias("_day"))
    ts = F.timestamp_seconds("ts") if "ts" in schema.names else F.lit(None).cast("timestamp")
    out = out.withColumn("ts", ts)
    return out.withColumn("day", F.coalesce(F.col("_day").try_cast("date"), F.to_date("ts"))).drop("_day")


def day_paths(spark: SparkSession, root: str, pattern: str, today, days: int = 1) -> list[str]:
    """Globs under the dated folders of the last ``days`` days that exist, and under the folders without a date (the live one)."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(Path(root)):
        return []
    last = dt.date.fromisoformat(str(today)[:10])
    wanted = {(last - dt.timedelta(days=k)).isoformat() for k in range(days)}
    names = sorted(s.getPath().getName() for s in fs.listStatus(Path(root)) if s.isDirectory())
    globs = [f"{root}/{n}/{pattern}" for n in names if n in wanted or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", n)]
    return [g for g in globs if fs.globStatus(Path(g))]


def sensor_days(spark: SparkSession, root: str, stem: str, today, days: int = 1) -> DataFrame:
    """The log of the last ``days`` dated folders plus the live folder (which is today's tail); no other folder is listed."""
    today_ = F.lit(today).cast("date")
    paths = day_paths(spark, root, f"{stem}.*log*", today, days)
    if not paths:
        schema = StructType([StructField(f.name, TimestampType() if f.name == "ts" else f.dataType) for f in StructType.fromDDL(T.LOGS[stem])])
        return spark.createDataFrame([], schema.add("day", "date"))
    df = sensor_log(spark, paths, stem)
    return df.where((F.col("day") > F.date_sub(today_, days)) & (F.col("day") <= today_))


def as_conn(raw: DataFrame) -> DataFrame:
    """Sensor column names to the names the operators use."""
    out = raw.select(
        "ts", "day", IP.strip_v4(F.col("`id.orig_h`")).alias("src"), IP.strip_v4(F.col("`id.resp_h`")).alias("dst"),
        F.col("`id.resp_p`").alias("dst_port"), F.lower("proto").alias("proto"), F.coalesce("service", F.lit("")).alias("service"),
        "duration", "orig_ip_bytes", "resp_ip_bytes")
    return out.withColumn("src_local", IP.is_lan("src")).withColumn("dst_local", IP.is_lan("dst"))


def as_ssl(raw: DataFrame) -> DataFrame:
    return raw.select(
        "ts", "day", IP.strip_v4(F.col("`id.orig_h`")).alias("src"), IP.strip_v4(F.col("`id.resp_h`")).alias("dst"),
        F.col("`id.resp_p`").alias("dst_port"), "server_name", F.col("subject").alias("server_subject"), "validation_status",
        F.coalesce(F.col("established").isin("T", "true", "1"), F.lit(False)).alias("established"), "ja4")


def as_dns(raw: DataFrame) -> DataFrame:
    return raw.select("ts", "day", IP.strip_v4(F.col("`id.orig_h`")).alias("src"), "query", "qtype_name", "rcode_name", "answers")


# -- IDS --------------------------------------------------------------------------------------------
def parse_alert_lines(lines: DataFrame) -> DataFrame:
    """One-line IDS alerts as columns; an ``[xN]`` repeat prefix is cut, other lines are dropped.

    The two ``[**]`` marks cut a line into time, rule and facts; the facts are bracketed ``key: value`` tags, the
    protocol in braces and the two ends.
    """
    parts = F.split(F.regexp_replace(F.trim("value"), r"^\[\s*x\d+\]\s*", ""), r"\[\*\*\]")
    piece = lambda i: F.trim(F.get("_p", F.lit(i)))
    sid = F.substring_index(F.substring(piece(1), F.lit(2), F.length(piece(1))), "]", 1)
    rule = F.trim(F.expr("substring(trim(get(_p, 1)), length(substring_index(trim(get(_p, 1)), ']', 1)) + 2)"))
    facts = piece(2)
    tags = F.transform(F.split(F.substring_index(facts, "{", 1), r"\]"), lambda t: F.ltrim(F.regexp_replace(t, r"^\s*\[", "")))
    tag = lambda name: F.trim(F.substring_index(F.get(F.filter(tags, lambda t: t.startswith(name + ":")), F.lit(0)), ":", -1))
    proto = F.substring_index(F.substring_index(facts, "{", -1), "}", 1)
    ends = F.split(F.trim(F.substring_index(facts, "}", -1)), r"\s+->\s+")
    end = lambda i: F.substring_index(F.trim(F.get("_ends", F.lit(i))), " ", 1)
    rows = lines.select(parts.alias("_p")).where((F.size("_p") == 3) & piece(1).startswith("[") & facts.contains("{") & facts.contains("}"))
    rows = rows.select(
        piece(0).alias("_t"), sid.alias("sid"), rule.alias("rule"), F.coalesce(tag("Classification"), F.lit("")).alias("classification"),
        tag("Priority").try_cast("int").alias("priority"), proto.alias("proto"), ends.alias("_ends"))
    src, src_port = IP.split_host_port(end(0))
    dst, dst_port = IP.split_host_port(end(1))
    # fractions of any length; more than six digits are cut
    ts = F.try_to_timestamp(F.concat(F.substring("_t", 1, 19), F.rpad(F.substring(F.substring_index("_t", ".", -1), 1, 6), 6, "0")), F.lit("MM/dd/yyyy-HH:mm:ssSSSSSS"))
    rows = rows.where((F.size("_ends") == 2) & F.col("priority").isNotNull() & (F.col("rule") != "") & F.col("_t").contains("."))
    rows = rows.select(
        ts.alias("ts"), "sid", "rule", "classification", "priority", "proto", src.alias("src_ip"), src_port.alias("src_port"),
        dst.alias("dst_ip"), dst_port.alias("dst_port"))
    return rows.where("ts is not null").withColumn("day", F.to_date("ts"))


def alert_log(spark: SparkSession, paths, today, days: int = 1) -> DataFrame:
    """Current and rotated alert logs, cut to the last ``days`` calendar days."""
    rows = parse_alert_lines(_lines(spark, paths))
    return rows.where(F.col("day") >= F.date_sub(F.lit(today).cast("date"), days - 1))


def alert_events(spark: SparkSession, paths, today=None) -> DataFrame:
    """JSON alert events with their protocol context; malformed lines and other event types are dropped."""
    df = spark.read.schema(T.EVE).option("mode", "DROPMALFORMED").json(paths).where("event_type = 'alert'")
    df = df.withColumn("day", F.substring("timestamp", 1, 10).try_cast("date"))
    return df if today is None else df.where(F.col("day") == F.lit(today).cast("date"))


def rule_catalogue(spark: SparkSession, paths) -> DataFrame:
    """IDS rules, enabled or commented out, with sid, message, class and action.

    A rule is an action, its ends, and options in parentheses; options end at ``;`` (not at ``\\;``) and read ``key: value``.
    """
    line = F.trim("value")
    body = F.ltrim(F.ltrim(line, F.lit("#")))
    rows = _lines(spark, paths).select(line.startswith("#").alias("_off"), body.alias("_b"))
    action = F.substring_index("_b", " ", 1)
    inside = F.expr("substring(_b, instr(_b, '(') + 1)")
    options = F.transform(F.split(inside, r"(?<!\\);"), lambda o: F.trim(o))
    rows = rows.where(action.isin("alert", "drop", "pass", "reject")).withColumn("_o", options)
    key = lambda o: F.trim(F.substring_index(o, ":", 1))
    value = lambda name: F.get(F.transform(
        F.filter("_o", lambda o: o.contains(":") & (key(o) == name)),
        lambda o: F.trim(F.substring(o, F.length(F.substring_index(o, ":", 1)) + 2, F.length(o)))), F.lit(0))
    return rows.select(
        F.coalesce(value("sid"), F.lit("?")).alias("sid"), (~F.col("_off")).alias("enabled"), action.alias("action"),
        F.coalesce(F.trim(value("msg"), F.lit('"')), F.substring("_b", 1, 80)).alias("msg"),
        F.coalesce(value("classtype"), F.lit("")).alias("classtype"))


# -- finding reports --------------------------------------------------------------------------------
def finding_report(spark: SparkSession, paths) -> DataFrame:
    """Sectioned finding reports: a dated header line, then CSV rows that start with a severity."""
    lines = _lines(spark, paths)
    date = F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2})", 1)
    is_header = F.col("value").rlike(r"^\s*┌") | F.col("value").rlike(r"^[┌│└─\s]*\d{4}-\d{2}-\d{2}.*─")
    headers = lines.where(is_header & (date != "")).select("file", "pos", date.alias("section"))
    first = F.trim(F.get(F.split("value", ","), F.lit(0)))
    rows = _with_latest(lines.where(~is_header & first.isin("High", "Medium", "Low", "None", "Critical")), headers, "section")
    schema = ", ".join(f"{c} string" for c in T.REPORT)
    parsed = rows.where("section is not null").select(
        F.col("section").try_cast("date").alias("day"),
        F.regexp_extract("file", r"(\d{8})[^/]*$", 1).alias("report"),
        F.from_csv("value", F.lit(schema), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    text = {c: F.coalesce(F.trim(F.col(f"r.{c}")), F.lit("")) for c in T.REPORT}
    typed = {
        "fqdn": N.clean_name(text["fqdn"]), "score": F.coalesce(text["score"].try_cast("double"), F.lit(0.0)),
        "strobe": F.lower(text["strobe"]) == "true", "threat_intel": F.lower(text["threat_intel"]) == "true",
        "conns": F.coalesce(text["conns"].try_cast("bigint"), F.lit(0)), "total_bytes": F.coalesce(text["total_bytes"].try_cast("bigint"), F.lit(0)),
    }
    return parsed.select("day", "report", *[typed.get(c, text[c]).alias(c) for c in T.REPORT])
