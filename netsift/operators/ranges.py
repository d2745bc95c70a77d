"""Address-to-network joins without inequality predicates.

A network is a prefix of the address's bit string. Every distinct address is expanded to the
prefix lengths that occur in the table (at most 33 for v4 and 129 for v6, usually a dozen) and
matched by plain equality, so the join hashes evenly: no nested loop, no bucket that collects all
pairs of a busy /8, and no side that has to fit on one machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip as IP
from .skew import left_lookup

_RANK_STEP = 1 << 48


def cidr_table(df: DataFrame, cidr: str = "cidr", order: str = "ord") -> DataFrame:
    """Parse a CIDR list; rows that are not a network are dropped. ``order`` is the list position."""
    prefix = IP.cidr_prefix(cidr)
    fam = F.when(F.col(cidr).contains(":") & ~F.col(cidr).startswith("::ffff:"), F.lit(128)).otherwise(F.lit(32))
    return (
        df.withColumn("prefix", prefix)
        .where(F.col("prefix").isNotNull())
        .withColumn("fam", fam)
        .withColumn("plen", F.length("prefix"))
        .withColumn("ord", F.col(order).cast("bigint"))
    )


def range_table(df: DataFrame, lo: str = "lo", hi: str = "hi", order: str = "ord") -> DataFrame:
    """Turn inclusive IPv4 ranges (numbers) into the minimal set of prefixes that covers each."""
    lo_, end = F.col(lo), F.col(hi) + 1

    def blocks(level: Column) -> Column:
        # Aligned blocks of 2**level addresses that sit at the left and right edge of the range.
        size = F.pow(F.lit(2.0), level).cast("bigint")
        left = F.ceil(lo_ / size).cast("bigint")
        right = F.floor(end / size).cast("bigint")
        block = lambda use, number: F.when(
            (left < right) & use,
            F.struct(number.alias("number"), (F.lit(32) - level).alias("plen")),
        )
        return F.array(
            block(left % 2 == 1, left), block(right % 2 == 1, right - 1),
        )

    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), blocks))
    return (
        df.where(lo_ <= F.col(hi))
        .withColumn("_p", F.explode(F.array_compact(parts)))
        .withColumn("fam", F.lit(32))
        .withColumn("plen", F.col("_p.plen"))
        .withColumn(
            "prefix",
            F.when(F.col("plen") == 0, F.lit("")).otherwise(
                F.expr("lpad(bin(_p.number), plen, '0')")
            ),
        )
        .withColumn("ord", F.col(order).cast("bigint"))
        .drop("_p")
    )


def range_prefixes(lo: Column, hi: Column) -> Column:
    """The fewest prefixes that cover ``lo`` to ``hi``, two strings of binary digits of one length; null if there are none.

    Below the digit where the ends part, the lower half is covered by ``lo`` without its trailing zeros and by the right
    neighbour of every further zero on the way to it, the upper half likewise with ones; two whole halves are one prefix.
    Works on digits, so 128 of them are as good as 32.
    """
    width = F.length(lo)

    def cover(d: Column) -> Column:
        """``d``: place of the first digit that differs (from 1); 0: none does."""
        cut = lambda bits, digit: F.rpad(F.rtrim(bits, F.lit(digit)), F.greatest(F.length(F.rtrim(bits, F.lit(digit))), d), digit)
        low, high = cut(lo, "0"), cut(hi, "1")

        def side(edge: Column, digit: str, other: str) -> Column:
            inner = F.sequence(d + 1, F.length(edge) - 1)
            steps = F.transform(inner, lambda i: F.when(F.substring(edge, i, F.lit(1)) == digit, F.concat(F.substring(edge, F.lit(1), i - 1), F.lit(other))))
            return F.concat(F.array(edge), F.when(F.length(edge) - 1 >= d + 1, F.array_compact(steps)).otherwise(F.array().cast("array<string>")))

        whole = (F.length(low) == d) & (F.length(high) == d)
        parts = F.when(whole, F.array(F.substring(lo, F.lit(1), d - 1))).otherwise(F.concat(side(low, "0", "1"), side(high, "1", "0")))
        return F.when(d == 0, F.array(lo)).otherwise(parts)

    same = F.transform(F.sequence(F.lit(1), width), lambda i: F.substring(lo, i, F.lit(1)) == F.substring(hi, i, F.lit(1)))
    found = F.transform(F.array(F.array_position(same, F.lit(False)).cast("int")), cover)
    return F.when((width == F.length(hi)) & (lo <= hi), F.get(found, F.lit(0)))


def address_range_table(df: DataFrame, lo: str = "lo", hi: str = "hi", order: str = "ord") -> DataFrame:
    """Inclusive ranges given as addresses, v4 and v6 in one list, as prefixes for :func:`lookup`.

    Rows whose ends are not addresses, of two families or in the wrong order are dropped.
    """
    rows = df.withColumns({"_lo": IP.ip_bits(lo), "_hi": IP.ip_bits(hi)})
    rows = rows.withColumn("prefix", F.explode(range_prefixes(F.col("_lo"), F.col("_hi"))))
    return rows.select(*df.columns, "prefix", F.length("_lo").alias("fam"), F.length("prefix").alias("plen")).withColumn("ord", F.col(order).cast("bigint"))


def lookup(
    ips: DataFrame, ip: str, table: DataFrame, payload: list[str], pick: str = "longest"
) -> DataFrame:
    """One row ``(ip, *payload)`` per distinct address that falls into a network of ``table``.

    ``pick``: ``longest`` prefix (ties by list order) or ``first`` in list order.
    """
    rank = F.col("ord")
    if pick == "longest":
        rank = (F.lit(128) - F.col("plen")).cast("bigint") * F.lit(_RANK_STEP) + F.col("ord")
    table = table.withColumn("_rank", rank)
    nets = table.groupBy("fam", "plen", "prefix").agg(F.min("_rank").alias("_rank"))
    lengths = table.agg(F.collect_set(F.struct("fam", "plen"))).scalar()
    bits = IP.ip_bits(F.col(ip))
    probes = (
        ips.select(ip).distinct()
        .withColumn("_bits", bits)
        .where(F.col("_bits").isNotNull())
        .withColumn("_lens", lengths)
        .withColumn("_len", F.explode(F.filter("_lens", lambda x: x["fam"] == F.length("_bits"))))
        .select(
            ip, F.col("_len.fam").alias("fam"), F.col("_len.plen").alias("plen"),
            F.expr("substring(_bits, 1, _len.plen)").alias("prefix"),
        )
    )
    best = probes.join(nets, ["fam", "plen", "prefix"]).groupBy(ip).agg(F.min("_rank").alias("_rank"))
    # A range that needs several prefixes repeats its payload under different ranks; ranks that are
    # shared by such prefixes carry the same payload, so one row per rank is enough.
    by_rank = table.select("_rank", *payload).dropDuplicates(["_rank"])
    return best.join(by_rank, "_rank").select(ip, *payload)


def with_ranges(
    df: DataFrame, ip: str, table: DataFrame, payload: list[str], pick: str = "longest",
    ips: DataFrame | None = None,
) -> DataFrame:
    """``df`` plus the payload of the network its address falls into (null when none).

    ``ips`` may name a simpler table that holds all the addresses, so a long chain of steps that
    leads to ``df`` is not planned a second time just to list them.
    """
    found = lookup(df if ips is None else ips, ip, table, payload, pick).withColumnRenamed(ip, "_ip")
    return left_lookup(df, F.col(ip), found, "_ip").select(ip, *[c for c in df.columns if c != ip], *payload)
