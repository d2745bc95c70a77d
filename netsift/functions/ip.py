"""IP addresses as values: text, numbers and bit strings, CIDR membership."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogues as C

_LOOSE_V4 = r"^(\d{1,3}\.){3}\d{1,3}$"
_STRICT_V4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_v4(c) -> Column:
    """Drop the ``::ffff:`` prefix of a v4-mapped address; real v6 text is left as it is."""
    return F.regexp_replace(col(c), r"^::ffff:", "")


def looks_v4(c) -> Column:
    """Loose dashboard test: four groups of one to three digits."""
    return F.coalesce(col(c).rlike(_LOOSE_V4), F.lit(False))


def is_v4(c) -> Column:
    """Strict test: four octets of at most 255, no leading zeros."""
    return F.coalesce(col(c).rlike(_STRICT_V4), F.lit(False))


def ip_num(c) -> Column:
    """IPv4 text as BIGINT, null for anything else."""
    c = col(c)
    part = F.split(c, r"\.")
    number = sum(
        (F.get(part, F.lit(i)).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
        F.get(part, F.lit(0)).try_cast("bigint") * F.lit(256**3),
    )
    return F.when(is_v4(c), number)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v6_text(c: Column) -> Column:
    """A v6 address with a dotted tail written as its last two groups."""

    def hexed(tail: Column) -> Column:
        octets = F.transform(F.split(tail, r"\."), lambda o: o.try_cast("int"))
        return _let(octets, lambda o: F.concat(F.hex(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1))), F.lit(":"), F.hex(F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)))))

    tail = F.substring_index(c, ":", -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    return F.when(c.contains(":") & is_v4(tail), F.concat(head, hexed(tail))).otherwise(c)


def _v6_groups(c: Column) -> Column:
    """The eight groups of a v6 address (one ``::`` filled with zeros); null when the text is not an address."""
    groups = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))
    sides = F.split(c, "::", -1)  # one side: no gap; two sides: one gap

    def filled(s: Column) -> Column:
        both = F.struct(groups(F.get(s, F.lit(0))).alias("l"), groups(F.get(s, F.lit(1))).alias("r"))
        return _let(both, lambda x: _let(
            F.lit(8) - F.size(x["l"]) - F.size(x["r"]),
            lambda gap: F.when(gap >= 1, F.concat(x["l"], F.array_repeat(F.lit("0"), gap), x["r"]))))

    eight = _let(sides, lambda s: F.when(F.size(s) == 1, F.split(F.get(s, F.lit(0)), ":", -1)).when(F.size(s) == 2, filled(s)))
    return _let(eight, lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")), g))


def ip_bits(c) -> Column:
    """Address as a string of 32 (v4) or 128 (v6) binary digits; null when it is not an address.

    Prefixes of this string are networks, so CIDR membership becomes equality of prefixes.
    """

    def v6(text: Column) -> Column:
        digits = lambda groups: F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
        return _let(_v6_groups(text), lambda groups: F.when(groups.isNotNull(), digits(groups)))

    v4 = lambda a: F.lpad(F.bin(ip_num(a)), 32, "0")
    return _let(strip_v4(c), lambda a: F.when(is_v4(a), v4(a)).when(a.contains(":"), _let(_v6_text(a), v6)))


def cidr_prefix(c) -> Column:
    """Network prefix of CIDR text as binary digits (host bits are ignored); null when invalid."""
    parts = F.split(F.trim(col(c)), "/")
    bits = ip_bits(F.get(parts, F.lit(0)))
    plen = F.coalesce(
        F.when(F.size(parts) == 1, F.length(bits)),
        F.get(parts, F.lit(1)).try_cast("int"),
    )
    ok = (F.size(parts) <= 2) & (plen >= 0) & (plen <= F.length(bits))
    return F.when(ok, F.substring(bits, F.lit(1), plen))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def _cidr_regex(net: ipaddress.IPv4Network) -> str:
    """Regular expression of the dotted addresses of one block."""
    octets = net.network_address.packed
    whole, rest = divmod(net.prefixlen, 8)
    parts = [str(o) for o in octets[:whole]]
    if rest:
        first = octets[whole]
        parts.append("(?:" + "|".join(str(o) for o in range(first, first + (1 << (8 - rest)))) + ")")
    parts += [_OCTET] * (4 - len(parts))
    return r"\.".join(parts)


def in_cidrs(c, cidrs: list[str]) -> Column:
    """Membership in a short, fixed list of IPv4 blocks as one pattern test.

    Invalid blocks are skipped, an invalid address is in none.
    """
    nets = []
    for text in cidrs:
        try:
            nets.append(ipaddress.ip_network(text, strict=False))
        except ValueError:
            continue
    patterns = [_cidr_regex(n) for n in nets if n.version == 4]
    if not patterns:
        return F.lit(False)
    return F.coalesce(col(c).rlike("^(?:" + "|".join(patterns) + ")$"), F.lit(False))


def cidr_label(c, labelled: list[tuple[str, str]]) -> Column:
    """Label of the first block of a short fixed list that holds the address."""
    return F.coalesce(*[F.when(in_cidrs(c, [net]), F.lit(label)) for net, label in labelled])


def is_lan(c, cidrs: list[str] = C.LAN_CIDRS) -> Column:
    return in_cidrs(c, cidrs)


def is_exit_net(c) -> Column:
    return in_cidrs(c, C.EXIT_NETS)


def vendor_net(c) -> Column:
    return cidr_label(c, C.VENDOR_NETS)


def is_public_v4(c) -> Column:
    """A v4 address that can be a destination on the open internet."""
    return is_v4(c) & (
        ~in_cidrs(c, C.NON_PUBLIC_V4) | in_cidrs(c, C.PUBLIC_V4_EXCEPTIONS)
    )


def ip_sort_key(c) -> Column:
    """Numeric order of addresses; use with ``asc_nulls_last`` so malformed ones come last."""
    return ip_num(c)


def split_host_port(c) -> tuple[Column, Column]:
    """``addr:port`` or ``[v6]:port`` into address and port; no digits after the last colon = no port."""
    c = col(c)
    bracket = F.regexp_extract(c, r"^\[([^\]]+)\]:(\d+)$", 1)
    plain = F.regexp_extract(c, r"^(.*):(\d+)$", 1)
    port = F.regexp_extract(c, r":(\d+)$", 1)
    has_port = (bracket != "") | c.rlike(r"^.*:\d+$")
    host = F.when(bracket != "", bracket).when(has_port, plain).otherwise(c)
    return host, F.when(has_port, port.try_cast("int"))
