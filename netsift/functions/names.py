"""Host names, owners and services: matching and normalising rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogues as C
from .ip import col, looks_v4


def blank_to_null(c) -> Column:
    """Log text null markers: empty, ``-`` and ``(empty)``."""
    c = col(c)
    return F.when(~c.isin("", "-", "(empty)"), c)


def clean_name(c) -> Column:
    """Names compare without the root dot."""
    return F.regexp_replace(F.trim(col(c)), r"\.+$", "")


def has_suffix(c, suffixes: list[str]) -> Column:
    """Lower-cased name equals a suffix or ends with ``.`` + suffix.

    Both mean that the name's last labels are the suffix, so each length is one set test.
    """
    name = F.lower(F.trim(col(c)))
    by_length: dict[int, list[str]] = {}
    for s in suffixes:
        by_length.setdefault(s.count(".") + 1, []).append(s)
    test = F.lit(False)
    for n, group in sorted(by_length.items()):
        test = test | F.substring_index(name, ".", -n).isin(group)
    return F.coalesce(test, F.lit(False))


def sni_matches(c, exact: list[str], suffixes: list[str]) -> Column:
    """Server name is one of ``exact`` or ends with one of ``suffixes`` (which carry their dot)."""
    name = F.lower(blank_to_null(c))
    hit = name.isin([e.lower() for e in exact]) if exact else F.lit(False)
    if suffixes:
        hit = hit | name.rlike("(" + "|".join(re.escape(s.lower()) for s in suffixes) + ")$")
    return F.coalesce(hit, F.lit(False))


def glob_to_regex(pattern: str) -> str:
    """Shell glob (``* ? [..]``, case-sensitive) as an anchored Java regular expression."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close]
            negate = body.startswith("!")
            body = body[1:] if negate else body
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body)
            out.append("[" + ("^" if negate else "") + body + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def literal_regex(text: str) -> str:
    return re.escape(text)


def glob_literals(pattern: str) -> list[str]:
    """The literal runs of a glob: every value it matches holds each of them."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch in "*?" or close > 0:
            runs.append(run)
            run = ""
            i = max(i, close)
        else:
            run += ch
        i += 1
    return [r for r in [*runs, run] if r]


def glob_matches(c, pattern: str) -> Column:
    """One glob as an expression; ``*.x`` also matches the apex ``x``."""
    c = col(c)
    hit = c.rlike(glob_to_regex(pattern))
    if pattern.startswith("*."):
        hit = hit | (c == F.lit(pattern[2:]))
    return F.coalesce(hit, F.lit(False))


def label_suffixes(c) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: what ``*.x`` patterns are looked up by."""
    labels = F.split(col(c), r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def is_hyperscaler_org(org) -> Column:
    pattern = "|".join(re.escape(t) for t in C.HYPERSCALER_TOKENS)
    return F.coalesce(F.lower(col(org)).rlike(pattern), F.lit(False))


def is_hyperscaler_name(name) -> Column:
    return has_suffix(name, C.HYPERSCALER_SUFFIXES)


def is_safe_org(org) -> Column:
    return F.coalesce(col(org).isin(C.SAFE_ORGS), F.lit(False))


def is_safe_name(name) -> Column:
    return has_suffix(name, C.SAFE_SUFFIXES)


def is_safe_dest(dst, fqdn, org) -> Column:
    """Known-safe by name, or a bare IPv4 of a known-safe owner."""
    return is_safe_name(fqdn) | (looks_v4(F.trim(col(dst))) & is_safe_org(org))


def first_label(c, catalogue: list[tuple[str, str]]) -> Column:
    """Label of the first case-insensitive pattern found in the text."""
    c = col(c)
    return F.coalesce(*[F.when(c.rlike("(?i)" + rx), F.lit(label)) for rx, label in catalogue])


def telemetry_vendor(c) -> Column:
    return first_label(c, C.TELEMETRY_VENDORS)


def benign_vendor(c) -> Column:
    return first_label(c, C.BENIGN_VENDORS)


def is_benign_name(c) -> Column:
    """Does any benign vendor pattern match? One pattern instead of a chain."""
    return F.coalesce(col(c).rlike("(?i)" + "|".join(f"(?:{rx})" for rx, _ in C.BENIGN_VENDORS)), F.lit(False))


def registrable_pattern(c) -> Column:
    """Default suppression pattern of a name: ``*.`` + its registrable domain."""
    name = F.lower(clean_name(c))
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - F.lit(k - 1), F.lit(1)), F.lit(k)), ".")
    take3 = last(2).isin(C.MULTI_LABEL_SUFFIXES)
    wild = F.concat(F.lit("*."), F.when(take3, last(3)).otherwise(last(2)))
    literal = ~name.contains(".") | name.rlike(r"^[0-9.]+$") | name.isin(C.MULTI_LABEL_SUFFIXES)
    return F.when(literal, name).otherwise(wild)


def registrable_domain(c) -> Column:
    return F.regexp_replace(registrable_pattern(c), r"^\*\.", "")


def sld_entropy(c) -> Column:
    """Shannon entropy (bits per character) of the second-level label; 0 below eight characters."""
    labels = F.split(F.lower(F.regexp_replace(col(c), r"\.+$", "")), r"\.")
    label = F.get(labels, F.size(labels) - F.lit(2))
    chars = F.split(label, "")
    chars = F.filter(chars, lambda x: x != "")
    n = F.size(chars)

    def term(ch):
        share = F.size(F.filter(chars, lambda x: x == ch)) / n
        return -share * F.log2(share)

    total = F.aggregate(F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda a, x: a + x)
    ok = (F.size(labels) >= 2) & (F.length(label) >= C.ENTROPY_MIN_LABEL)
    return F.when(ok, total).otherwise(F.lit(0.0))


def is_lookup_noise(c) -> Column:
    """Reverse lookups and local zones, which the DNS panel leaves out."""
    return F.coalesce(col(c).rlike(r"\.(in-addr\.arpa|ip6\.arpa|local|internal|lan)$"), F.lit(False))


def subject_cn(c) -> Column:
    """CN of a certificate subject, or the whole subject when it has none."""
    c = col(c)
    cn = F.trim(F.regexp_extract(c, r"(?i)(?:^|,)\s*CN=([^,]*)", 1))
    has_cn = c.rlike(r"(?i)(?:^|,)\s*CN=")
    return F.when(has_cn, cn).otherwise(c)


def longpoll_only(names, suffix: str = C.RELAY_LONGPOLL_SUFFIX) -> Column:
    """True only for a non-empty set of names that all end with the long-poll suffix."""
    names = col(names)
    return F.coalesce(
        (F.size(names) > 0) & F.forall(names, lambda s: F.lower(s).endswith(suffix)), F.lit(False)
    )


def annotate_dest(dest, org, city, cc) -> Column:
    """``ip (org, city, cc)`` for bare addresses; names stay as they are."""
    dest = col(dest)
    detail = F.concat_ws(", ", *[F.when(col(x) != "", col(x)) for x in (org, city, cc)])
    return F.when(looks_v4(F.trim(dest)) & (detail != ""), F.concat(dest, F.lit(" ("), detail, F.lit(")"))).otherwise(dest)


def first_port(service) -> Column:
    """Port number in front of ``443:tcp:ssl``; 0 when there is none."""
    port = F.get(F.split(col(service), ":"), F.lit(0))
    return F.coalesce(F.trim(port).try_cast("int"), F.lit(0))


def hours_ago(c) -> Column:
    """``N hours ago`` / ``N minutes ago`` as hours."""
    text = F.lower(F.trim(col(c)))
    h = F.regexp_extract(text, r"^(\d+)\s+hours?\s+ago", 1)
    m = F.regexp_extract(text, r"^(\d+)\s+minutes?\s+ago", 1)
    return F.when(h != "", h.try_cast("double")).when(m != "", m.try_cast("double") / 60)


def rule_category(c) -> Column:
    """First two words of an alert rule name."""
    words = F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " ")).otherwise(col(c))


def is_infra_noise(c) -> Column:
    c = col(c)
    test = F.lit(False)
    for prefix in C.INFRA_NOISE_PREFIXES:
        test = test | c.startswith(prefix)
    return F.coalesce(test, F.lit(False))

