"""TLS client fingerprints: parts, labels and the shape heuristic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogues as C
from .ip import col


def cipher_hash(ja4) -> Column:
    """Second part of the fingerprint; empty when there is none."""
    return F.coalesce(F.get(F.split(col(ja4), "_"), F.lit(1)), F.lit(""))


def has_three_parts(ja4) -> Column:
    return F.size(F.split(col(ja4), "_")) >= 3


def shape_label(ja4) -> Column:
    """What the first part alone says; rules in order, null when nothing fits."""
    env = F.when(has_three_parts(ja4), F.get(F.split(col(ja4), "_"), F.lit(0)))
    version = F.substring(env, 2, 2)
    long_enough = F.length(env) >= 3
    return (
        F.when(long_enough & (version == "12") & env.endswith("00"), "TLS 1.2 / no-ALPN (IoT-likely)")
        .when(env.startswith("q"), "QUIC client (Chrome / Apple-family)")
        .when(env.endswith("h1") & long_enough & (version == "13"), "TLS 1.3 / h1 client (system service or app)")
        .when(env.endswith("h2") & long_enough & (version == "13"), "TLS 1.3 / h2 client")
        .when(env.endswith("h3"), "HTTP/3 client")
        .when(env.startswith("t"), "TLS client")
    )


def compose_label(app, library, os_name) -> Column:
    parts = [F.when(F.trim(col(c)) != "", F.trim(col(c))) for c in (app, library)]
    parts.append(F.when(F.trim(col(os_name)) != "", F.concat(F.lit("on "), F.trim(col(os_name)))))
    label = F.concat_ws(" / ", *parts)
    return F.when(label == "", F.lit("Known JA4")).otherwise(label)


def is_threat_label(label) -> Column:
    """Names a malware family and is not just the stock fingerprint of a language runtime."""
    low = F.lower(col(label))
    needles = "|".join(re.escape(n) for n in C.JA4_THREAT_NEEDLES)
    runtimes = "|".join(re.escape(n) for n in C.JA4_GENERIC_RUNTIMES)
    return F.coalesce(low.rlike(needles) & ~low.rlike(runtimes), F.lit(False))
