"""Device rules: operating system hints, MAC addresses, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogues as C
from .ip import col


def _number(text: Column, parts: int) -> Column:
    """The version at the start of ``text`` (``16_5 like ...``): its first ``parts`` numbers joined by dots."""
    version = F.split(F.substring_index(F.trim(text), " ", 1), "[._]")
    digits = F.slice(F.transform(version, lambda x: F.regexp_extract(x, r"^\d+", 0)), 1, parts)
    return F.when((F.size(digits) == parts) & F.forall(digits, lambda x: x != ""), F.array_join(digits, "."))


def _after(ua: Column, mark: str) -> Column:
    """What follows the first ``mark``; null without it."""
    return F.when(ua.contains(mark), F.substring(ua, F.length(F.substring_index(ua, mark, 1)) + len(mark) + 1, F.length(ua)))


def os_from_user_agent(ua) -> Column:
    """Operating system named by a User-Agent header; null when unclear. First rule wins.

    The header is read as products and one comment in parentheses, whose fields are parted by semicolons: the first
    field is the device, a later one names the system and its version.
    """
    ua = col(ua)
    comment = F.substring_index(_after(ua, "("), ")", 1)
    device = F.trim(F.substring_index(comment, ";", 1))
    apple = _number(_after(comment, " OS "), 2)
    mac = _number(_after(ua, "Mac OS X "), 2)
    android = _number(_after(ua, "Android "), 1)
    windows = _number(F.regexp_replace(_after(ua, "Windows NT "), r"[;)].*$", ""), 2)
    windows_name = F.coalesce(*[F.when(windows == k, F.lit(v)) for k, v in C.WINDOWS_NT_NAMES.items()], F.concat(F.lit("Windows NT "), windows))
    on_linux = (device.startswith("X11") & comment.contains("Linux")) | (ua.contains("Linux") & (ua.contains("x86_64") | ua.contains("aarch64")))
    return F.coalesce(
        F.when(device.startswith("iPad"), F.concat(F.lit("iPadOS "), apple)),
        F.when(device.startswith("iPhone"), F.concat(F.lit("iOS "), apple)),
        F.when(device.startswith("iPod"), F.concat(F.lit("iOS "), apple, F.lit(" (iPod)"))),
        F.concat(F.lit("Android "), android),
        F.concat(F.lit("macOS "), mac),
        F.when(ua.contains("com.apple.") | ua.contains("Darwin/"), F.lit("macOS/iOS")),
        F.when(windows.isNotNull(), windows_name),
        F.when(on_linux, F.lit("Linux")),
        F.when(ua.contains("CrOS"), F.lit("Chrome OS")),
        F.when(ua.contains("Sonos/"), F.lit("Sonos")),
    )


def os_from_device(vendor, hostname) -> tuple[Column, Column]:
    """(operating system, high confidence) known for a vendor and host name; null when unknown.

    High-confidence answers may replace an earlier guess, the others only fill blanks.
    """
    v = F.lower(F.coalesce(col(vendor), F.lit("")))
    h = F.lower(F.coalesce(col(hostname), F.lit("")))
    # fixed values: (condition, operating system), first match wins
    sure = [
        (h.rlike(r"^ipad"), "iPadOS"),
        (h.contains("iphone"), "iOS"),
        (h.rlike(r"^(laptop|desktop|pc)-[a-z0-9]"), "Windows 10/11"),
        (h.rlike(r"^awair-elem"), "FreeRTOS (Awair)"),
        (h.rlike(r"^echoshow-"), "Fire OS (Echo Show)"),
        (h.rlike(r"^echo-[0-9a-f]"), "Fire OS (Echo)"),
        (h.rlike(r"^(sonoszp|sonosp)"), "Sonos OS (Linux)"),
        (h.rlike(r"^appletv"), "tvOS"),
        (h.rlike(r"^sm-[a-z0-9]"), "Android (Samsung)"),
        (h.rlike(r"-s\d{2}-ultra|-s\d{2}-plus|-s\d{2}-fe"), "Android (Samsung)"),
        (v.contains("sonos"), "Sonos OS (Linux)"),
        (v.contains("peloton interactive"), "Android (Peloton AOSP)"),
        (v.contains("nest labs"), "Embedded Linux (Nest)"),
        (v.contains("espressif"), "Embedded (ESP32/ESP8266)"),
        (v.contains("raspberry pi"), "Linux (Raspberry Pi OS)"),
    ]
    likely = [
        (v.contains("philips lighting"), "Embedded Linux (Hue Bridge)"),
        (v.contains("amazon technologies") & h.contains("echoshow"), "Fire OS (Echo Show)"),
        (v.contains("amazon technologies"), "Fire OS (Amazon)"),
        (v.contains("apple") & h.rlike(r"-mb|-air|-pro|macbook|imac|mac-mini|mac-pro"), "macOS"),
        (h == "mac", "macOS"),
    ]
    sure_os = F.coalesce(*[F.when(c, F.lit(x)) for c, x in sure])
    likely_os = F.coalesce(*[F.when(c, F.lit(x)) for c, x in likely])
    return F.coalesce(sure_os, likely_os), sure_os.isNotNull()


def is_local_mac(mac) -> Column:
    """Locally administered (randomised) address: bit 0x02 of the first octet."""
    octet = F.get(F.split(col(mac), ":"), F.lit(0))
    value = F.when(octet.rlike(r"^[0-9A-Fa-f]{1,2}$"), F.conv(octet, 16, 10).try_cast("int"))
    return F.coalesce(value.bitwiseAND(F.lit(2)) != 0, F.lit(False))


def mac_prefix(mac) -> Column:
    """Six hex digits that name the vendor."""
    return F.substring(F.regexp_replace(F.upper(col(mac)), "[:-]", ""), 1, 6)


def device_label(ip, manual, dhcp_host, asset_name) -> Column:
    """``ip (name)`` with the first name known: manual, DHCP, asset; else the bare address."""
    name = F.coalesce(*[F.when(col(c) != "", col(c)) for c in (manual, dhcp_host, asset_name)])
    return F.when(name.isNotNull(), F.concat(col(ip), F.lit(" ("), name, F.lit(")"))).otherwise(col(ip))
