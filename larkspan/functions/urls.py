"""URL predicates and parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import blank_to_null, let

# Local names, reserved ranges and image suffixes.
LOCAL_NAME = r"^localhost$|\.localhost$|\.local$|\.internal$"
# A number of an IPv4 address is decimal, octal (0...) or hexadecimal (0x...); the last one fills what is left.
IPV4 = r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+)){0,3}\.?$"
IPV6 = r"^\[[0-9a-f:.]+\]$"
IMAGE_SUFFIXES = ("webp", "png", "jpe?g", "gif", "svg")
IMAGE_URL = r"(?i)https?://[^\s\"'<>)]+\.(?:{suffixes})(?:\?[^\s\"'<>]*)?"


def scheme_of(url: Column) -> Column:
    return F.lower(blank_to_null(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; IPv6 keeps its brackets."""
    return F.lower(
        blank_to_null(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    )


def url_allowed(url: Column, hosts: Sequence[str]) -> Column:
    """http or https, and a host of the list."""
    return F.coalesce(scheme_of(url).isin("http", "https") & host_of(url).isin(*hosts), F.lit(False))


def _reserved(address: Column) -> Column:
    """A 32-bit address of a private or reserved range."""
    a, b = F.shiftright(address, 24), F.shiftright(address, 16) % 256
    return (
        a.isin(0, 10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
    )


def _ipv4(host: Column) -> Column:
    """The 32-bit value of an IPv4 address in any spelling of a URL, null for other hosts."""
    digits = lambda p, base, skip: F.conv(F.concat(F.lit("0"), F.substring(p, F.lit(skip + 1), F.length(p))), base, 10).cast("long")
    number = lambda p: F.when(p.startswith("0x"), digits(p, 16, 2)).when(p.rlike("^0[0-7]+$"), digits(p, 8, 1)).otherwise(p.try_cast("long"))

    def value(parts: Column) -> Column:
        n = F.size(parts)
        head = F.aggregate(F.slice(parts, 1, n - 1), F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)
        rest = F.element_at(parts, -1)
        whole = head * F.pow(F.lit(256), 5 - n).cast("long") + rest
        return F.when(rest < F.pow(F.lit(256), 5 - n).cast("long"), whole)

    parts = F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number)
    return F.when(host.rlike(IPV4), let(parts, value))


def _ipv6(host: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address in brackets, null for other hosts."""
    group = lambda g: F.conv(g, 16, 10).cast("long")
    groups = lambda text: F.transform(F.filter(F.split(text, ":"), lambda g: g != ""), group)
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    tail = _ipv4(blank_to_null(F.regexp_extract(bare, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)))
    hexed = F.concat(F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail % 65536)))
    text = F.when(tail.isNull(), bare).otherwise(F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), hexed))

    def filled(t: Column) -> Column:
        left, right = groups(F.substring_index(t, "::", 1)), groups(F.substring_index(t, "::", -1))
        zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
        return F.when(t.contains("::"), F.concat(left, zeros, right)).otherwise(groups(t))

    return F.when(host.rlike(IPV6), let(text, filled))


def url_is_public(url: Column) -> Column:
    """http or https, and neither a local name nor a private or reserved address."""
    public = let(host_of(url), lambda host: ~_is_private(host))
    return F.coalesce(scheme_of(url).isin("http", "https") & public, F.lit(False))


def _is_private(host: Column) -> Column:
    def v6(groups: Column) -> Column:
        lead = F.aggregate(F.slice(groups, 1, 5), F.lit(0).cast("long"), lambda acc, g: acc + g)
        six, low, lowest = groups[5], groups[6], groups[7]
        local = (lead == 0) & (six == 0) & (low == 0) & lowest.isin(0, 1)
        unique = (F.shiftright(groups[0], 9) == 126) | (groups[0] == 0xFE80)  # fc00::/7 and fe80
        return local | unique | ((lead == 0) & (six == 0xFFFF) & _reserved(low * 65536 + lowest))

    return host.rlike(LOCAL_NAME) | F.coalesce(_reserved(_ipv4(host)), F.lit(False)) | F.coalesce(let(_ipv6(host), v6), F.lit(False))


def query_value(url: Column, name: str) -> Column:
    """First value of a query parameter, null when absent."""
    return blank_to_null(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))


def image_urls(text: Column, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> Column:
    """All image URLs of a text, in order."""
    return F.regexp_extract_all(text, F.lit(IMAGE_URL.replace("{suffixes}", "|".join(suffixes))), F.lit(0))


def normal_path(path: Column) -> Column:
    """Lexical form of an absolute path: `.` and empty parts dropped, `..` removes the part before."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def path_within(path: Column, root: str) -> Column:
    """The normalised path lies below the root (a sibling with the same prefix does not)."""
    base = root.rstrip("/")
    normal = normal_path(path)
    return (normal == base) | normal.startswith(base + "/")
