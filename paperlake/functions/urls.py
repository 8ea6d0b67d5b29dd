"""Link rules: normalise, screen, accept and name (column expressions over URL text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions.text import strip

# Hosts whose answers are accepted whatever content type they claim.
ACADEMIC_HOSTS = (
    "arxiv.org",
    "www.arxiv.org",
    "export.arxiv.org",
    "openreview.net",
    "proceedings.neurips.cc",
    "aclanthology.org",
    "dl.acm.org",
    "ieeexplore.ieee.org",
    "link.springer.com",
    "www.biorxiv.org",
    "www.medrxiv.org",
    "github.com",
    "raw.githubusercontent.com",
)
# Hosts that are never fetched.
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "[::1]")
PDF_CONTENT_TYPES = ("application/pdf", "application/octet-stream")
DEFAULT_FILE_NAME = "downloaded_paper.pdf"

# Generic URI syntax (RFC 3986, appendix B). Unlike parse_url it never rejects a link for a stray character.
_URI = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)"
# IANA special-purpose IPv4 blocks, multicast and reserved space, as (first address, prefix length, reason).
IPV4_BLOCKS = (
    ("0.0.0.0", 8, "private_network"),
    ("10.0.0.0", 8, "private_network"),
    ("100.64.0.0", 10, "non_public_address"),
    ("127.0.0.0", 8, "non_public_address"),
    ("169.254.0.0", 16, "private_network"),
    ("172.16.0.0", 12, "private_network"),
    ("192.0.0.0", 24, "non_public_address"),
    ("192.0.2.0", 24, "non_public_address"),
    ("192.168.0.0", 16, "private_network"),
    ("198.18.0.0", 15, "non_public_address"),
    ("198.51.100.0", 24, "non_public_address"),
    ("203.0.113.0", 24, "non_public_address"),
    ("224.0.0.0", 3, "non_public_address"),
)
LOCAL_SUFFIXES = (".local", ".internal", ".localhost")
# Global unicast is 2000::/3; the rest of IPv6 is private, reserved, link-local or multicast.
_GLOBAL_IPV6 = r"\A[23][0-9a-f]{3}:"
# 2001::/23, the documentation blocks and 6to4.
_SPECIAL_IPV6 = r"\A(2001:([01]?[0-9a-f]{1,2}|0[01][0-9a-f]{2}|0?db8)?:|2002:|3fff:0?[0-9a-f]{0,3}:)"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URI, 1))


def host(url: Column) -> Column:
    """Lower-cased host without user info, port, brackets or the dot of the root domain."""
    authority = F.regexp_replace(F.regexp_extract(url, _URI, 2), r"\A.*@", "")
    bracketed = F.regexp_extract(authority, r"\A\[([^\]]*)\]", 1)
    name = F.lower(F.when(F.length(bracketed) > 0, bracketed).otherwise(F.substring_index(authority, ":", 1)))
    return F.regexp_replace(name, r"\.+\z", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URI, 3)


def _number(part: Column) -> Column:
    """Value of one part of an IPv4 address in decimal, octal (0…) or hexadecimal (0x…) notation; null for other text."""
    hexadecimal, octal = part.rlike(r"\A0x[0-9a-f]*\z"), part.rlike(r"\A0[0-7]*\z")
    digits = F.when(hexadecimal, F.substring(part, 3, 20)).otherwise(part)
    short = F.length(digits) <= 12
    return (
        F.when(hexadecimal & short, F.coalesce(F.conv(F.nullif(digits, F.lit("")), 16, 10), F.lit("0")))
        .when(octal & short, F.conv(digits, 8, 10))
        .when(part.rlike(r"\A[1-9][0-9]*\z") & short, part)
        .cast("bigint")
    )


def ipv4_number(name: Column) -> Column:
    """The address a host name spells, as a number, or null where it is a name.

    All spellings that resolvers take are read: one to four parts, each decimal, octal or hexadecimal, where the last
    part fills all the bytes that are left.
    """
    def address(parts: Column) -> Column:
        lead, last = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), F.size(parts))
        valid = F.forall(parts, lambda x: x.isNotNull()) & F.forall(lead, lambda x: x < 256) & (last < room)
        number = F.aggregate(lead, F.lit(0).cast("bigint"), lambda total, x: total * 256 + x) * room + last
        return F.when((F.size(parts) <= 4) & valid, number)

    return _let(F.transform(F.slice(F.split(name, r"\."), 1, 5), _number), address)


def normalize_url(c: Column) -> Column:
    """Trim, default to https, and rewrite arXiv abstract pages and code-host blob pages to the file itself."""
    url = strip(c)
    url = F.when(url.rlike(r"\Ahttps?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return _let(url, _rewritten)


def _rewritten(url: Column) -> Column:
    return _let(F.struct(host(url).alias("h"), path(url).alias("p")), lambda x: _file_address(url, x["h"], x["p"]))


def _file_address(url: Column, h: Column, p: Column) -> Column:
    steps = F.split(p, "/")
    kind, rest = F.get(steps, F.lit(1)), F.substring(p, F.lit(6), F.length(p))
    paper = F.when(rest.endswith("/") & (F.length(rest) > 1), F.left(rest, F.length(rest) - 1)).otherwise(rest)
    on_arxiv = h.isin("arxiv.org", "www.arxiv.org") & (paper != "")
    blob = (F.get(steps, F.lit(3)) == "blob") & (F.get(steps, F.lit(1)) != "") & (F.get(steps, F.lit(2)) != "")
    inside = F.array_join(F.slice(steps, F.lit(5), F.greatest(F.size(steps) - 4, F.lit(0))), "/")
    return (
        F.when(
            on_arxiv & ((kind == "abs") | ((kind == "pdf") & ~p.endswith(".pdf"))),
            F.concat(F.lit("https://arxiv.org/pdf/"), paper, F.lit(".pdf")),
        )
        .when(
            h.isin("github.com", "www.github.com") & blob & (inside != ""),
            F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), F.get(steps, F.lit(1)), F.get(steps, F.lit(2)), inside),
        )
        .otherwise(url)
    )


def screen_url(url: Column) -> Column:
    """Reason for refusing a link, or null. Names are not resolved: that would be a network call per row."""
    blocks = []
    for first, length, why in IPV4_BLOCKS:
        octets = [int(x) for x in first.split(".")]
        number = sum(octet << shift for octet, shift in zip(octets, (24, 16, 8, 0), strict=True))
        blocks.append((32 - length, number >> (32 - length), why))

    def of_host(h: Column, address: Column) -> Column:
        reason = F.when(h.isin(*BLOCKED_HOSTS) | (h == ""), "blocked_host")
        for suffix in LOCAL_SUFFIXES:
            reason = reason.when(h.endswith(suffix), "private_network")
        for shift, block, why in blocks:
            reason = reason.when(F.shiftright(address, shift) == block, why)
        # A name that ends in a number is an address or nothing.
        reason = reason.when(address.isNull() & h.rlike(r"(\A|\.)(0x[0-9a-f]*|[0-9]+)\z"), "non_public_address")
        outside = ~h.rlike(_GLOBAL_IPV6) | h.rlike(_SPECIAL_IPV6)
        return reason.when(h.contains(":") & outside, "non_public_address")

    refused = _let(host(url), lambda h: _let(ipv4_number(h), lambda address: of_host(h, address)))
    return F.when(~scheme(url).isin("http", "https"), "bad_scheme").otherwise(refused)


def accepts_content_type(content_type: Column, url: Column) -> Column:
    base = strip(F.substring_index(F.lower(F.coalesce(content_type, F.lit(""))), ";", 1))
    return base.isin(*PDF_CONTENT_TYPES) | host(url).isin(*ACADEMIC_HOSTS)


def url_filename(url: Column, content_disposition: Column) -> Column:
    """The name the server gave if it is a PDF name, else the last path segment, else a default."""
    fields = F.transform(F.split(F.coalesce(content_disposition, F.lit("")), ";"), lambda x: strip(x))
    named = F.get(F.filter(fields, lambda x: x.startswith("filename=")), F.lit(0))
    given = F.regexp_replace(F.substring(named, F.lit(10), F.length(named)), r'\A"|"\z', "")
    segment = F.regexp_extract(path(url), r"([^/]+)/*\z", 1)
    return (
        F.when(F.lower(given).endswith(".pdf"), given)
        .when(segment.contains("."), segment)
        .when(segment != "", F.concat(segment, F.lit(".pdf")))
        .otherwise(DEFAULT_FILE_NAME)
    )
