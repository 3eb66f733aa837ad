"""Which URLs may be fetched: http(s) with a host that is not a private or reserved address."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 blocks that are not public, as (first address, prefix length): private, loopback, link-local, multicast,
#: reserved and unspecified ones of the IANA registry.
BLOCKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = f"^{OCTET}(?:\\.{OCTET}){{3}}$"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and brackets."""
    rest = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)", 1)
    rest = F.regexp_replace(rest, "^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(rest, ":[0-9]*$", ""), "^\\[|\\]$", ""))


def ipv4_number(host: Column) -> Column:
    parts = F.split(host, "\\.")
    return sum((F.get(parts, i).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))


def public_literal(host: Column) -> Column:
    """True for public literal IPv4 addresses (mapped ones included) and for names; IPv6 literals must be global.

    Names are not resolved here: ``resolves_public`` in ``providers`` does that where fetching is allowed.
    """
    v4 = F.regexp_replace(host, "^(?:0*:)*:?ffff:(?=[0-9.]+$)", "")
    number = ipv4_number(v4)
    inside = F.lit(False)
    for first, bits in BLOCKS:
        low = int(ipaddress.ip_address(first))
        inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
    six = host.contains(":") & ~v4.rlike(IPV4)
    six_public = host.rlike("^[23][0-9a-f]{3}:") & ~host.rlike("^2001:(?:0?db8|0{0,3}[0-9a-f]?):")
    odd = host.rlike("^(?:0x[0-9a-f]*|[0-9]+)(?:\\.(?:0x[0-9a-f]*|[0-9]+))*\\.?$") & ~v4.rlike(IPV4)  # numbers in other forms are not trusted
    name = ~host.rlike("(?:^|\\.)localhost\\.?$") & (host != "")
    return F.when(v4.rlike(IPV4), ~inside).when(six, six_public).when(odd, F.lit(False)).otherwise(name)


def is_public_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("^https?://") & public_literal(host_of(url)), F.lit(False))
