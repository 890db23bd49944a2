"""URL algebra as column expressions; only IPv6 literals need an Arrow UDF."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# scheme, authority, path, query, fragment
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"

# IPv4 blocks that are not public, as (first address, prefix length).
SPECIAL_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
]
# IPv4 blocks that are not reachable worldwide; multicast and the 6to4 relays are.
NON_GLOBAL_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.8", 32), ("192.0.0.11", 32), ("192.0.0.12", 30),
    ("192.0.0.16", 28), ("192.0.0.32", 27), ("192.0.0.64", 26), ("192.0.0.128", 25), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]
MAX_URL_BYTES = 4096
IPV4 = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def clean(url: Column) -> Column:
    """Control characters and spaces at the front go, as do tabs and line ends anywhere."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(clean(url), PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def has_credentials(url: Column) -> Column:
    return authority(url).rlike(r"^[^@]*[^:@]+[^@]*@|^[^@]+@")


def host(url: Column) -> Column:
    """Lower-cased, without credentials, port and the brackets of an IPv6 address."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", "")
    return F.lower(F.regexp_replace(bare, r"^\[|\]$", ""))


def port(url: Column) -> Column:
    """The port as an int; null where none is given."""
    return F.nullif(F.regexp_extract(authority(url), r":([0-9]+)$", 1), F.lit("")).try_cast("int")


def effective_port(url: Column) -> Column:
    return F.coalesce(port(url), F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80))


def canonical_url(url: Column) -> Column:
    """Identity of a page: scheme and host in lower case, no default port, no fragment, a path of at
    least '/', query kept as it is. Null for credentials and for what is no URL."""
    name = host(url)
    name = F.when(F.contains(name, F.lit(":")), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
    default = ((scheme(url) == "http") & (port(url) == 80)) | ((scheme(url) == "https") & (port(url) == 443)) | (port(url) == 0)
    tail = F.when(port(url).isNull() | default, "").otherwise(F.concat(F.lit(":"), port(url).cast("string")))
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    query = F.when(part(url, 4) == "?", "").otherwise(part(url, 4))
    whole = F.concat(scheme(url), F.lit("://"), name, tail, path, query)
    return F.when((scheme(url) != "") & ~has_credentials(url) & sound_authority(url), whole)


def sound_authority(url: Column) -> Column:
    """Whether host and port can be read: both brackets or none, about an address and nothing else, and a port in range."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    brackets = ~bare.rlike(r"[\[\]]") | bare.rlike(r"^\[([0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(%[^\]]*)?|v[0-9A-Fa-f]+\.[^\]]+)\](:[^:\]]*)?$")
    given = F.regexp_extract(F.regexp_replace(bare, r"^\[[^\]]*\]", ""), "^[^:]*:(.*)$", 1)
    in_range = (given == "") | (given.rlike("^[0-9]+$") & (F.coalesce(given.try_cast("decimal(38,0)"), F.lit(99999)) <= 65535))
    return brackets & in_range


def ipv4_number(name: Column) -> Column:
    """The address of a dotted quad as a long; null for anything else."""
    octets = [F.regexp_extract(name, IPV4, k).try_cast("long") for k in range(1, 5)]
    whole = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(name.rlike(IPV4) & (F.greatest(*octets) <= 255), whole)


def ipv4_ranges(blocks: list[tuple[str, int]] = SPECIAL_IPV4) -> list[tuple[int, int]]:
    out = []
    for first, bits in blocks:
        low = int(ipaddress.ip_address(first))
        out.append((low, low + (1 << (32 - bits)) - 1))
    return out


def is_special_ipv4(name: Column, blocks: list[tuple[str, int]] = SPECIAL_IPV4) -> Column:
    def special(number: Column) -> Column:
        found = F.lit(False)
        for low, high in ipv4_ranges(blocks):
            found = found | number.between(low, high)
        return found

    return F.coalesce(F.exists(F.array(ipv4_number(name)), special), F.lit(False))  # the number is made once


@F.pandas_udf(T.BooleanType())
def is_public_ipv6(name: pd.Series) -> pd.Series:
    """Whether a name is an IPv6 address of 2000::/3 outside the special blocks; null if it is none."""

    def one(x):
        try:
            address = ipaddress.IPv6Address(x)
        except (ValueError, TypeError):
            return None
        return address in ipaddress.IPv6Network("2000::/3") and address.is_global

    return name.map(one)


@F.pandas_udf(T.BooleanType())
def is_global_ipv6(name: pd.Series) -> pd.Series:
    """Whether a name is an IPv6 address that is reachable worldwide; null if it is none."""

    def one(x):
        try:
            return ipaddress.IPv6Address(x).is_global
        except (ValueError, TypeError):
            return None

    return name.map(one)


def public_address(name: Column) -> Column:
    """Whether an address is one that the network policy lets through; null for a name."""
    return F.when(ipv4_number(name).isNotNull(), ~is_special_ipv4(name)).otherwise(is_public_ipv6(name))


def safety_reason(url: Column) -> Column:
    """Why a URL must not be fetched, the first reason of this order; null if none shows without DNS. Literal addresses
    must be reachable worldwide; the stricter rule of the network policy is `public_address`."""
    name = F.regexp_replace(host(url), r"\.+$", "")
    return (
        F.when(~scheme(url).isin("http", "https"), "scheme")
        .when(name == "", "no_host")
        .when(has_credentials(url), "credentials")
        .when((name == "localhost") | F.endswith(name, F.lit(".localhost")), "localhost")
        .when(is_special_ipv4(name, NON_GLOBAL_IPV4) | ~F.coalesce(is_global_ipv6(name), F.lit(True)), "non_public_address")
    )


def port_allowed(url: Column) -> Column:
    """Standard web ports only."""
    return effective_port(url) == F.when(scheme(url) == "https", 443).otherwise(80)


def wire_allowed(url: Column) -> Column:
    """At most MAX_URL_BYTES bytes, no line ends or tabs, http(s), no credentials."""
    return (F.octet_length(url) <= MAX_URL_BYTES) & ~url.rlike(r"[\r\n\t]") & scheme(url).isin("http", "https") & ~has_credentials(url)


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & effective_port(a).eqNullSafe(effective_port(b))


def title_from_url(url: Column) -> Column:
    """The last step of the path, else the host, else the URL."""
    last = F.regexp_extract(F.regexp_replace(part(url, 3), "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(host(url), F.lit("")), url)


def web_links(links: Column, cap: int = 500) -> Column:
    """The http(s) ones, each once in order, at most `cap`."""
    return F.slice(F.array_distinct(F.filter(links, lambda x: x.rlike("^https?://"))), 1, cap)


def merged_links(internal: Column, external: Column, cap: int = 500) -> Column:
    return F.slice(F.array_distinct(F.concat(internal, external)), 1, cap)


def frame_names(frames: Column, pattern: str, cap: int = 3) -> Column:
    """Frame URLs that match, without query and fragment, each once in order."""
    hits = F.filter(frames, lambda x: x.rlike(pattern))
    return F.slice(F.array_distinct(F.transform(hits, lambda x: F.regexp_replace(x, r"[?#].*$", ""))), 1, cap)
