"""Address tests and web address repair, all with built-in functions."""

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 ranges that count as private, link-local or loopback.
IPV4_NON_PUBLIC = (
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "239.0.0.0/8",
)

# First 16-bit groups of IPv6 addresses that count as private or link-local
# (fc00::/7, fe80::/10, fec0:: to feff::).
IPV6_NON_PUBLIC = ((0xFC00, 0xFDFF), (0xFE80, 0xFEBF), (0xFEC0, 0xFEFF))

# Accepted web addresses (groups: scheme and host, host, port and path) and the
# port assumed when an instance sends no address.
URL_PATTERN = (
    r"(?i)^(https?://"
    r"((?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
    r"localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}))"
    r"((?::\d+)?"
    r"(?:/?|[/?]\S+))$"
)
DEFAULT_WEB_PORT = 1624

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as one number, null for any other text."""

    def combine(octets: Column) -> Column:
        return sum(
            F.get(octets, F.lit(i)).try_cast("bigint") * F.lit(256 ** (3 - i)).cast("bigint")
            for i in range(4)
        )

    return F.when(ip.rlike(rf"\A{_IPV4}\z"), _bind(F.split(ip, r"\."), combine))


def _ipv6_hex(ip: Column) -> Column:
    """Lower-case text of an address with colons, an IPv4 tail written as two hex groups."""

    def spell(tail: Column) -> Column:
        as_groups = F.format_string("%x:%x", F.floor(tail / 65536), F.pmod(tail, F.lit(65536)))
        head = F.regexp_replace(F.lower(ip), rf"{_IPV4}\z", "")
        return F.when(tail.isNull(), F.lower(ip)).otherwise(F.concat(head, as_groups))

    return F.when(
        ip.contains(":"), _bind(ipv4_number(F.regexp_extract(ip, rf":({_IPV4})\z", 1)), spell)
    )


def _is_ipv6(hex_text: Column) -> Column:
    groups = F.size(F.filter(F.split(hex_text, ":"), lambda g: g != ""))
    whole = hex_text.rlike(rf"\A{_GROUPS}\z") & (groups == 8)
    shortened = hex_text.rlike(rf"\A(?:{_GROUPS})?::(?:{_GROUPS})?\z") & (groups <= 7)
    return whole | shortened


def ip_version(ip: Column) -> Column:
    """4, 6, or null when the text is not an address."""
    v6 = _bind(_ipv6_hex(ip), lambda text: F.when(_is_ipv6(text), F.lit(6)))
    return F.when(ipv4_number(ip).isNotNull(), F.lit(4)).otherwise(v6)


def _cidr_bounds(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    low = 0
    for octet in base.split("."):
        low = low * 256 + int(octet)
    return low, low + 2 ** (32 - int(bits)) - 1


def _any_between(number: Column, ranges: Iterable[tuple[int, int]]) -> Column:
    return reduce(or_, (number.between(low, high) for low, high in ranges))


def is_non_public(ip: Column) -> Column:
    """True for private, link-local and loopback addresses, null when not an address."""

    def v6(text: Column) -> Column:
        first = F.conv(F.regexp_extract(text, r"\A([0-9a-f]+)", 1), 16, 10).try_cast("bigint")
        reserved = F.coalesce(_any_between(first, IPV6_NON_PUBLIC), F.lit(False))
        return F.when(_is_ipv6(text), text.rlike(r"\A[0:]*:0{0,3}1\z") | reserved)

    def v4(number: Column) -> Column:
        inside = _any_between(number, map(_cidr_bounds, IPV4_NON_PUBLIC))
        return F.when(number.isNotNull(), inside).otherwise(_bind(_ipv6_hex(ip), v6))

    return _bind(ipv4_number(ip), v4)


def url_parts(url: Column) -> Column:
    """Struct ``(origin, host, rest)`` of an accepted web address, null for any other text."""
    return F.when(
        url.rlike(URL_PATTERN),
        F.struct(
            F.regexp_extract(url, URL_PATTERN, 1).alias("origin"),
            F.regexp_extract(url, URL_PATTERN, 2).alias("host"),
            F.regexp_extract(url, URL_PATTERN, 3).alias("rest"),
        ),
    )


def normalize_webfront(url: Column, ip: Column) -> Column:
    """Public web address of an instance.

    No address gives the sender with the default port, a malformed one gives null, and a
    non-public host is replaced by the sender while port and path stay.
    """
    host = F.regexp_extract(url, URL_PATTERN, 2)
    rest = F.regexp_extract(url, URL_PATTERN, 3)
    return (
        F.when(url.isNull(), F.concat(F.lit("http://"), ip, F.lit(f":{DEFAULT_WEB_PORT}")))
        .when(~url.rlike(URL_PATTERN), F.lit(None).cast("string"))
        .when(F.coalesce(is_non_public(host), F.lit(False)), F.concat(F.lit("http://"), ip, rest))
        .otherwise(url)
    )
