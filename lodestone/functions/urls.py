"""URL expressions; all of them stay in generated code."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import BLOCKED_NETWORKS, BLOCKED_NETWORKS_6, SKIP_DOMAINS, TRACKING_PARAMS
from .text import let

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 network location, 3 path, 4 query."""
    return F.regexp_extract(url, PARTS, n)


def _plain(x: Column) -> Column:
    """Decode and encode again, in the way of a form."""
    again = F.url_encode(F.coalesce(F.try_url_decode(x), x))
    return F.replace(F.replace(again, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, no trailing dots or slashes, no tracking, empty or scattered parameters, no fragment."""
    pairs = F.transform(F.filter(F.split(part(url, 4), "&"), lambda p: F.instr(p, "=") > 1), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))
    pairs = F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(TRACKING_PARAMS))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)))
    query = F.array_join(F.transform(grouped, lambda p: F.concat(_plain(p["k"]), F.lit("="), _plain(p["v"]))), "&")
    path = F.regexp_replace(part(url, 3), "/+$", "")
    scheme, host = F.lower(part(url, 1)), F.regexp_replace(F.lower(part(url, 2)), r"\.+$", "")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        F.when(path == "", F.lit("/")).otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def domain(url: Column) -> Column:
    """Host and port in lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[^:]+://([^/?#]*)", 1)), r"^www\.", "")


def site(url: Column) -> Column:
    return F.regexp_extract(url, "^([^:]+://[^/?#]*)", 1)


def absolute(href: Column, base: Column) -> Column:
    """Join a link to a page: absolute, from the root, of the same scheme, or beside the page."""
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site(base), href)).otherwise(F.concat(site(base), F.regexp_replace(F.when(part(base, 3) == "", F.lit("/")).otherwise(part(base, 3)), "[^/]*$", ""), href))
    )


def ipv4(host: Column) -> Column:
    """A literal address as a number; null for other hosts."""
    octets = F.split(host, r"\.")
    value = sum((F.try_element_at(octets, F.lit(k + 1)).cast("long") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0))
    return F.when(host.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"), value)


def blocked(address: Column) -> Column:
    out = F.lit(False)
    for text in BLOCKED_NETWORKS:
        net = ipaddress.ip_network(text)
        out = out | address.between(int(net[0]), int(net[-1]))
    return out


def host(url: Column) -> Column:
    """Lower-case host without user, port and the brackets of an IPv6 address."""
    place = F.lower(F.regexp_replace(part(url, 2), "^.*@", ""))
    return F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(place, r":\d*$", ""))


def ipv6(name: Column) -> Column:
    """The eight groups of a literal address, as 32 hex digits; null for other hosts. A dotted end counts as two groups."""
    dotted = r"(?:\d{1,3}\.){3}\d{1,3}$"
    pair = lambda o, a, b: F.lower(F.hex(F.try_element_at(o, F.lit(a)).cast("long") * 256 + F.try_element_at(o, F.lit(b)).cast("long")))
    plain = lambda n: let(F.split(F.regexp_extract(n, f"({dotted})", 1), r"\."), lambda o: F.concat(F.regexp_replace(n, dotted, ""), pair(o, 1, 2), F.lit(":"), pair(o, 3, 4)))
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    short = lambda n: let(F.struct(groups(F.substring_index(n, "::", 1)).alias("l"), groups(F.substring_index(n, "::", -1)).alias("r")), lambda p: F.concat(p["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(p["l"]) - F.size(p["r"]))), p["r"]))
    filled = lambda n: F.when(F.contains(n, F.lit("::")), short(n)).otherwise(groups(n))
    digits = lambda n: F.array_join(F.transform(filled(n), lambda g: F.lpad(F.lower(g), 4, "0")), "")
    good = lambda n: n.rlike("^[0-9a-fA-F:]*:[0-9a-fA-F:]*$") & ~n.rlike("::.*::|[0-9a-fA-F]{5}|:::")
    whole = lambda n: F.when(good(n), let(digits(n), lambda d: F.when(F.length(d) == 32, d)))
    return F.when(F.contains(name, F.lit(":")), let(F.when(name.rlike(f":{dotted}"), plain(name)).otherwise(name), whole))


def blocked6(digits: Column) -> Column:
    """Of 32 hex digits; an IPv4 address inside is judged as one."""
    out = F.lit(False)
    for text in BLOCKED_NETWORKS_6:
        net = ipaddress.ip_network(text)
        low, high = f"{int(net[0]):032x}", f"{int(net[-1]):032x}"
        out = out | digits.between(low, high)
    return out


def blocked_address(address: Column) -> Column:
    """Whether a literal address lies in a blocked network; null for what is no address."""
    return F.coalesce(let(ipv4(address), lambda a: F.when(a.isNotNull(), blocked(a))), let(ipv6(F.lower(address)), lambda a: F.when(a.isNotNull(), blocked6(a))))


def safe_literal(url: Column) -> Column:
    """http or https, a host that is not local, and a literal address outside the blocked networks; null for names, for which the dns table is asked."""
    good = F.lower(part(url, 1)).isin("http", "https")
    judged = lambda name: F.when((name == "") | name.isin("localhost", "0.0.0.0", "::", "::1"), F.lit(False)).otherwise(~blocked_address(name))
    return F.when(~good, F.lit(False)).otherwise(let(host(url), judged))


def skipped(url: Column) -> Column:
    """Whether the host is one that is never crawled."""
    return F.lower(part(url, 2)).isin(*SKIP_DOMAINS)


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole string."""
    import fnmatch

    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + "$"
