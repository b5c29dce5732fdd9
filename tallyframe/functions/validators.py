"""Structural validators as columns (true where the value is well formed)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def luhn(c: Column) -> Column:
    """13 to 19 digits, blanks and dashes ignored, with a valid check digit."""
    d = F.translate(c, " -", "")
    return d.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", F.when(d.rlike("^[0-9]{13,19}$"), d).otherwise(F.lit("0")))


def iban(c: Column) -> Column:
    """Country, check digits and account, 15 to 34 long without blanks, remainder 1 modulo 97."""
    s = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    ok = s.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$")
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    # A letter stands for two digits (A = 10 ... Z = 35): shift the remainder by 100 instead of 10.
    def step(rem: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (rem * 100 + code - 55) % 97).otherwise((rem * 10 + code - 48) % 97)

    return ok & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def ipv4(c: Column) -> Column:
    """Four octets 0 to 255 without leading zeros."""
    return F.trim(c).rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")


def ipv4_number(c: Column) -> Column:
    p = F.split(F.trim(c), r"\.")
    n = F.lit(0).cast("long")
    for i in range(4):
        n = n * 256 + F.get(p, F.lit(i)).try_cast("long")
    return F.when(ipv4(c), n)


def ipv4_in_cidr(c: Column, cidr: str) -> Column:
    net = ipaddress.IPv4Network(cidr, strict=False)
    shift = 32 - net.prefixlen
    return F.shiftright(ipv4_number(c), shift) == F.lit(int(net.network_address) >> shift).cast("long")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_groups(c: Column) -> Column:
    """The eight 16-bit numbers of an address, NULL when the text is none."""
    def hex_tail(tail: Column) -> Column:
        n = ipv4_number(tail)
        low = n.bitwiseAND(F.lit(65535).cast("long"))
        return F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(low)))

    def dotted(s: Column) -> Column:
        """A dotted tail is written as two groups."""
        tail = F.regexp_extract(s, rf"({_OCTET}(\.{_OCTET}){{3}})$", 1)
        return F.when(s.contains("."), F.concat(F.left(s, F.length(s) - F.length(tail)), hex_tail(tail))).otherwise(s)

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def expand(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        have = F.size(left) + F.size(right)
        return F.when((F.size(halves) == 1) & (have == 8), left).when(
            (F.size(halves) == 2) & (have <= 7), F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - have), right))

    def numbers(full: Column) -> Column:
        return F.when(F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
                      F.transform(full, lambda g: F.conv(g, 16, 10).try_cast("int")))

    return _let(F.lower(F.trim(c)), lambda s: _let(F.split(dotted(s), "::"), lambda h: _let(expand(h), numbers)))


def ipv6(c: Column) -> Column:
    return ipv6_groups(c).isNotNull()


def ipv6_in_cidr(c: Column, cidr: str) -> Column:
    """The first prefix-length bits must be those of the network, compared group by group."""
    net = ipaddress.IPv6Network(cidr, strict=False)

    def inside(g: Column) -> Column:
        ok = g.isNotNull()
        for i in range(8):
            bits = min(16, max(0, net.prefixlen - 16 * i))
            if bits:
                want = (int(net.network_address) >> (16 * (7 - i))) & 0xFFFF
                ok = ok & (F.shiftright(F.get(g, F.lit(i)), 16 - bits) == F.lit(want >> (16 - bits)))
        return ok

    return _let(ipv6_groups(c), inside)


def npi(c: Column) -> Column:
    """Ten-digit provider number."""
    return c.rlike("^[0-9]{10}$")


def swift(c: Column) -> Column:
    """Bank identifier of 8 or 11 characters."""
    return c.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$")
