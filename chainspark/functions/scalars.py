"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address ranges that count as not external, as (first, last) of 32-bit addresses.
PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def _number(address: str) -> int:
    out = 0
    for part in address.split("."):
        out = out * 256 + int(part)
    return out


def text(c: Column) -> Column:
    """Lower-cased, null as empty."""
    return F.lower(F.coalesce(c, F.lit("")))


def filled(c: Column) -> Column:
    """Null where empty."""
    return F.when(c != "", c)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def process_value(host: Column, name: Column) -> Column:
    """A process named with its host, so that equal binaries of two hosts stay apart."""
    bare = filled(F.lower(F.trim(name)))
    return F.when(filled(host).isNotNull(), F.concat(host, F.lit(":"), bare)).otherwise(bare)


def is_private_ip(ip: Column) -> Column:
    """Private, loopback, link-local, reserved or multicast; what does not parse is private."""
    sound = ip.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$")
    # Bound once in a one-element array, so that the ranges below test one number.
    number = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + F.coalesce(o.try_cast("bigint"), F.lit(0)))

    def inside(v: Column) -> Column:
        out = F.lit(False)
        for base, bits in PRIVATE:
            out = out | v.between(_number(base), _number(base) + (1 << (32 - bits)) - 1)
        return out

    return F.when(sound, F.exists(F.array(number), inside)).when(ip.contains(":"), _private_v6(ip)).otherwise(True)


def _private_v6(ip: Column) -> Column:
    """IPv6 by leading bits: unspecified, loopback, unique local, link local, multicast, documentation."""
    low = F.lower(ip)
    sound = low.rlike(r"^[0-9a-f:.]+$") & (low.contains("::") | low.rlike(r"^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"))
    return ~sound | low.rlike(r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|2001:db8:|64:ff9b:1:|100::)")
