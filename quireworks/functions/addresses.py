"""IP addresses as column expressions: any spelling to 32 hex digits, blocks as sets of hex prefixes, and back to the usual spelling.

An IPv4 address is the 32 digits of its IPv4-mapped IPv6 address, so both families go through the same expressions. Each step of the
reading is a transform over an array, which binds a value once for the step after it; one address is an array of one.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireworks.functions import textcols as T

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED = f"{_OCTET}(?:\\.{_OCTET}){{3}}"
IPV4 = f"^{_DOTTED}$"
_GROUPS = "^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"
#: The digits that all IPv4 addresses start with here.
MAPPED = "0" * 20 + "ffff"


def _eight(dotted: Column) -> Column:
    """A dotted IPv4 address as eight hex digits."""
    return F.array_join(F.transform(F.split(dotted, "\\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("long"))), 2, "0")), "")


def _split_zone(x: Column) -> Column:
    """The address in lower case, and what follows its first percent sign."""
    zoned = F.contains(x, F.lit("%"))
    return F.struct(F.lower(F.substring_index(x, "%", 1)).alias("t"), F.when(zoned, F.substring(x, F.instr(x, "%") + 1, F.lit(1 << 20))).alias("zone"))


def _split_tail(x: Column) -> Column:
    """A dotted IPv4 at the end as eight hex digits, with what is before it."""
    dotted = x["t"].rlike(f"(?:^|:){_DOTTED}$")
    tail = F.substring_index(x["t"], ":", -1)
    return F.struct(
        x["t"].alias("t"), x["zone"].alias("zone"), F.when(dotted, _eight(tail)).alias("v4"), F.when(dotted, tail).alias("tail"),
        F.when(dotted, F.left(x["t"], F.length(x["t"]) - F.length(tail))).alias("head"),
    )


def _split_gap(x: Column) -> Column:
    """What lies on both sides of `::`, if that is there; whether the whole is a plain IPv4."""
    whole = F.coalesce(x["head"] == "", F.lit(False))
    t = F.when(x["head"].isNull(), x["t"]).otherwise(F.concat(x["head"], F.left(x["v4"], F.lit(4)), F.lit(":"), F.right(x["v4"], F.lit(4))))
    gap = F.instr(t, "::")
    return F.struct(
        x["zone"].alias("zone"), F.when(whole, x["v4"]).alias("v4"), x["tail"].alias("tail"), (gap > 0).alias("gap"),
        F.when(gap > 0, F.left(t, gap - 1)).otherwise(t).alias("a"), F.when(gap > 0, F.substring(t, gap + 2, F.lit(1 << 20))).otherwise("").alias("b"),
    )


def _digits(x: Column) -> Column:
    """The 32 digits, null where this is no address."""
    wide = lambda c: F.array_join(F.transform(F.filter(F.split(c, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")), "")
    sound = x["a"].rlike(_GROUPS) & x["b"].rlike(_GROUPS)
    a, b = wide(x["a"]), wide(x["b"])
    n = F.length(a) + F.length(b)
    six = F.when(sound & F.when(x["gap"], n <= 28).otherwise(n == 32), F.concat(a, F.repeat(F.lit("0"), F.lit(32) - n), b))
    digits = F.when(x["v4"].isNotNull(), F.when(x["zone"].isNull(), F.concat(F.lit(MAPPED), x["v4"]))).when(F.coalesce(x["zone"] != "", F.lit(True)), six)
    mapped = digits.startswith(MAPPED)
    return F.when(digits.isNotNull(), F.struct(digits.alias("digits"), F.when(~mapped, x["zone"]).alias("zone"), F.when(mapped, x["tail"]).alias("dotted")))


def addresses(texts: Column) -> Column:
    """An array of (digits, zone, dotted: an IPv4 address as it was written, if it was) of an array of texts; null for a text that is no address. Dotted octets have no leading zeros, `::` stands for one
    group at least, a zone is not empty and no IPv4 address has one (of a mapped one it is dropped)."""

    def read(t: Column) -> Column:
        plain = F.struct(F.concat(F.lit(MAPPED), _eight(t)).alias("digits"), F.lit(None).cast("string").alias("zone"), t.alias("dotted"))
        other = F.array(t)
        for step in (_split_zone, _split_tail, _split_gap, _digits):
            other = F.transform(other, step)
        return F.when(t.rlike(IPV4), plain).otherwise(other[0])  # most addresses take the short way

    return F.transform(texts, read)


def address(text: Column) -> Column:
    return addresses(F.array(text))[0]


def spelled(x: Column) -> Column:
    """The usual spelling of (digits, zone): dotted for IPv4; else lower case, no leading zeros, the first longest run of two or more zero groups
    as `::`; null for null."""
    octets = F.array_join(F.transform(F.sequence(F.lit(25), F.lit(31), F.lit(2)), lambda i: F.conv(F.substring(x["digits"], i, F.lit(2)), 16, 10)), ".")
    groups = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.coalesce(F.nullif(F.ltrim(F.substring(x["digits"], i, F.lit(4)), F.lit("0")), F.lit("")), F.lit("0"))), ":")

    def short(s: Column) -> Column:
        out = F
        for n in range(8, 1, -1):
            run = ":0" * n + ":"
            at = F.instr(s, run)
            out = out.when(at > 0, F.concat(F.substring(s, F.lit(2), at - 2), F.lit("::"), F.rtrim(F.substring(s, at + len(run), F.lit(99)), F.lit(":"))))
        return out.otherwise(F.btrim(s, F.lit(":")))

    six = F.transform(F.array(F.concat(F.lit(":"), groups, F.lit(":"))), short)[0]
    return F.when(x["dotted"].isNotNull(), x["dotted"]).when(x["digits"].startswith(MAPPED), octets).when(x["digits"].isNotNull(), F.concat(six, F.coalesce(F.concat(F.lit("%"), x["zone"]), F.lit(""))))


def prefixes(block: str) -> list[str]:
    """The hex prefixes, sixteen to the digit, that make up a block."""
    net = ipaddress.ip_network(block, strict=False)
    bits = net.prefixlen + (96 if net.version == 4 else 0)
    digits = MAPPED + f"{int(net.network_address):08x}" if net.version == 4 else f"{int(net.network_address):032x}"
    n, loose = -(-bits // 4), -bits % 4
    if not n:
        return [""]
    return [digits[: n - 1] + f"{int(digits[n - 1], 16) + k:x}" for k in range(1 << loose)]


def is_within(x: Column, blocks: tuple[str, ...]) -> Column:
    """Whether (digits, zone) lies in one of the blocks: a look-up in a set for each length of prefix, however many blocks there are. An IPv4 address is
    in IPv4 blocks only, one with a zone in none."""
    sets: dict[tuple[bool, int], set[str]] = {}
    for block in blocks:
        for p in prefixes(block):
            sets.setdefault((":" not in block, len(p)), set()).add(p)
    found = F.lit(False)
    for (four, n), some in sorted(sets.items()):
        family = x["digits"].startswith(MAPPED)
        found = found | ((family if four else ~family) & (F.left(x["digits"], F.lit(n)).isin(*sorted(some)) if n else F.lit(True)))
    return F.coalesce(found & x["zone"].isNull(), F.lit(False))


def peer_host(remote: Column) -> Column:
    """The host of host:port or [host]:port, trimmed; anything else is a host as it stands."""
    inside, plain = F.regexp_extract(remote, r"^\[([^\[\]]*)\]:[^:\[\]]*$", 1), F.regexp_extract(remote, r"^([^:\[\]]*):[^:\[\]]*$", 1)
    return T.trim(F.when(inside != "", inside).when(plain != "", plain).otherwise(remote))
