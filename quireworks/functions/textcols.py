"""Column expressions over text: Unicode trim, portable patterns, escaping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it; U+FEFF is not in it. As a pattern, and as the characters themselves.
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

WHITE_CHARS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def java(pattern: str) -> str:
    r"""A pattern of the RE2 family for Java's engine: `.` stops at \n only, `\s` leaves out U+000B."""
    if "(?P<" in pattern or "(?U)" in pattern:
        raise ValueError(f"named groups and (?U) are not portable: {pattern}")
    out, in_class = [], False
    for part in re.findall(r"\\.|\[|\]|[^\\\[\]]+", pattern, re.S):
        if part == "[":
            in_class = True
        elif part == "]":
            in_class = False
        out.append((r"\t\n\f\r " if in_class else r"[\t\n\f\r ]") if part == r"\s" else part)
    return "(?d)" + "".join(out)


def n_groups(pattern: str) -> int:
    return re.compile(pattern).groups


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(java(pattern))


def capture(c: Column, pattern: str) -> Column:
    """Group 1 if the pattern has groups, else the whole match, trimmed; null where it doesn't match or is empty."""
    return F.nullif(trim(F.regexp_extract(c, java(pattern), 1 if n_groups(pattern) else 0)), F.lit(""))


def capture_two(c: Column, pattern: str) -> tuple[Column, Column]:
    """Both groups of a pattern of exactly two, null unless both are there; a pattern with another number of groups never matches."""
    if n_groups(pattern) != 2:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    a, b = (F.nullif(trim(F.regexp_extract(c, java(pattern), k)), F.lit("")) for k in (1, 2))
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def strip_prefix(c: Column, prefixes: tuple[str, ...]) -> Column:
    """What follows the first prefix in list order, trimmed; null without any."""
    return F.coalesce(*[F.when(c.startswith(p), trim(F.substring(c, len(p) + 1, 1 << 30))) for p in prefixes], F.lit(None).cast("string"))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def safe_name(c: Column) -> Column:
    """A file name: nine reserved characters become _, then white space, then dots and spaces at the ends go."""
    return F.regexp_replace(trim(F.translate(c, '<>:"/\\|?*', "_" * 9)), "^[. ]+|[. ]+$", "")


def union_distinct(a: Column, b: Column) -> Column:
    """a as it is, then the trimmed values of b that are neither blank nor there already."""
    new = F.filter(F.array_distinct(F.filter(F.transform(b, trim), lambda x: x != "")), lambda x: ~F.exists(a, lambda y: trim(y) == x))
    return F.concat(a, new)
