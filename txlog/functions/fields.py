"""Fields, headers, numbers and URLs in payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(p: Column, n: int) -> Column:
    """The n-th white-space field from 0; empty beyond the end."""
    return F.coalesce(F.get(F.split(F.regexp_replace(p, r"^\s+", ""), r"\s+"), F.lit(n)), F.lit(""))


def header_value(p: Column) -> Column:
    """What follows the first colon, without leading blanks."""
    return F.regexp_replace(p, r"^[^:]*:\s*", "")


def header_field(p: Column, n: int) -> Column:
    return field(header_value(p), n)


def header_name(p: Column) -> Column:
    """Upper-case name before the first colon, without blanks around it; null without a colon."""
    return F.when(F.instr(p, ":") > 0, F.upper(F.regexp_replace(F.substring_index(p, ":", 1), r"^\s+|\s+$", "")))


def has_header(p: Column, name: str) -> Column:
    """Whether the payload carries the header, in any case."""
    return F.coalesce(header_name(p) == name.upper(), F.lit(False))


def quote_binary(raw: Column) -> Column:
    """Bytes as text; quoted and escaped (unpadded octal) if any of them cannot be printed."""
    s = F.decode(raw, "ISO-8859-1")
    plain = {'"': r"\"", "\\": r"\\", "\n": r"\n", "\r": r"\r", "\t": r"\t"}

    def escaped(c: Column) -> Column:
        out = F.when(c.rlike(r"^[ -~]$"), c).otherwise(F.concat(F.lit("\\"), F.conv(F.hex(F.encode(c, "ISO-8859-1")), 16, 8)))
        for char, text in plain.items():
            out = F.when(c == char, F.lit(text)).otherwise(out)
        return out

    quoted = F.concat(F.lit('"'), F.concat_ws("", F.transform(F.split(s, ""), escaped)), F.lit('"'))
    return F.when(s.rlike(r"[^ -~]"), quoted).otherwise(s)


def split_epoch(p: Column) -> tuple[Column, Column]:
    """``secs.usecs`` as two integers: the digits after the point are read as they stand."""
    part = lambda n: F.regexp_extract(p, r"^(\d+)(?:\.(\d+))?", n).try_cast("long")
    return part(1), F.coalesce(part(2), F.lit(0).cast("long"))


def microseconds(p: Column) -> Column:
    """Seconds as text (a numeric prefix counts, else 0) in whole microseconds, cut off."""
    number = F.regexp_extract(p, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.coalesce(number, F.lit(0.0)) * 1e6


def basic_auth_user(header: Column) -> Column:
    """User name of basic authorization, else ``-``; it ends at a colon or a NUL.  Bytes that are not UTF-8
    become U+FFFD; what is not base64 gives ``-``."""
    decoded = F.make_valid_utf8(F.try_to_binary(field(header, 1), F.lit("base64")).cast("string"))
    basic = F.lower(field(header, 0)).startswith("basic")
    return F.coalesce(F.when(basic, F.substring_index(F.substring_index(decoded, "\0", 1), ":", 1)), F.lit("-"))


def url_path(u: Column) -> Column:
    return F.substring_index(u, "?", 1)


def url_query(u: Column) -> Column:
    at = F.instr(u, "?")
    return F.when(at > 0, F.substring(u, at + 1, F.length(u))).otherwise(F.lit(""))
