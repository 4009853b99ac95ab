"""strftime of the C locale as Spark columns; the format is read once, on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Specifiers that are one date_format pattern.
PATTERNS = {
    "a": "EEE", "A": "EEEE", "b": "MMM", "h": "MMM", "B": "MMMM", "d": "dd", "D": "MM/dd/yy", "x": "MM/dd/yy",
    "F": "yyyy-MM-dd", "H": "HH", "I": "hh", "m": "MM", "M": "mm", "p": "a", "r": "hh:mm:ss a", "R": "HH:mm",
    "S": "ss", "T": "HH:mm:ss", "X": "HH:mm:ss", "y": "yy", "Y": "yyyy", "z": "xx", "Z": "z",
}


def _digits(c: Column, n: int, fill: str = "0") -> Column:
    return F.lpad(c.cast("string"), n, fill)


def _iso_day(t: Column) -> Column:
    return F.weekday(t) + 1


def _iso_year(t: Column) -> Column:
    return F.year(F.date_add(t.cast("date"), 4 - _iso_day(t)))


def _week(t: Column, first: Column) -> Column:
    return _digits(F.floor((F.dayofyear(t) - 1 + 7 - first) / 7), 2)


#: Specifiers that need calendar functions.
COMPUTED: dict[str, Callable[[Column], Column]] = {
    "c": lambda t: F.concat(F.date_format(t, "EEE MMM "), _digits(F.dayofmonth(t), 2, " "), F.date_format(t, " HH:mm:ss yyyy")),
    "C": lambda t: _digits(F.floor(F.year(t) / 100), 2),
    "e": lambda t: _digits(F.dayofmonth(t), 2, " "),
    "G": lambda t: _iso_year(t).cast("string"),
    "g": lambda t: _digits(_iso_year(t) % 100, 2),
    "j": lambda t: _digits(F.dayofyear(t), 3),
    "s": lambda t: F.unix_timestamp(t).cast("string"),
    "u": lambda t: _iso_day(t).cast("string"),
    "U": lambda t: _week(t, _iso_day(t) % 7),
    "V": lambda t: _digits(F.weekofyear(t), 2),
    "w": lambda t: (_iso_day(t) % 7).cast("string"),
    "W": lambda t: _week(t, F.weekday(t)),
}
TEXT = {"n": "\n", "t": "\t", "%": "%"}


def strftime(t: Column, usec: Column, fmt: str) -> Column:
    """``t`` (timestamp) in the session's time zone; ``%i`` is ``usec`` in 6 digits."""
    parts: list[Column] = []
    text, i = "", 0
    while i < len(fmt):
        c = fmt[i]
        i += 1
        if c != "%" or i == len(fmt):
            text += c
            continue
        spec = fmt[i]
        i += 1
        if spec in "EO" and i < len(fmt):
            spec = fmt[i]
            i += 1
        if spec in TEXT:
            text += TEXT[spec]
            continue
        if spec == "i":
            part = _digits(usec, 6)
        elif spec in PATTERNS:
            part = F.date_format(t, PATTERNS[spec])
        elif spec in COMPUTED:
            part = COMPUTED[spec](t)
        else:
            text += f"%{spec}"
            continue
        parts += [F.lit(text), part] if text else [part]
        text = ""
    if text or not parts:
        parts.append(F.lit(text))
    return F.concat(*parts)
