"""ISO-8601 text as instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """``text`` as a timestamp; without an offset it is UTC, whatever the session's zone.

    Blank, null and unreadable texts give null.
    """
    t = F.trim(text)
    has_zone = t.rlike(r"(?i)(z|utc|gmt|[+-]\d{2}(:?\d{2})?)\s*$") & t.rlike(r"\d{2}:\d{2}")
    bare_date = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = (
        F.when(bare_date, F.concat(t, F.lit("T00:00:00Z")))
        .when(has_zone, t)
        .otherwise(F.concat(t, F.lit("Z")))
    )
    return zoned.try_cast("timestamp")


def key_text(value: Column) -> Column:
    """A key compared without regard to case and outer white space; blank gives null."""
    k = F.lower(F.regexp_replace(value.cast("string"), r"(?U)^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    return F.when(k != "", k)


# The names of the months in Indonesian.
MONTHS_ID = "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split()


def long_date(at: Column, months: list[str] = MONTHS_ID) -> Column:
    """A day as in ``3 Maret 2024``; null stays null."""
    return F.concat(F.day(at).cast("string"), F.lit(" "), F.array(*[F.lit(m) for m in months])[F.month(at) - 1], F.lit(" "), F.year(at).cast("string"))
