"""Parsing of loosely typed text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_epoch(c: Column) -> Column:
    """Epoch seconds from text: a number as it is, else an ISO-8601 time in the session's zone; null where neither fits."""
    text = blank_to_null(c.cast("string"))
    iso = F.unix_micros(text.try_cast("timestamp")) / 1e6
    return F.coalesce(text.try_cast("double"), iso)


def parse_end(c: Column, now: Column) -> Column:
    """The end of a history request as a timestamp: blank or null is now, then epoch seconds, ISO-8601, and yyyyMMdd HH:mm:ss; null where none fits."""
    text = blank_to_null(c)
    seconds = parse_epoch(text)
    inside = F.when(F.abs(seconds) < 1e11, F.timestamp_micros((seconds * 1e6).cast("long")))
    vendor = F.try_to_timestamp(F.regexp_replace(text, r"^(\d{8})[- ](\d{2}:\d{2}:\d{2})( UTC)?$", "$1 $2"), F.lit("yyyyMMdd HH:mm:ss"))
    return F.when(text.isNull(), now.cast("timestamp")).otherwise(F.coalesce(inside, vendor))


#: Units of a vendor's durations, by their letters.
UNITS = {"S": "secs", "D": "days", "W": "weeks", "M": "months", "Y": "years"}


def parse_duration(c: Column) -> Column:
    """An interval from a vendor's duration such as `30 D` (S, D, W, M or Y; any case and blanks); null where it is none."""
    text = F.upper(F.trim(c))
    n, unit = F.regexp_extract(text, r"^(\d{1,9})\s*[SDWMY]$", 1).try_cast("int"), F.right(text, F.lit(1))
    part = lambda letter: F.when(unit == letter, n).otherwise(0)
    return F.when(n.isNotNull(), F.make_interval(**{name: part(letter) for letter, name in UNITS.items()}))


def clean_double(c: Column) -> Column:
    """A double from text or a number; null where it is missing, unparsable or not a number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def strip_fences(c: Column) -> Column:
    """The inside of a text that is one code fence of three lines or more; other texts are only trimmed."""
    text = F.trim(c)
    return F.trim(F.regexp_replace(text, r"(?s)^```[^\n]*\n(.*)\n\s*```\s*$", "$1"))


def audit_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its keys sorted and its nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def first_error(*rules: tuple[Column, Column | str]) -> Column:
    """The message of the first rule whose condition holds, in the given order; null where none does."""
    out = F.lit(None).cast("string")
    for condition, message in reversed(rules):
        out = F.when(condition, message if isinstance(message, Column) else F.lit(message)).otherwise(out)
    return out
