"""Dates in free text, validated; nothing is invented where a text has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names, by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null for a date that does not exist, or a year outside 2000 to 2099."""
    text = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(year.rlike("^20[0-9][0-9]$"), F.try_to_date(text, "yyyy-MM-dd"))


def _any_date(year: Column, month: Column, day: Column) -> Column:
    """The same of any year of four digits."""
    return F.try_to_date(F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def iso_or_day_month(text: Column) -> Column:
    """2026-10-07, or 7 October 2026."""
    part = lambda p, k: F.regexp_extract(text, p, k)
    iso, named = r"\b(20[0-9]{2})-([0-9]{2})-([0-9]{2})\b", r"(?i)\b([0-9]{1,2})(?:st|nd|rd|th)? +(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,? +(20[0-9]{2})\b"
    return F.coalesce(_date(part(iso, 1), part(iso, 2), part(iso, 3)), _date(part(named, 3), _month(part(named, 2)), part(named, 1)))


def month_first(text: Column) -> Column:
    """10/07/2026, or October 7, 2026."""
    part = lambda p, k: F.regexp_extract(text, p, k)
    slashed, named = r"\b([0-9]{1,2})/([0-9]{1,2})/(20[0-9]{2})\b", r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? +([0-9]{1,2})(?:st|nd|rd|th)?,? +(20[0-9]{2})\b"
    return F.coalesce(_date(part(slashed, 3), part(slashed, 1), part(slashed, 2)), _date(part(named, 3), _month(part(named, 1)), part(named, 2)))


def publisher_date(text: Column) -> Column:
    """Of a publisher's field: 10/07/2026 or October 7, 2026 at its begin, with the month first; else 2026-10-07, 7 October 2026 or 7-Oct-2026 anywhere."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    part = lambda p, k: F.regexp_extract(bare, p, k)
    slashed, months = r"^([0-9]{1,2})/([0-9]{1,2})/(20[0-9]{2})(?:\s|$)", "|".join([*MONTH_NAMES, *MONTHS])
    american, dashed = rf"(?i)^({months})\s+([0-9]{{1,2}}),?\s+(20[0-9]{{2}})\b", rf"(?i)\b([0-9]{{1,2}})[ -]({months})[ -](20[0-9]{{2}})\b"
    iso = r"\b(20[0-9]{2})-([0-9]{2})-([0-9]{2})\b"
    return F.coalesce(
        _date(part(slashed, 3), part(slashed, 1), part(slashed, 2)), _date(part(american, 3), _month(part(american, 1)), part(american, 2)),
        F.when(bare.rlike(iso), _date(part(iso, 1), part(iso, 2), part(iso, 3))).otherwise(_date(part(dashed, 3), _month(part(dashed, 2)), part(dashed, 1))),
    )


def _named_month(name: Column) -> Column:
    """Of a month's whole name, its first three letters, or sept; else null."""
    whole = F.array(*[F.lit(m) for m in MONTH_NAMES])
    short = F.array_position(F.array(*map(F.lit, MONTHS)), F.when(name == "sept", "sep").otherwise(name))
    return F.nullif(F.greatest(F.array_position(whole, name), short), F.lit(0)).cast("int")


def free_deadline(text: Column) -> Column:
    """A deadline in free text: ISO, 9th of September 2026, September 9, 2026, or 09/10/2026 and 9-10-2026 with the day first. The first place of each shape counts; what no shape reads is null."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    part = lambda p, k: F.regexp_extract(low, p, k)
    iso, day = r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b", r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?([a-z]+)\.?,?\s+([0-9]{4})\b"
    month, plain = r"\b([a-z]+)\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})\b", r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\b"
    return F.coalesce(_any_date(part(iso, 1), part(iso, 2), part(iso, 3)), _any_date(part(day, 3), _named_month(part(day, 2)), part(day, 1)), _any_date(part(month, 3), _named_month(part(month, 1)), part(month, 2)), _any_date(part(plain, 3), part(plain, 2), part(plain, 1)))


def deadline_time(text: Column) -> Column:
    """(time, zone) as stated, or nulls."""
    time = F.nullif(F.regexp_extract(text, r"(?i)\b([01]?[0-9]|2[0-3])[:.]([0-5][0-9]) *(am|pm)?\b", 0), F.lit(""))
    zone = F.nullif(F.regexp_extract(text, r"\b(UTC|GMT|CET|CEST|EET|EEST|EST|EDT)(?: ?[+-][0-9]{1,2})?\b", 0), F.lit(""))
    return F.struct(F.trim(time).alias("time"), F.when(time.isNotNull(), zone).alias("zone"))
