"""Two date readers that differ by design, edition stamps, and what a date means as of a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _group(x: Column, pattern: str, k: int) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(x, pattern, k), F.lit("")), F.lit("9999")).cast("int")


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd where the parts are a day of the calendar, else null."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    there = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(there, F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))


def slash_date(first: Column, second: Column, year: Column) -> Column:
    """Month first where that is certain: equal parts, or a second part over 12. Else null."""
    return F.when((first == second) | (second > 12), iso_date(year, first, second))


def strict_date(x: Column) -> Column:
    """The one date a lexeme holds, as ISO; null if it holds none, two that differ, or one that can be read two ways."""
    isos = F.regexp_extract_all(x, F.lit(r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"), F.lit(0))
    slashes = F.regexp_extract_all(x, F.lit(r"(?<!\d)\d{1,2}/\d{1,2}/\d{4}(?!\d)"), F.lit(0))
    found = F.array_distinct(F.concat(isos, slashes))
    one = F.try_element_at(found, F.lit(1))
    iso, slash = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    parsed = F.when(one.rlike(iso), iso_date(*[_group(one, iso, k) for k in (1, 2, 3)])).otherwise(slash_date(_group(one, slash, 1), _group(one, slash, 2), _group(one, slash, 3)))
    return F.when(F.size(found) == 1, parsed)


def lenient_date(x: Column) -> Column:
    """The first date by kind of wording: ISO, month/day/year (two-digit years pivot at 70), month by name."""
    iso = F.nullif(F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    mdy = r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})"
    year = _group(x, mdy, 3)
    year = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    named = r"(?i)([a-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(x, named, 1)))
    return (
        F.when(iso.isNotNull(), iso)
        .when(x.rlike(mdy), iso_date(year, _group(x, mdy, 1), _group(x, mdy, 2)))
        .when(x.rlike(named) & (month > 0), iso_date(_group(x, named, 3), month, _group(x, named, 2)))
    )


def edition_stamp(x: Column) -> Column:
    """A printed REV month.year as yyyy-MM; null where the month or the year (1990 to 2100) cannot be."""
    rx = r"(?i)(?<![A-Za-z])(?:WEB[\s-]*)?REV(?:ISED)?\.?\s*[:#]?\s*(\d{1,2})\s*[./-]\s*(\d{4}|\d{2})(?![\d./-])"
    month, year = _group(x, rx, 1), _group(x, rx, 2)
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.when(month.between(1, 12) & year.between(1990, 2100), F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0")))


def expiry_status(expiration: Column, as_of: Column) -> Column:
    """expired, in_force or unknown: ISO texts compared."""
    return F.when(expiration.isNull(), "unknown").when(expiration < as_of, "expired").otherwise("in_force")


def resolved(fact: Column, curated: Column) -> Column:
    """A date read in the document before one a curator wrote."""
    return F.coalesce(fact, curated)
