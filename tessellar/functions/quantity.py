"""Exact magnitudes: fractions as (numerator, denominator), thousandths of a millimetre, intervals. No floats inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thousandths of a millimetre to a unit
MILLI = {"in": 25400, "ft": 304800, "cm": 10000, "mm": 1000, "m": 1000000}
# fixed values: spellings of units
ALIASES = {"in": "in", "in.": "in", "inch": "in", "inches": "in", '"': "in", "ft": "ft", "ft.": "ft", "feet": "ft", "foot": "ft", "'": "ft", "mm": "mm", "cm": "cm", "m": "m"}
GLYPHS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
UNIT = r"""(?:inches|inch|in\.?|feet|foot|ft\.?|mm|cm|m|"|')"""


def _int(x: Column) -> Column:
    return F.nullif(x, F.lit("")).cast("bigint")


def spelled(x: Column) -> Column:
    """Fraction glyphs written out: 2½ to 2 1/2."""
    for g, w in GLYPHS.items():
        x = F.regexp_replace(x, f"\\s*{g}", f" {w}")
    return F.trim(x)


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(x), use)[0]


def magnitude(x: Column) -> Column:
    """struct(num, den) of the first number: mixed, plain fraction, decimal or whole; null without one."""
    rx = r"(?:(\d+)\s+)?(\d+)/(\d+)|(\d+)(?:\.(\d+))?"
    found = F.regexp_substr(spelled(x), F.lit(r"(?:\d+\s+)?\d+/\d+|\d+(?:\.\d+)?"))
    groups = F.split(F.regexp_replace(found, f"^(?:{rx})$", "$1|$2|$3|$4|$5"), r"\|", -1)

    def made(g: Column) -> Column:
        part = lambda k: _int(g[k])
        scale = F.pow(F.lit(10), F.length(g[4])).cast("bigint")
        num = F.when(part(2) > 0, F.coalesce(part(0), F.lit(0)) * part(2) + part(1)).when(part(3).isNotNull(), part(3) * scale + F.coalesce(part(4), F.lit(0)))
        den = F.when(part(2) > 0, part(2)).when(part(3).isNotNull(), scale)
        return F.when(num.isNotNull(), F.struct(num.cast("bigint").alias("num"), den.cast("bigint").alias("den")))

    return let(groups, made)


def half_away(num: Column, den: Column) -> Column:
    """num/den to the nearest whole number, halves away from zero, in whole-number arithmetic."""
    sign = F.when(num < 0, -1).otherwise(1)
    top = F.abs(num) * 2 + den
    return (sign * ((top - top % (den * 2)) / (den * 2)).cast("bigint")).cast("bigint")


def unit(x: Column) -> Column:
    """A spelling's unit, or null."""
    table = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return F.try_element_at(table, F.lower(F.trim(x)))


def milli(num: Column, den: Column, u: Column) -> Column:
    """Whole thousandths of a millimetre."""
    table = F.create_map(*[F.lit(v) for kv in MILLI.items() for v in kv])
    return half_away(num * F.try_element_at(table, u), den)


def measure(x: Column) -> Column:
    """struct(amount_milli, unit) of a lexeme like 96 1/8"; null without a number or a known unit."""
    both = F.struct(magnitude(x).alias("m"), unit(F.regexp_extract(F.lower(spelled(x)), r"\d\s*(" + UNIT + ")", 1)).alias("u"))
    return let(both, lambda v: F.when(v["u"].isNotNull() & v["m"].isNotNull(), F.struct(milli(v["m"]["num"], v["m"]["den"], v["u"]).alias("amount_milli"), v["u"].alias("unit"))))


def interval(x: Column) -> Column:
    """struct(min, max, min_inclusive, max_inclusive) in thousandths of a millimetre: 'up to X', 'X to Y', or X alone."""
    kind = "struct<min:bigint,max:bigint,min_inclusive:boolean,max_inclusive:boolean>"
    make = lambda a, b: F.struct(a.alias("min"), b.alias("max"), F.lit(True).alias("min_inclusive"), F.lit(True).alias("max_inclusive"))
    low = F.lower(x)
    upto = measure(F.regexp_extract(low, r"^\s*up\s+to\s+(.+)$", 1))
    a, b = (measure(F.regexp_extract(low, r"^(.*?\d.*?)\s+to\s+(.+)$", k)) for k in (1, 2))
    point = measure(x)
    none = F.lit(None).cast("bigint")
    return (
        F.when(low.rlike(r"^\s*up\s+to\s+"), F.when(upto.isNotNull(), make(none, upto["amount_milli"])))
        .when(low.rlike(r"\d.*\s+to\s+.*\d"), F.when(a.isNotNull() & b.isNotNull(), make(a["amount_milli"], b["amount_milli"])))
        .otherwise(F.when(point.isNotNull(), make(point["amount_milli"], point["amount_milli"])))
        .cast(kind)
    )


def overlap(a: Column, b: Column) -> Column:
    """Whether two intervals share a point; a null bound is unbounded, touching bounds need both to be inclusive."""

    def before(x: Column, y: Column) -> Column:  # x ends before y starts
        touch = (x["max"] == y["min"]) & ~(x["max_inclusive"] & y["min_inclusive"])
        return F.coalesce((x["max"] < y["min"]) | touch, F.lit(False))

    return ~(before(a, b) | before(b, a))


def to_double(x: Column) -> Column:
    m = magnitude(x)
    return m["num"] / m["den"]


def normalised(fact_type: Column, raw: Column, match: Column) -> Column:
    """A fact's number in its type's unit: feet times 12 where the match says feet and not inches."""
    v = to_double(raw)
    feet = match.rlike(r"(?i)\d\s*(?:ft\.?|feet|foot|')") & ~match.rlike(r'(?i)\d\s*(?:in\.?(?![a-z])|inch(?:es)?|")')
    return F.when(fact_type.endswith("_in"), F.round(F.when(feet, v * 12).otherwise(v), 3)).when(fact_type.isin("wind_speed_mph", "racking_degrees"), F.round(v, 3))


def scalar_text(x: Column) -> Column:
    """Numbers compared as numbers, all else as trimmed lower-case text: 130 equals 130.0."""
    y = F.lower(F.trim(x.cast("string")))
    return F.when(y.rlike(r"^-?\d+(\.\d+)?$"), F.regexp_replace(F.regexp_replace(y, r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(y)
