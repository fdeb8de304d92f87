"""Values as documents write them, and back: numbers, dates, times and durations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import MONTHS, SECONDS


def _month_name(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(m.capitalize()) for m in MONTHS)), n)


def written_number(c: Column) -> Column:
    """Thousands commas in the whole part; the fraction as it stands."""
    whole = F.regexp_replace(F.substring_index(c, ".", 1), r"(?<=\d)(?=(\d{3})+$)", ",")
    return F.when(F.contains(c, F.lit(".")), F.concat(whole, F.lit("."), F.substring_index(c, ".", -1))).otherwise(whole)


def canonical_number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def written_date(c: Column) -> Column:
    """21 February 1967 of 1967-02-21."""
    return F.concat_ws(" ", F.substr(c, F.lit(9), F.lit(2)).cast("int").cast("string"), _month_name(F.substr(c, F.lit(6), F.lit(2)).cast("int")), F.substr(c, F.lit(1), F.lit(4)))


def canonical_date(c: Column) -> Column:
    month = F.array_position(F.array(*(F.lit(m.capitalize()) for m in MONTHS)), F.regexp_extract(c, r"^\d+ (\w+) \d+$", 1))
    return F.format_string("%s-%02d-%02d", F.substring_index(c, " ", -1), month.cast("int"), F.substring_index(c, " ", 1).cast("int"))


def written_time(c: Column) -> Column:
    """2:05 pm of 14:05."""
    hour = F.substring_index(c, ":", 1).cast("int")
    return F.concat(((hour + 11) % 12 + 1).cast("string"), F.lit(":"), F.substr(c, F.lit(4), F.lit(2)), F.when(hour < 12, " am").otherwise(" pm"))


def canonical_time(c: Column) -> Column:
    hour = F.substring_index(c, ":", 1).cast("int") % 12 + F.when(F.endswith(c, F.lit("pm")), 12).otherwise(0)
    return F.format_string("%02d:%s", hour, F.regexp_extract(c, r":(\d\d)", 1))


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO duration, inside the JVM; null for anything else."""
    n = r"(?:(\d+(?:\.\d+)?)%s)?"
    pattern = "(?i)^P(?!$)" + "".join(n % u for u in "YMWD") + "(?:T(?!$)" + "".join(n % u for u in "HMS") + ")?$"
    total = sum((F.coalesce(F.regexp_extract(c, pattern, i + 1).try_cast("double"), F.lit(0.0)) * s for i, s in enumerate(SECONDS.values())), F.lit(0.0))
    return F.when(c.rlike(pattern), total)
