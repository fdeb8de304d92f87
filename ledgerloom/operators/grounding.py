"""Whether a text states a value: numbers, durations, dates and names as they are printed, and labels that give a value away.

All are column expressions, so a whole table is judged inside the JVM. A null value or text is not stated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MONTHS

# Units of a duration in order, their seconds and the words for them
DURATIONS = {"days": (86400.0, "day|days|d"), "hours": (3600.0, "hour|hours|hr|hrs|h"), "minutes": (60.0, "minute|minutes|min|mins|m"), "seconds": (1.0, "second|seconds|sec|secs|s")}
#: Characters that a unit's word may stand behind its number; squeezed characters before a value in which its label counts.
DURATION_SPAN, LABEL_WINDOW = 40, 70
#: Letters that the head of a property's name has at least, to count as a label; characters that a form to be found has.
LEAST_HEAD, LEAST_FORM = 4, 3

_NUMBER = r"^-?\d+(?:[.,]\d+)?$"
_DURATION = r"^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
#: Typographic variants: quotes become plain ones, dashes, underscores and invisible marks go.
_QUOTES, _PLAIN_QUOTES = "‘’‛′“”‟″", "''''\"\"\"\""  # noqa: RUF001
_GONE = "‐‑‒–—―−-_­​‌‍﻿"  # noqa: RUF001
_SPACES = r"[\s   -     　]+"


def typed(c: Column) -> Column:
    return F.translate(c, _QUOTES + _GONE, _PLAIN_QUOTES)


def squeezed(c: Column) -> Column:
    """Without white space, typography and case."""
    return F.lower(F.regexp_replace(typed(c), _SPACES, ""))


def _plainly(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))


def number_forms(value: Column) -> Column:
    """How a page may print a number: with other separators, or without an empty fraction; never rounded."""
    trimmed = F.trim(value)
    plain = F.replace(trimmed, F.lit(","), F.lit("."))
    number = plain.try_cast("double")
    whole = number.cast("long").cast("string")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",")
    of_whole = F.array(trimmed, plain, whole, grouped, F.translate(grouped, ",", "."), F.translate(grouped, ",", " "))
    return F.array_distinct(F.when(number == F.floor(number), of_whole).otherwise(F.array(trimmed, plain, F.translate(plain, ".", ","))))


def number_stated(value: Column, text: Column) -> Column:
    """Whether the text prints the number, and not a longer one that holds it."""
    return F.exists(number_forms(value), lambda f: F.regexp_like(typed(text), F.concat(F.lit(r"(?<!\d)"), _plainly(f), F.lit(r"(?!\d)"))))


def _amount(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once for each row, however often `use` names it, also within a branch."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _amount_stated(amount: Column, words: str, low: Column) -> Column:
    """Whether the lower-case text has the amount and a word for its unit behind it; a pattern is built only where the amount occurs at all."""
    pattern = F.concat(F.lit(r"(?s)(?<!\d)"), _plainly(amount), F.lit(rf"(?!\d).{{0,{DURATION_SPAN}}}?(?:{words})(?![a-z])"))
    return F.contains(low, amount) & F.regexp_like(low, pattern)


def duration_stated(value: Column, text: Column) -> Column:
    """Whether the text writes an ISO duration as it stands, carried into larger units, or in a single unit.

    All parts of one of these must be found: an amount, and a word for its unit within DURATION_SPAN characters behind it.
    """
    v, units = F.trim(value), list(DURATIONS.values())

    def all_stated(amounts: list[Column], low: Column) -> Column:
        def judged(parts: Column) -> Column:
            held = F.exists(parts, lambda amount: amount.isNotNull())
            for i, (_, words) in enumerate(units):
                amount = F.get(parts, F.lit(i))
                held = held & (amount.isNull() | _amount_stated(amount, words, low))
            return held

        return _let(F.transform(F.array(*amounts), _amount), judged)

    def any_way(low: Column, stated: Column, total: Column) -> Column:
        left = [total, *(total % s for s, _ in units)]
        found = all_stated([F.get(stated, F.lit(i)) for i in range(len(units))], low)
        found = found | all_stated([F.nullif(F.floor(x / s).cast("double"), F.lit(0.0)) for x, (s, _) in zip(left, units, strict=False)], low)
        for s, words in units:
            single = total / s
            found = found | ((total > 0) & (single == F.floor(single)) & _let(_amount(single), lambda amount: _amount_stated(amount, words, low)))  # noqa: B023  used at once
        return found

    groups = F.split(F.regexp_replace(v, _DURATION, "$1,$2,$3,$4"), ",")
    stated = F.when(v.rlike(_DURATION), F.transform(groups, lambda x: F.when(x != "", x.try_cast("double"))))
    total = lambda x: sum((F.coalesce(F.get(x, F.lit(i)), F.lit(0.0)) * s for i, (s, _) in enumerate(units)), F.lit(0.0))
    return _let(F.lower(text), lambda low: _let(stated, lambda x: x.isNotNull() & _let(total(x), lambda t: any_way(low, x, t))))


def grounded(value: Column, text: Column) -> Column:
    """Whether the text states the value: a duration, a number, or else any text, by the test of its shape."""
    v = F.trim(value)
    is_duration = v.rlike(_DURATION) & (F.length(v) > 1) & ~v.rlike("T$")
    by_shape = F.when(is_duration, duration_stated(v, text)).when(v.rlike(_NUMBER), number_stated(v, text)).otherwise((squeezed(v) != "") & F.contains(squeezed(text), squeezed(v)))
    return F.coalesce((v != "") & by_shape, F.lit(False))


def date_forms(value: Column) -> Column:
    """Ways to write an ISO date, whole or cut: as it is, its year, its month and year, its day in three orders. Else none."""
    pattern = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$"
    year, month, day = (F.regexp_extract(value, pattern, i) for i in (1, 2, 3))
    name = F.try_element_at(F.array(*(F.lit(m.capitalize()) for m in MONTHS)), F.nullif(F.coalesce(month.try_cast("int"), F.lit(0)), F.lit(0)))
    number = day.try_cast("int").cast("string")
    of_day = F.array(F.concat_ws(" ", number, name, year), F.concat(name, F.lit(" "), number, F.lit(", "), year), F.concat_ws(" ", name, number, year))
    none = F.array().cast("array<string>")
    forms = F.concat(F.array(value, year), F.when(month != "", F.array(F.concat_ws(" ", name, year))).otherwise(none), F.when(day != "", of_day).otherwise(none))
    return F.when(value.rlike(pattern), F.array_distinct(forms)).otherwise(none)


def folded(c: Column) -> Column:
    """Dashes as hyphens, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "‐‑‒–—―−", "-------"), _SPACES, " ")))  # noqa: RUF001


def stated_form(text: Column, forms: Column, least: int = LEAST_FORM) -> Column:
    """The first form, in order, that the text states between word bounds; null if it states none.

    A bound is any character but an ASCII letter or digit, so a form that ends in a bracket has bounds too.
    """
    held = folded(text)
    usable = lambda f: (F.length(f) >= least) & F.regexp_like(held, F.concat(F.lit("(?<![0-9a-z])"), _plainly(folded(f)), F.lit("(?![0-9a-z])")))
    return F.get(F.filter(forms, usable), F.lit(0))


def gives_away(prop: Column, value: Column, text: Column) -> Column:
    """Whether the text prints the last word of the property's name shortly before the value's first place."""
    head = F.lower(F.element_at(F.split(prop, "(?<=[a-z0-9])(?=[A-Z])"), -1))
    needle, low = squeezed(value), squeezed(text)
    at = F.instr(low, needle)
    before = F.substring(low, F.greatest(at - LABEL_WINDOW, F.lit(1)), F.least(at - 1, F.lit(LABEL_WINDOW)))
    return F.coalesce((F.length(head) >= LEAST_HEAD) & (needle != "") & (at > 0) & F.contains(before, head), F.lit(False))


def rates(values: DataFrame, fits: Column, cls: str, prop: str) -> DataFrame:
    """Values seen and stated, and their share: over all, for each class and for each property, in one grouping.

    `level` says which; rows are all that were tried, not those that a filter has left.
    """
    judged = values.select(F.col(cls).alias("class"), F.col(prop).alias("property"), fits.alias("_fits"))
    out = judged.groupingSets([[], [F.col("class")], [F.col("property")]], "class", "property").agg(F.grouping_id("class", "property").alias("_level"), F.count("*").alias("seen"), F.count_if("_fits").alias("stated"))
    level = F.when(F.col("_level") == 3, "all").when(F.col("_level") == 1, "class").otherwise("property")
    return out.select(level.alias("level"), F.when(F.col("_level") == 1, F.col("class")).when(F.col("_level") == 2, F.col("property")).alias("name"), "seen", "stated", F.round(F.coalesce(F.col("stated") / F.nullif(F.col("seen"), F.lit(0)), F.lit(0.0)), 4).alias("rate"))
