"""Column expressions shared by the operators (all built-in functions, no UDFs)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from careflow.schemas import MONTHS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(value: dt.date) -> Column:
    return F.lit(value).cast("date")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 where the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def pct(num: Column, den: Column, digits: int | None = None) -> Column:
    """100 * num / den, 0.0 for an empty denominator."""
    value = ratio(num, den) * F.lit(100.0)
    return value if digits is None else F.round(value, digits)


def trunc(value: Column) -> Column:
    """Integer part of a number (NULL becomes 0)."""
    return F.coalesce(value, F.lit(0)).cast("bigint")


def rounded(value: Column, digits: int = 2) -> Column:
    """Rounded double, NULL becomes 0.0."""
    return F.round(F.coalesce(value.cast("double"), F.lit(0.0)), digits)


MONEY = "DECIMAL(20,6)"  # type in which money is summed: exact, so no order of addition shows


def money(total: Column) -> Column:
    """An exact money total rounded to cents, as double; NULL becomes 0.0."""
    return F.round(F.coalesce(total, F.lit(0).cast(MONEY)), 2).cast("double")


def ceiled(value: Column) -> Column:
    return F.coalesce(F.ceil(value), F.lit(0)).cast("bigint")


def years_between(start: Column, end: Column) -> Column:
    """Age in years with the 365.25-day year."""
    return F.datediff(end, start) / F.lit(365.25)


def whole_years(start: Column, end: Column) -> Column:
    """Age in whole years, truncated towards zero."""
    return years_between(start, end).cast("int")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(3600.0)


def known_on(ts: Column) -> Column:
    """First date whose midnight is not before ``ts``: ``ts <= midnight(d)`` iff ``known_on <= d``."""
    return F.to_date(ts + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND"))


def month_label(month: Column) -> Column:
    """Calendar month number -> label."""
    pairs = [F.lit(x) for i, name in enumerate(MONTHS, 1) for x in (i, name)]
    return F.create_map(*pairs)[month]


def decade(age: Column) -> Column:
    return (F.floor(age / F.lit(10)) * 10).cast("bigint")


def decade_label(age: Column) -> Column:
    low = decade(age)
    return F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string"))


# Patterns of coded names such as "Name (nature)".
NAME_PATTERN = r"([^(]+)\("
NATURE_PATTERN = r"\(([^)]+)\)"
CONCEPT_PATTERN = r"(?s)^(.*)\("
SEMANTICS_PATTERN = r"\(([^()]*)\)[^(]*$"


def _before_parenthesis(text: Column, pattern: str) -> Column:
    return F.when(F.instr(text, "(") > 0, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(F.trim(text))


def coded_name(text: Column) -> tuple[Column, Column]:
    """Split ``Name (nature)`` into (name, nature).

    The name ends before the first parenthesis, whose content is the nature; further ones are not read. The name is trimmed; without a
    parenthesis it is the whole text, and the nature is ''.
    """
    return _before_parenthesis(text, NAME_PATTERN), F.regexp_extract(text, NATURE_PATTERN, 1)


def concept_and_semantics(text: Column) -> tuple[Column, Column]:
    """Split a fully specified name into the concept before, and the semantics inside, its last parenthesis."""
    return (
        _before_parenthesis(text, CONCEPT_PATTERN),
        F.trim(F.regexp_extract(text, SEMANTICS_PATTERN, 1)),
    )


def text_month(date: Column) -> Column:
    """'Jan 2001' label of a date, from the month label map."""
    return F.concat(month_label(F.month(date)), F.lit(" "), F.year(date).cast("string"))
