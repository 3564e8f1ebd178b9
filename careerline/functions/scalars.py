"""Typing, text and arithmetic helpers over ``Column``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,4})?\s*$"
#: Digits that every value of the type has room for.
_FEW = {"int": r"^[0-9]{1,9}\z", "bigint": r"^[0-9]{1,18}\z"}
_DAY = r"^(?!0000)[0-9]{4}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])\z"


def try_number(text: Column | str, to: str = "int") -> Column:
    """Text to a whole number, rounded half away from zero; NULL when the text is no number.

    A failing cast costs an exception per row, so only text is cast that looks like a number.
    Few digits take the cheap cast; fractions, exponents and long digits go through a decimal.
    Each step stands once in the expression, so that a select of many columns is still compiled.
    """
    text = _col(text)
    few = F.when(text.rlike(_FEW[to]), text).try_cast(to)
    return F.coalesce(few, F.round(F.when(text.rlike(_NUMBER), text).try_cast("decimal(38,10)")).try_cast(to))


def _day(text: Column) -> Column:
    """Eight digits that look like a day go through the cast of ISO dates, which is faster than the
    pattern parser. What is no day of the calendar becomes NULL."""
    dashed = F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2))
    return F.when(text.rlike(_DAY), dashed).try_cast("date")


def strict_date(text: Column | str) -> Column:
    """``yyyyMMdd`` text to a date. A bad value is an error, with or without ANSI mode."""
    text = _col(text)
    wrong = F.raise_error(F.concat(F.lit("not a yyyyMMdd date: "), text)).cast("date")
    return F.coalesce(_day(text), F.when(text.isNotNull(), wrong))


def lenient_date(text: Column | str) -> Column:
    """``yyyyMMdd`` text to a date. A bad value becomes NULL, hardly ever at the cost of an exception."""
    return _day(_col(text))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(_col(text), F.lit(""))


def full_name(first: Column | str, last: Column | str) -> Column:
    blank = F.lit("")
    return F.trim(
        F.concat(F.coalesce(_col(first), blank), F.lit(" "), F.coalesce(_col(last), blank))
    )


def joined_key(*parts: Column | str) -> Column:
    """``a-b-c`` as text; NULL as soon as one part is NULL, so a broken key stays visible."""
    texts = [_col(p).cast("string") for p in parts]
    dashed = [texts[0]] + [piece for t in texts[1:] for piece in (F.lit("-"), t)]
    return F.concat(*dashed)


def mentions_any(text: Column | str, *words: str) -> Column:
    """Case-blind search for any of ``words``. NULL text gives NULL, not false."""
    return reduce(lambda a, b: a | b, [_col(text).ilike(f"%{w}%") for w in words])


def years_between(start: Column | str, end: Column | str) -> Column:
    """Whole days from ``start`` to ``end`` as decimal years.

    The divisor is a double on purpose: a decimal one would give six-digit ages and could move
    an event across an ``age <= limit`` boundary.
    """
    return F.datediff(_col(end), _col(start)) / F.lit(DAYS_PER_YEAR)


def age_year(age: Column | str) -> Column:
    return F.floor(_col(age)).cast("int")


def half_away_round(value: Column | str, digits: int) -> Column:
    """Round the double itself, half away from zero.

    ``F.round(x, n)`` rounds the decimal text of the double and so turns 1.005 into 1.01;
    scaling first rounds the stored value (1.00).
    """
    scale = float(10**digits)
    return F.round(_col(value) * F.lit(scale)) / F.lit(scale)


def ratio(part: Column | str, whole: Column | str, digits: int) -> Column:
    """``part / whole`` rounded; NULL for an empty whole."""
    return half_away_round(_col(part) / F.nullif(_col(whole), F.lit(0)), digits)
