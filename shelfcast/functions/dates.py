"""Calendar column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(date: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(date)


def is_weekend(date: Column) -> Column:
    return F.weekday(date).isin(5, 6).cast("int")


def span_days(first: Column, last: Column) -> Column:
    return F.datediff(last, first)


def following_days(last: Column, periods: int) -> Column:
    """Array of the ``periods`` days after ``last``; empty for zero periods."""
    if periods == 0:
        return F.array().cast("array<date>")
    return F.sequence(F.date_add(last, 1), F.date_add(last, periods))


def parse_date(value: Column, formats) -> Column:
    """First pattern that parses gives the date; null when none does.

    A pattern is tried only on text of its shape: a failed parse costs far more than a match.
    """
    attempts = []
    for pattern in formats:
        parsed = F.try_to_timestamp(value, F.lit(pattern))
        shape = _shape(pattern)
        attempts.append(F.when(value.rlike(shape), parsed) if shape else parsed)
    return F.coalesce(*attempts).cast("date")


def _shape(pattern: str) -> str | None:
    """Regular expression of the texts a datetime pattern can match; None for unusual patterns."""
    parts = []
    for token in (m.group() for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", pattern)):
        if token.startswith("'"):
            parts.append(re.escape(token.strip("'")))
        elif not token[0].isalpha():
            parts.append(re.escape(token))
        elif token in ("MMM", "MMMM"):
            parts.append(r"\p{L}+")
        elif token[0] in "yMdHms":
            parts.append(r"\d{%d}" % len(token) if len(token) > 1 else r"\d{1,2}")
        else:
            return None
    return "^" + "".join(parts) + "$"
