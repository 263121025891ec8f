"""Dates that arrive as month/day/year text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the source date format.
SOURCE_FORMAT = "M/d/yyyy"


def parse_date(text: Column) -> Column:
    """``DateType`` or null where the text is not a calendar date."""
    return F.try_to_timestamp(text, F.lit(SOURCE_FORMAT)).cast("date")


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` or the empty string."""
    return F.coalesce(F.date_format(parse_date(text), "yyyy-MM-dd"), F.lit(""))


def strict_date(text: Column) -> Column:
    """A date, or an error that names the offending value."""
    parsed = parse_date(text)
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("not a month/day/year date: "), F.coalesce(text, F.lit("(missing)")))).cast("date")
    )
