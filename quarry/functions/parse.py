"""Lenient parsing of numbers and dates as they come from spreadsheets and web tables.

Everything is a built-in expression; what can't be read is null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that dates come in. Fixed values.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd.MM.yyyy", "yyyyMMdd")


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), r"[\s\x{00A0}%]", "")


def number(c: Column) -> Column:
    """A number with either decimal sign: where both signs occur, the last one is the decimal sign
    and the other parts thousands; a lone comma is a decimal sign."""
    s = _bare(c)
    comma, dot = F.locate(",", F.reverse(s)), F.locate(".", F.reverse(s))
    both = (comma > 0) & (dot > 0)
    decimal_comma = F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")
    plain = F.regexp_replace(s, ",", "")
    chosen = F.when(both & (comma < dot), decimal_comma).when(both, plain).otherwise(F.regexp_replace(s, ",", "."))
    return chosen.try_cast("double")


def percent(c: Column) -> Column:
    """A share in per cent with a decimal comma or point."""
    return F.regexp_replace(_bare(c), ",", ".").try_cast("double")


def position(c: Column) -> Column:
    """A position in per cent: blanks, `<0,5` and whatever can't be read count as zero."""
    read = percent(c)
    return F.when(F.trim(c.cast("string")).startswith("<"), F.lit(0.0)).otherwise(F.coalesce(F.when(F.isnan(read), None).otherwise(read), F.lit(0.0)))


def date(c: Column, not_after: Column | None = None) -> Column:
    """The first format that fits; dates after `not_after` are null."""
    s = F.trim(c.cast("string"))
    found = F.coalesce(*[F.when(F.length(s) >= (8 if f == "yyyyMMdd" else 10), F.to_date(F.try_to_timestamp(s, F.lit(f)))) for f in DATE_FORMATS])
    return found if not_after is None else F.when(found <= not_after, found)


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def positive(c: Column) -> Column:
    """Whether a number is finite and above zero; null counts as no."""
    return F.coalesce(finite(c) > 0, F.lit(False))
