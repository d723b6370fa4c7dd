"""Text expressions: tokens, paragraphs and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.policy import NUMBER_PATTERN, TOKEN_PATTERN


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Non-empty trimmed paragraphs, split on blank lines."""
    pieces = F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda p: p != "")


def numbers(text: Column) -> Column:
    """Standalone numbers of a text as doubles."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_PATTERN), F.lit(0))
    return F.transform(found, lambda n: F.regexp_replace(n, r"[$,]", "").try_cast("double"))


def number_is_known(value: Column, allowed: Column) -> Column:
    """Within 0.001, or a ten-thousandth of an allowed value, of some allowed value."""
    return F.exists(allowed, lambda v: F.abs(value - v) <= F.greatest(
        F.lit(0.001), F.abs(v) * 0.0001))


def all_numbers_known(text: Column, allowed: Column) -> Column:
    return F.forall(numbers(text), lambda n: number_is_known(n, allowed))
