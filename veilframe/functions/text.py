"""Checksums and normal forms of text values, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and check characters of the 18-character identity number.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once: a bound variable, where a repeated expression would be
    evaluated at every mention."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def normalised(c: Column) -> Column:
    """Lower case without underscores, hyphens and white space."""
    return F.regexp_replace(F.lower(c), r"[_\-\s]+", "")


def normalised_text(s: str) -> str:
    import re

    return re.sub(r"[_\-\s]+", "", s.lower())


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Luhn check of a string of digits."""

    def term(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(c), ""), term), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def id_card_valid(c: Column) -> Column:
    total = F.lit(0)
    for i, w in enumerate(ID_WEIGHTS):
        total = total + F.coalesce(F.substring(c, i + 1, 1).try_cast("int"), F.lit(0)) * w
    return F.coalesce(c.rlike(r"^[0-9]{17}.$") & (F.upper(F.substring(c, 18, 1)) == F.substr(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1))), F.lit(False))
