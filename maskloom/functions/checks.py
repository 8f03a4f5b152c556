"""Checksums and calendar checks (FN5-7, SCN14-15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions import vocab as V
from maskloom.functions.kernel import matches


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit(value: Column, at: int) -> Column:
    return F.substring(value, at + 1, 1).cast("int")


def _weighted(value: Column, weights) -> Column:
    return reduce(lambda a, b: a + b, (_digit(value, at) * w for at, w in enumerate(weights)))


def registration_checksum(number: Column, shift: int = 11) -> Column:
    """13 digits: the last is (shift - weighted sum mod 11) mod 10, and the region code is at most 95."""
    right = (F.lit(shift) - _weighted(number, V.RRN_WEIGHTS) % 11) % 10 == _digit(number, 12)
    return right & (F.substring(number, 8, 2).cast("int") <= 95)


def business_checksum(number: Column) -> Column:
    """10 digits: weighted sum, the ninth digit's product counting tens and units."""
    ninth = _digit(number, 8) * V.BRN_WEIGHTS[8]
    total = _weighted(number, V.BRN_WEIGHTS[:8]) + F.floor(ninth / 10).cast("int") + ninth
    return (F.lit(10) - total % 10) % 10 == _digit(number, 9)


def birth_date_valid(entity: Column, value: Column) -> Column:
    """Whether a registration number starts with a date of its century; true for other entities."""
    number = digits(value)
    seventh = F.substring(number, 7, 1)
    century = (
        F.when((entity == "KR_RRN") & seventh.isin("0", "9"), "18").when((entity == "KR_RRN") & seventh.isin("1", "2"), "19")
        .when((entity == "KR_RRN") & seventh.isin("3", "4"), "20").when((entity == "KR_FRN") & seventh.isin("5", "6"), "19")
        .when((entity == "KR_FRN") & seventh.isin("7", "8"), "20")
    )
    part = lambda text, at: F.substring(text, at, 2).try_cast("int")
    month, day = part(number, 3), part(number, 5)
    # by arithmetic, since a parser of dates throws an exception for each day that is none
    common = (part(number, 1) % 4 != 0) | ((part(number, 1) == 0) & (part(century, 1) % 4 != 0))
    days = F.when(month == 2, F.when(common, 28).otherwise(29)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    shaped = matches(value, "[0-9]{6}-?[0-9]{7}") & F.coalesce(century.isNotNull() & month.between(1, 12) & (day >= 1) & (day <= days), F.lit(False))
    return F.when(entity.isin("KR_RRN", "KR_FRN"), shaped).otherwise(F.lit(True))


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def email_valid(value: Column) -> Column:
    """Whether the domain ends in a public suffix with a name before it.

    A suffix is a two-letter country code, bare or below a registry label such as
    ``co``, or a generic name of the fixed list.
    """
    domain = F.lower(F.regexp_extract(value, "@([^@]*)$", 1))
    registry = "(?:" + "|".join(V.REGISTRY_LABELS) + ")"
    generic = "(?:" + "|".join(V.GENERIC_DOMAINS) + ")"
    named = domain.rlike(rf"[^.]\.(?:{registry}\.)?[a-z]{{2}}$") & ~matches(domain, rf"{registry}\.[a-z]{{2}}")
    return named | domain.rlike(rf"[^.]\.{generic}$")


def account_layout(value: Column) -> Column:
    """Whether a hyphenated number has a documented layout."""
    return matches(value, "|".join(f"(?:{pattern})" for _, _, pattern, _ in V.ACCOUNT_LAYOUTS))


def account_bank(value: Column) -> Column:
    """The bank whose documented layout fits a bare number, else null."""
    out = F.lit(None).cast("string")
    for bank, pattern in reversed(V.BARE_LAYOUTS):
        out = F.when(matches(value, pattern), bank).otherwise(out)
    return out
