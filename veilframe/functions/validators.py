"""Checksum predicates as Column expressions (null in, false out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(value: Column) -> Column:
    """Digits without white space and hyphens."""
    return F.regexp_replace(value, r"(?U)[\s-]", "")


def _false(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def luhn(value: Column) -> Column:
    """13 to 19 ASCII digits with a valid Luhn sum."""
    digits = compact(value)
    return _false(digits.rlike(r"\A[0-9]{13,19}\z") & F.call_function("luhn_check", digits))


def _weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of leading digits times weights."""
    return sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def inn(value: Column) -> Column:
    """Ten or twelve digits with the tax number's check digits (weighted sum mod 11 mod 10)."""
    d = compact(value)
    tail = [2, 4, 10, 3, 5, 9, 4, 6, 8]
    check = lambda weights: (_weighted(d, weights) % 11) % 10
    digit = lambda i: F.substring(d, i, 1).try_cast("int")
    ten = d.rlike(r"\A[0-9]{10}\z") & (check(tail) == digit(10))
    twelve = d.rlike(r"\A[0-9]{12}\z") & (check([7, *tail]) == digit(11)) & (check([3, 7, *tail]) == digit(12))
    return _false(ten | twelve)


def snils(value: Column) -> Column:
    """Eleven digits; the last two are the weighted sum mod 101, 100 counting as 0."""
    d = compact(value)
    total = _weighted(d, list(range(9, 0, -1))) % 101
    return _false(d.rlike(r"\A[0-9]{11}\z") & (F.when(total == 100, 0).otherwise(total) == F.substring(d, 10, 2).try_cast("int")))


def iban(value: Column) -> Column:
    """15 to 34 characters whose rearranged number is 1 mod 97."""
    v = F.upper(compact(value))
    turned = F.concat(F.substring(v, 5, 34), F.substring(v, 1, 4))
    number = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return _false(v.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & (number == 1))
