"""Kinds of personal data, by value and by column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.functions.text import strip


def luhn_ok(number: Column) -> Column:
    """13 to 19 digits whose checksum holds; separators are ignored."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def value_kind(value: Column) -> Column:
    v = strip(value)
    rx = {k: v.rlike("(?U)" + p) for k, p in fixed.PII_VALUE_PATTERNS.items()}
    digits = F.length(F.regexp_replace(v, r"(?U)\D", ""))
    phone = (rx["PHONE"] & v.rlike("(?U)" + fixed.PHONE_SEPARATOR) & digits.between(8, 15)
             & ~v.rlike("(?U)" + fixed.DATE_LIKE))
    # A value without a digit or an @ is nothing: most text stops here.
    worth = v.rlike(r"[@\p{Nd}]")
    return (F.when(~worth, F.lit(None).cast("string"))
            .when(v.rlike("(?U)" + fixed.CARD_PATTERN) & luhn_ok(v), "CARD")
            .when(rx["EMAIL"], "EMAIL").when(rx["SSN"], "SSN").when(rx["IP"], "IP").when(rx["IBAN"], "IBAN")
            .when(phone, "PHONE"))


def name_kind(name: Column) -> Column:
    out = None
    for kind, rx in fixed.PII_NAME_PATTERNS.items():
        hit = name.rlike("(?iU)" + rx)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out
