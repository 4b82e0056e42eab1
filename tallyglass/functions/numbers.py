"""Numbers in prose, canonical values, readable literals and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.functions.text import strip

_PATTERN = "(?U)" + fixed.NUMBER
_WHOLE = "(?U)^" + fixed.NUMBER + "$"


def raw_numbers(c: Column) -> Column:
    """The numbers of a text as written, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_PATTERN), F.lit(0))


def number_parts(raw: Column) -> Column:
    """struct<raw, whole, frac, unit> of one number as written."""
    part = lambda i: F.regexp_extract(raw, _WHOLE, i)
    return F.struct(raw.alias("raw"), F.replace(part(1), F.lit(","), F.lit("")).alias("whole"), part(2).alias("frac"), part(3).alias("unit"))


def number_value(p: Column) -> Column:
    """struct<value, decimals, raw> from parts; k/M/bn scale the value, % does not."""
    unit, frac, raw = p["unit"], p["frac"], p["raw"]
    scale = F.lit(1.0)
    for x in sorted(set(fixed.UNIT_MULTIPLIERS.values())):
        scale = F.when(unit.isin(*[u for u, q in fixed.UNIT_MULTIPLIERS.items() if q == x]), x).otherwise(scale)
    power = F.round(F.log10(scale)).cast("int")
    value = F.concat(p["whole"], frac).cast("double") * scale
    value = F.when(raw.startswith("-") | raw.startswith("−"), -value).otherwise(value)
    decimals = F.greatest(F.greatest(F.length(frac) - 1, F.lit(0)) - power, F.lit(-12))
    return F.struct(value.alias("value"), decimals.alias("decimals"), raw.alias("raw"))


def numbers(c: Column) -> Column:
    """array<struct<value, decimals, raw>>; each number is taken apart once."""
    return F.transform(F.transform(raw_numbers(c), lambda m: number_parts(strip(m))), number_value)


def plain_decimal(v: Column, places: int = 4) -> Column:
    """A number as text without exponent or trailing zeros."""
    text = F.round(v, places).cast(f"decimal(38,{places})").cast("string")
    text = F.regexp_replace(text, r"\.?0+$", "")
    return F.when(text == "-0", "0").otherwise(text)


def canonical(c: Column, kind: str) -> Column:
    """One spelling per value: numbers to four places, numeric text as a number, booleans as words."""
    if kind == "boolean":
        return F.initcap(c.cast("string"))
    if kind == "string":
        number = c.try_cast("double")
        usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e30) & c.rlike(r"[0-9]\s*$")
        return F.when(usable, plain_decimal(number)).otherwise(c)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        v = c.cast("double")
        return F.when(F.isnan(v), "NaN").when(F.abs(v) < 1e30, plain_decimal(v)).otherwise(v.cast("string"))
    return c.cast("string")


def raw(c: Column, kind: str) -> Column:
    """One text per value such that equal values, and no others, have equal texts: 5, 5.0 and true's 1 are numbers, '5' is not."""
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return F.concat(F.lit("n"), c.cast("bigint").cast("string"))
    if kind in ("float", "double") or kind.startswith("decimal"):
        v = c.cast("double")
        whole = (v == F.floor(v)) & (F.abs(v) < 2.0**53)
        return F.concat(F.lit("n"), F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string")))
    if kind == "string":
        return F.concat(F.lit("s"), c)
    return F.concat(F.lit(kind), F.lit(":"), F.hex(c) if kind == "binary" else c.cast("string"))


def literal(c: Column, limit: int = 40) -> Column:
    """A text value quoted for display; long ones are cut with an ellipsis."""
    cut = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)
    return F.concat(F.lit("'"), F.replace(cut, F.lit("'"), F.lit("''")), F.lit("'"))


def typed_literal(c: Column, kind: str) -> Column:
    if kind == "string":
        return literal(c)
    if kind == "binary":
        return F.lit("<blob>")
    return c.cast("string")


def size_text(b: Column) -> Column:
    gib = b / F.lit(2.0**30)
    return F.when(gib >= 0.1, F.concat(F.format_number(gib, 2), F.lit(" GiB"))).otherwise(
        F.concat(F.format_number(b / F.lit(2.0**20), 0), F.lit(" MiB")))


def usd(b: Column) -> Column:
    return b / F.lit(2.0**40) * F.lit(fixed.USD_PER_TIB)


def cost_text(b: Column) -> Column:
    price = usd(b)
    shown = F.when(price >= 0.0001, F.concat(F.lit("~$"), F.format_number(price, 4))).otherwise("< $0.0001")
    return F.concat(size_text(b), F.lit(" scanned ("), shown, F.lit(")"))
