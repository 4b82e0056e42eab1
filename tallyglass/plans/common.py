"""Small expressions that several queries share."""

from pyspark.sql import functions as F

def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def money(c):
    """Four decimals: float sums depend on row order in the last bits."""
    return F.round(c, 4)


def ratio(c):
    return F.round(c, 6)


def to_day(c):
    return F.date_format(c, "yyyy-MM-dd")


def stamp(text: str):
    """A zone-free timestamp literal, comparable to the stored columns without a cast."""
    return F.lit(text).cast("timestamp_ntz")


def days(col: str, first: str, last: str):
    """Half-open day range on a raw timestamp column, so that it reaches the scan."""
    return (F.col(col) >= stamp(first)) & (F.col(col) < stamp(last))
