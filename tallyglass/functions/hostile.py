"""Text that reads like an instruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.operators.present import text_columns

FLAGS = "(?isU)"
PATTERN = FLAGS + "|".join(f"(?:{p})" for p in fixed.INSTRUCTION_PATTERNS)
# For each pattern, pieces of which any match must contain one. Plain substring
# search is far cheaper than the patterns, and few texts contain a piece.
PIECES = (
    ("instruction", "prompt", "rule", "message", "direction"),
    ("you are now", "act as", "pretend ", "from now on"),
    ("system prompt", "developer message", "jailbreak", "dan mode"),
    ("instruction",),
    ("instead", "regardless", "no matter"),
    ("always", "must"),
    ("link", "url", "image", "markdown"),
    ("http",),
    ("<", "inst]", "#"),
)


def folded(c: Column) -> Column:
    """Lower case, with the letters that case-blind matching equates to i, k and s."""
    return F.translate(F.lower(c), "ıſİK", "isik")


def any_pattern(c: Column) -> Column:
    low, hit = folded(c), None
    for pattern, pieces in zip(fixed.INSTRUCTION_PATTERNS, PIECES, strict=True):
        has = None
        for piece in pieces:
            x = F.contains(low, F.lit(piece))
            has = x if has is None else has | x
        one = has & c.rlike(FLAGS + pattern)
        hit = one if hit is None else hit | one
    return hit


def looks_like_instruction(c: Column) -> Column:
    return F.coalesce((F.length(c) >= fixed.INSTRUCTION_MIN_LENGTH) & any_pattern(c), F.lit(False))


def neutralize(c: Column) -> Column:
    return F.when(looks_like_instruction(c), fixed.INSTRUCTION_PLACEHOLDER).otherwise(c)


def neutralize_frame(df: DataFrame) -> DataFrame:
    """Every text cell that reads like an instruction becomes the placeholder."""
    texts = set(text_columns(df))
    return df.select(*[neutralize(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])


def replace_spans(c: Column) -> Column:
    """Only the matching spans are replaced."""
    return F.when(any_pattern(c), F.regexp_replace(c, PATTERN, F.lit(fixed.INSTRUCTION_PLACEHOLDER))).otherwise(c)


def suspicious_name(c: Column) -> Column:
    return looks_like_instruction(F.replace(c, F.lit("_"), F.lit(" ")))
