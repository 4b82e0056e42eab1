"""Words, stems, n-grams and spans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass import fixed

EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def raw_words(c: Column) -> Column:
    """The words of an identifier or text as written; explode, then lower and stem as plain expressions."""
    spaced = F.regexp_replace(c, fixed.CAMEL_BOUNDARY, " ")
    return F.regexp_extract_all(spaced, F.lit(fixed.PLAIN_WORD), F.lit(0))


def words(c: Column) -> Column:
    """'BillingCountry', 'billing_country', 'T2.Score' -> lower-case words."""
    return F.transform(raw_words(c), F.lower)


def stem(w: Column) -> Column:
    """Light plural folding of one word."""
    n = F.length(w)
    return (F.when((n > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
            .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1))
            .otherwise(w))


def is_stopword(w: Column) -> Column:
    return w.isin(*fixed.STOPWORDS)


def tokens(c: Column, keep_stop: bool = False) -> Column:
    """Stems in order. The stop list is applied after stemming, so 'this' stays as 'thi'."""
    stems = F.transform(words(c), stem)
    return stems if keep_stop else F.filter(stems, lambda w: ~is_stopword(w))


# Overlapping matches by look-ahead: one linear pass. The guard keeps the two halves
# of a character outside the basic plane together.
_TRIGRAM = r"(?s)(?![\uDC00-\uDFFF])(?=(...))"


def padded(c: Column) -> Column:
    """The text that trigrams are taken from."""
    return F.concat(F.lit("  "), strip(F.lower(c)), F.lit(" "))


def trigrams(c: Column) -> Column:
    """The set of character trigrams of the trimmed, lower-cased, padded text."""
    return F.array_distinct(F.regexp_extract_all(padded(c), F.lit(_TRIGRAM), F.lit(1)))


def spans(c: Column, max_words: int = 4) -> Column:
    """Quoted strings, then every run of 1..max_words words that is not all stop words."""
    w = F.regexp_extract_all(c, F.lit("(?U)" + fixed.SPAN_WORD), F.lit(0))
    quoted = F.regexp_extract_all(c, F.lit(fixed.QUOTED_SPAN), F.lit(1))

    def runs(n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice(w, i, F.lit(n)))
        parts = F.filter(parts, lambda p: F.exists(p, lambda x: ~is_stopword(F.lower(x))))
        return F.transform(parts, lambda p: F.array_join(p, " "))

    every = F.concat(quoted, *[runs(n) for n in range(1, max_words + 1)])
    return F.filter(F.transform(every, lambda s: F.btrim(s, F.lit(".,?"))), lambda s: F.length(s) > 2)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    s = strip(c)
    return F.when(F.length(s) == 0, 0).otherwise(F.size(F.split(s, r"(?U)\s+")))


def table_name(stem_col: Column) -> Column:
    """A file stem as a table name."""
    n = F.btrim(F.regexp_replace(F.lower(stem_col), r"[^\p{L}\p{N}]", "_"), F.lit("_"))
    return F.when(n == "", "data").otherwise(n)
