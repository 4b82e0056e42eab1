"""SQL fragments that several twins share. DuckDB's regex has no lookaround, so
word boundaries in identifiers are made by two capturing replacements."""

from tallyglass import fixed

STOP_LIST = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)


def words(c: str) -> str:
    a = f"regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    b = f"regexp_replace({a}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_transform(regexp_extract_all({b}, '[A-Za-z0-9]+'), lambda w : lower(w))"


def stem(w: str) -> str:
    return (f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN substr({w}, 1, length({w}) - 3) || 'y' "
            f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN substr({w}, 1, length({w}) - 1) "
            f"ELSE {w} END")


def tokens(c: str) -> str:
    return f"list_filter(list_transform({words(c)}, lambda w : {stem('w')}), lambda t : t NOT IN ({STOP_LIST}))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def trigrams(c: str) -> str:
    chars = f"string_split('  ' || {strip(f'lower({c})')} || ' ', '')"
    return (f"(SELECT list_distinct(list_transform(range(1, len(ch) - 1), lambda i : ch[i] || ch[i + 1] || ch[i + 2])) "
            f"FROM (SELECT {chars} AS ch))")


def plain_decimal(v: str) -> str:
    return f"regexp_replace(CAST(CAST(round({v}, 4) AS DECIMAL(38, 4)) AS VARCHAR), '\\.?0+$', '')"


def rate_ends(rel: str, keys: str) -> str:
    """keys, lo, hi of relation `rel` (keys, n, k): quantiles of Binomial(n, k/n)/n by summing its probabilities."""
    return (f"SELECT {keys}, min(i) FILTER (WHERE c >= 0.025 - 1e-12) / any_value(n) AS lo, min(i) FILTER (WHERE c >= 0.975 - 1e-12) / any_value(n) AS hi FROM ("
            f"SELECT {keys}, n, i, sum(m) OVER (PARTITION BY {keys} ORDER BY i) AS c FROM ("
            f"SELECT {keys}, n, i, CASE WHEN k = 0 THEN (i = 0)::INT WHEN k = n THEN (i = n)::INT ELSE "
            f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(k / n) + (n - i) * ln(1 - k / n)) END AS m "
            f"FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM {rel}))) GROUP BY {keys}")


def integral(rel: str, keys: str, f: str, panels: int = 2000) -> str:
    """keys, area of relation `rel` (keys, top, parameters): Simpson's rule for f, an expression of x, from 0 to top."""
    return (f"SELECT {keys}, any_value(top) / {6 * panels} * sum((CASE WHEN j = 0 OR j = {2 * panels} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * {f}) AS area "
            f"FROM (SELECT *, j * top / {2 * panels} AS x FROM (SELECT *, unnest(range(0, {2 * panels + 1})) AS j FROM {rel})) GROUP BY {keys}")
