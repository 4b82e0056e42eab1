"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

``load()`` returns the queries (name -> function of session and table folder) and
their SQL twins where SQL can say the same.
"""

from importlib import import_module

_MODULES = (
    "suffixes", "mixing", "shards", "quality", "toxicity", "winnow", "credentials", "tokens", "warc", "jaccard",
    "metric", "spelling", "negatives",
)


def load():
    queries, sql = {}, {}
    for name in _MODULES:
        m = import_module(f"tallyglass.llm.{name}")
        queries[m.NAME] = m.query
        if getattr(m, "SQL", None):
            sql[m.NAME] = m.SQL
    return queries, sql
