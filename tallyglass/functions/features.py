"""Free features of a question: length, wording cues, schema size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass import fixed
from tallyglass.functions import text


def wording(question: Column) -> dict[str, Column]:
    out = {"log_len": F.log1p(text.word_count(question))}
    for name, rx in fixed.DIFFICULTY_CUES.items():
        out[name] = question.rlike("(?iU)" + rx).cast("double")
    return out


def featurize(question: Column, table_names: list[str], n_columns: int, evidence: Column | None = None) -> dict[str, Column]:
    """All features in their fixed order. The schema is one catalog's list of tables."""
    asked = text.tokens(question)
    mentioned = F.lit(0.0)
    for name in table_names:
        hit = F.arrays_overlap(text.tokens(F.lit(name)), asked)
        mentioned = mentioned + F.coalesce(hit, F.lit(False)).cast("double")
    w = wording(question)
    has = F.lit(0.0) if evidence is None else (F.length(F.coalesce(evidence, F.lit(""))) > 0).cast("double")
    return {"log_len": w.pop("log_len"), "n_tables": F.lit(float(len(table_names))),
            "log_columns": F.log1p(F.lit(float(n_columns))), "tables_mentioned": mentioned, "has_evidence": has, **w}
