"""Registered queries, one module per section of the operator inventory."""

from importlib import import_module

from tallyglass.plans.registry import REGISTRY, Query

_MODULES = (
    "scans", "selection", "joins", "aggregates", "windows", "ordering", "scalars",
    "golden", "warehouse", "profiling", "statistics", "learning", "privacy", "claims",
    "retrieval", "evaluation", "logs", "streams", "charts",
)


def load_all() -> dict[str, Query]:
    for m in _MODULES:
        import_module(f"tallyglass.plans.{m}")
    return REGISTRY
