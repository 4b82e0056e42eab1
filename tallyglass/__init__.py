"""tallyglass: answer, profile, audit and evaluate star-schema data with Spark."""

import sys

from pyspark import cloudpickle

# Ship the few Python task functions by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tallyglass.session import get_session  # noqa: E402
from tallyglass.tables import Tables  # noqa: E402

__all__ = ["Tables", "get_session"]
