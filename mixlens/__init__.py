"""mixlens: Spark-native driver analytics for panels of business series.

Layout
------
sources/    readers, writers and the two input views (product panel, driver series)
functions/  scalar column functions (dates, flags, safe arithmetic)
operators/  DataFrame operators: ordered-series windows, panel ops, feature build,
            grouped OLS, contributions, segmentation, forecasting
plans/      named end-to-end queries (the registry behind ``__spark_entry__``)
streaming/  notes only: the workload is batch (see streaming/__init__.py)
"""

import sys as _sys

# Python code that runs inside tasks (the per-model solve, the t-tail UDF) is
# pickled by value, so executors need no copy of this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - an older cloudpickle: ship the package with --py-files instead
    pass

from mixlens.session import get_spark, checkpoint_dir  # noqa: E402

__all__ = ["get_spark", "checkpoint_dir"]
