"""qpanel — quarterly panel analytics on Spark DataFrames.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects
(or Column expressions); nothing here creates a session except
``qpanel.session.local_session`` which is meant for tests and benchmarks.
"""

__version__ = "0.1.0"

# Grouped-map functions (applyInPandas) are defined in this package; pickle
# them by value so Python workers need only numpy/pandas, not an installed
# copy of the package (no --py-files needed).
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
