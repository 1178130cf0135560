"""tessera: cohort, text, sequence, evaluation and statistics operators on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame`` (or a ``Column``
expression) built from Spark SQL / DataFrame primitives so that Catalyst,
whole-stage codegen and AQE plan the physical work.
"""

__version__ = "0.1.0"

# Ship our own helper functions to Python workers by value, so tasks that run
# pandas code (mapInPandas) never depend on the package being installed on
# the executors.
try:  # pragma: no cover - import guard only
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
