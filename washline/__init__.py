"""washline: road washout screening and evaluation written as Spark DataFrame plans.

Subpackages
-----------
sources    scans and sinks (road tables, splits, scenario sets, driver fixtures)
functions  Column -> Column helpers (labels, log-odds, projection, geometry, risk)
operators  DataFrame -> DataFrame operators (prep, sampling, models, metrics, ...)
plans      end-to-end jobs and the query catalog used by ``__spark_entry__``
"""

__version__ = "0.1.0"
