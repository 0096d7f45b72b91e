"""vitalframe: Spark-native demographic and statistical table operators.

Every public operator is a function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, joins, windows and aggregates, so the work runs on
executors and Catalyst plans it.  Sub-packages:

* ``sources``   readers and writers (CSV/JSON/Parquet, keyed datasets, sinks)
* ``functions`` column expressions (hash randoms, PAF arithmetic, densities)
* ``operators`` relational building blocks (clean, join, aggregate, window,
  reshape, statistics, models)
* ``plans``     composite jobs (PAF -> cause scalar, exposure integral,
  under-one population step, fertility features and forecasts, lab pipeline)
* ``streaming`` incremental day-batch processing on Structured Streaming
"""

__version__ = "0.1.0"
