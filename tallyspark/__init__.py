"""tallyspark: label building, scoring and agreement analysis as Spark jobs.

Every public operator is a plain function ``DataFrame -> DataFrame`` whose work
runs on Spark executors.  Modules:

* ``sources``    – readers, writers and the test views over the driver tables
* ``functions``  – column-level building blocks (hashes, parse rules, regexes)
* ``operators``  – codes, relational prep, text, sampling, metrics, vehicle
                   scoring, agreement, Spark ML baselines, batch prediction
* ``streaming``  – incremental scoring with Structured Streaming
* ``plans``      – the registry that binds query keys to operators and oracles
"""

__all__ = ["session"]
