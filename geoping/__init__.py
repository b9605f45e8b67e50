"""geoping: device-telemetry and geospatial analytics as Spark DataFrame operators.

Sub-packages
------------
sources    readers: ping files, polygon files, run ledger, driver-table adapter
functions  Column -> Column helpers (classifiers, geometry, numeric)
operators  DataFrame -> DataFrame operators (transform, grid, stats, spatial join, ...)
sinks      writers (append/overwrite, replace-by-date, ledger)
streaming  Structured Streaming ingest with checkpoints
plans      orchestration of the ETL job and the registered query catalog
"""

__version__ = "0.1.0"
