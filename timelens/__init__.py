"""User-timeline analytics as Spark jobs.

Sub-packages:

* ``functions``  column builders (text, time, vectors) and skew-safe helpers
* ``sources``    scans, normalisers, sinks, source merging
* ``operators``  timeline, window, feature, metric and matching operators
* ``learn``      cross-validated Spark ML, resampling, TF-IDF, ridge
* ``streaming``  Structured Streaming ingest and incremental collection
* ``plans``      registered end-to-end queries and their SQL cross-checks
"""
